"""Mixing sources to target weights by capped water-filling (built-in functions only).

Every source asks for its share of all words by weight. No source may be read more than
``max_epochs`` times, so sources that would need more are clamped and what they cannot give
is shared among the others by weight, until none is above its limit. In order of
``limit / weight`` the clamped sources come first, so one pass of running sums over the
sources finds the water level instead of a loop.

A source's target is then read as whole repetitions of all its documents plus a rest. The
rest is a seeded sample: documents in the order of a hash, up to the document that brings
the sum nearest to the target. The order is never sorted as a whole: hash cells (4,096 a
source) are summed, and only the documents of the one cell in which the sum passes the
target are put in order. What comes out is one hash per source up to which documents are
taken once more, so reading the mix moves no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import join_on, lookup
from ..session import cut
from .common import WORD

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of a hash that name its cell: 4,096 cells a source.
CELL_DIGITS = 3


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``, one row per source.

    The weights repeat over the sources by code point, null last. The table holds a row per
    source, not per document; its order is the one thing that is global.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn(
        "w",
        F.element_at(
            F.array(*[F.lit(float(w)) for w in weights]),
            ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
        ),
    ).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    along = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    onward = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(every).cast("double")
        - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / F.sum("w").over(onward)
    levels = weighted.withColumn("level", level)
    free = F.max(F.when(F.col("cap") / F.col("w") > F.col("level"), F.col("level"))).over(every)
    return levels.withColumn("water", free).select(
        "source",
        "source_size",
        F.least("cap", F.coalesce(F.col("w") * F.col("water"), F.col("cap"))).alias("target"),
    )


def _drawn(seed: str) -> Column:
    """A seeded hash of the id in hex; its order is the order of the sample."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    """``doc_id, source, size, drawn, cell``, written once: texts are read and counted one time."""
    return cut(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            _drawn(seed).alias("drawn"),
        ).withColumn("cell", F.substring("drawn", 1, CELL_DIGITS))
    )


def _plan(rows: DataFrame, weights, max_epochs: int) -> DataFrame:
    """``source, source_size, target, whole, last_drawn``: one row per source.

    A document is read ``whole`` times, and once more if its hash is at most ``last_drawn``.
    """
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(
        cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, max_epochs
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    plan = targets.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("int")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    # The cell in which the running sum of a source passes its rest.
    along = Window.partitionBy("source").orderBy("cell")
    passing = cut(
        join_on(cells.withColumn("after", F.sum("cell_size").over(along)), plan, ["source"])
        .filter(F.col("after") > F.col("rest"))
        .groupBy("source")
        .agg(
            F.min("cell").alias("cell"),
            F.min_by(F.col("after") - F.col("cell_size"), "cell").alias("before"),
            F.first("rest").alias("rest"),
        )
    )
    # Inside that cell: a document is taken if that brings the sum nearer to the rest. All
    # before it are then taken too, so the last one's hash tells which are.
    inside = (
        Window.partitionBy("source").orderBy("drawn", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    last = (
        lookup(rows, passing, ["source", "cell"], "drawn", written=True)
        .withColumn("so_far", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .filter(F.col("so_far") + F.col("size") / 2 <= F.col("rest"))
        .groupBy("source").agg(F.max("drawn").alias("last"))
    )
    passing = join_on(passing, last, ["source"], "left").select(
        "source", F.coalesce("last", "cell").alias("last_drawn")
    )
    return join_on(plan, passing, ["source"], "left").select(
        "source", "source_size", "target", "whole", "last_drawn"
    )


def _repeats() -> Column:
    return F.col("whole") + F.coalesce((F.col("drawn") <= F.col("last_drawn")).cast("int"), F.lit(0))


def mix_sources(
    docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """How often the mix reads each document.

    ``docs`` needs ``doc_id, text, source``; other columns are ignored. Returns ``doc_id,
    source, size, source_size, target, repeats, taken`` with one row per input row.

    A null text has size 0; a null source is a source of its own, last in order. Rows with
    one ``doc_id`` in a source are repeated alike. An empty table gives an empty result, a
    source without words the target 0.
    """
    rows = _sized(docs, seed)
    return (
        lookup(rows, _plan(rows, weights, max_epochs), ["source"], "drawn")
        .withColumn("repeats", _repeats())
        .select(
            "doc_id", "source", "size", "source_size", "target", "repeats",
            (F.col("repeats") * F.col("size")).alias("taken"),
        )
    )


def mix_documents(
    docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as :func:`mix_sources` says, all columns."""
    plan = _plan(_sized(docs, seed), weights, max_epochs)
    rows = docs.select(F.struct("*").alias("row"), "source", _drawn(seed).alias("drawn"))
    return (
        lookup(rows, plan, ["source"], "drawn")
        .select(F.explode(F.array_repeat("row", _repeats())).alias("row")).select("row.*")
    )


ORACLE = f"""WITH sized AS (
 SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS drawn FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (
 SELECT *, ([5.0, 2.0, 1.0])[CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w,
  3.0::DOUBLE * source_size AS cap FROM per),
levels AS (
 SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
water AS (SELECT *, max(level) FILTER (WHERE cap / w > level) OVER () AS water FROM levels),
plan AS (
 SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole
 FROM (SELECT source, source_size, least(cap, coalesce(w * water, cap)) AS target FROM water)),
placed AS (
 SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY drawn, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM sized)
SELECT p.doc_id, p.size, t.source_size, t.target,
 CAST(p.size * (t.whole + CASE WHEN p.so_far + p.size / 2 <= t.target - t.whole * t.source_size
  AND t.target > t.whole * t.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed p JOIN plan t ON p.source IS NOT DISTINCT FROM t.source"""
