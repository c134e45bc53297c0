"""Ordered work per key that does not need one task per key.

A plain window sends all rows of a key to one task. A report, a job or a user may hold a
third of all rows, so the functions here cut each key into bounded stretches:

* :func:`with_row_number` range-sorts by key and order, so a big key spans many partitions,
  then adds what the earlier partitions hold.
* :func:`scan` takes an integer order column and splits each key into blocks of consecutive
  values. Windows run inside a block; one small row per block carries state to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .joins import join_on

#: Values of the order column per block. The order column is unique within a key, so this
#: is also the most rows one window has to hold.
BLOCK = 1 << 16


def block_of(order: str, block: int | None = None) -> Column:
    """Number of the block a row falls in."""
    return F.expr(f"`{order}` div {block or BLOCK}")


def with_row_number(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "row_no"
) -> DataFrame:
    """Number the rows of each key from 1 in the given order.

    The sorted rows are checkpointed: range boundaries come from a sample, so the counts
    and the rows must see the same partitions.
    """
    # Order expressions become columns first: a sort would work them out per comparison.
    by = {f"_o{n}": c for n, c in enumerate(order)}
    placed = cut(
        df.withColumns(by).orderBy(*keys, *by)
        .withColumn("_id", F.monotonically_increasing_id()).drop(*by)
    ).withColumn("_part", F.shiftright("_id", 33))
    spans = placed.groupBy(*keys, "_part").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = spans.select(
        *keys,
        "_part",
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    return (
        join_on(placed, spans, [*keys, "_part"])
        .withColumn(name, F.col("_id") + F.col("_shift"))
        .drop("_id", "_part", "_shift")
    )


def scan(
    df: DataFrame,
    keys: list[str],
    order: str,
    *,
    last: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    block: int | None = None,
) -> DataFrame:
    """Running values along ``order``, an integer column unique within ``keys``.

    ``last``: newest non-null value up to the row; ``before``: the same without the row
    itself. ``total``: running sum up to the row.
    ``previous`` / ``following``: value of the neighbouring row (null outside the key).
    """
    last, before, total = last or {}, before or {}, total or {}
    previous, following = previous or {}, following or {}
    rows = df.withColumn("_block", block_of(order, block))
    group = [*keys, "_block"]
    at = F.col(order)

    ends = (
        [F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_c_{n}") for n, c in {**last, **before}.items()]
        + [F.sum(c).alias(f"_c_{n}") for n, c in total.items()]
        + [F.max_by(F.struct(c.alias("v")), at).alias(f"_c_{n}") for n, c in previous.items()]
        + [F.min_by(F.struct(c.alias("v")), at).alias(f"_c_{n}") for n, c in following.items()]
    )
    blocks = rows.groupBy(*group).agg(*ends)
    along = Window.partitionBy(*keys).orderBy("_block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        *group,
        *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_c_{n}")
          for n in [*last, *before]],
        *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in total],
        *[F.lag(f"_c_{n}").over(along).alias(f"_c_{n}") for n in previous],
        *[F.lead(f"_c_{n}").over(along).alias(f"_c_{n}") for n in following],
    )

    inside = Window.partitionBy(*group).orderBy(order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up_to = inside.rowsBetween(Window.unboundedPreceding, -1)

    def neighbour(step, n, c):
        return F.coalesce(step(F.struct(c.alias("v"))).over(inside), F.col(f"_c_{n}"))["v"]

    joined = join_on(rows, carried, group)
    return joined.withColumns(
        {n: F.coalesce(F.last(c, ignorenulls=True).over(running), F.col(f"_c_{n}"))
         for n, c in last.items()}
        | {n: F.coalesce(F.last(c, ignorenulls=True).over(up_to), F.col(f"_c_{n}"))
           for n, c in before.items()}
        | {n: F.coalesce(F.sum(c).over(running), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
           for n, c in total.items()}
        | {n: neighbour(F.lag, n, c) for n, c in previous.items()}
        | {n: neighbour(F.lead, n, c) for n, c in following.items()}
    ).drop("_block", *[f"_c_{n}" for n in [*last, *before, *total, *previous, *following]])


def ordered_text(
    df: DataFrame, keys: list[str], order: str, text: str, name: str, *,
    separator: str = "\n", block: int | None = None,
) -> DataFrame:
    """Join the non-empty ``text`` values of each key with ``separator``, in ``order``.

    Parts are joined per block first, so the rows of a big key are sorted in many tasks and
    only finished parts meet in the last one. Keys without text give an empty string.
    """
    def joined(value: str, along: str) -> Column:
        between = separator.replace("\n", "\\n")
        return F.expr(f"listagg({value}, '{between}') WITHIN GROUP (ORDER BY `{along}`)")

    parts = (
        df.withColumn("_block", block_of(order, block))
        .groupBy(*keys, "_block")
        .agg(joined(f"nullif(`{text}`, '')", order).alias("_text"))
    )
    return parts.groupBy(*keys).agg(
        F.coalesce(joined("_text", "_block"), F.lit("")).alias(name)
    )
