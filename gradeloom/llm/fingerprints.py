"""Document fingerprints: threshold-scaled sketches of word shingles (built-in functions only).

A sketch keeps every shingle hash below a fixed fraction of the hash space. Because the
threshold is the same for all texts, the sketch of a union is the union of the sketches, and
the share of a short text's hashes found in a long text's sketch estimates containment
however unequal the two are; a sketch of fixed length could not do that.

A shingle is five consecutive words; a text of one to four words is one shingle. Hashes
have 40 bits. A sketch of fewer than ``LEAST_KEPT`` hashes is too small for an estimate: then
all hashes of both texts are compared, which is exact. A fingerprint is the sketch; that of a
text whose hashes all lie above the threshold holds all its hashes after a mark instead, so
only texts without words have an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP, sha

WIDTH = 5
BITS = 40
#: One hash in this many is kept.
SCALE = 4
#: Sketches with fewer hashes are no base for an estimate; the fingerprint of all hashes begins so.
LEAST_KEPT, WHOLE = 8, "+"
#: Rows of one stretch of ids, and the least and most stretches; boundaries are one small list.
STRETCH, LEAST_STRETCHES, MOST_STRETCHES = 1_000, 512, 10_000


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """The hashes of all shingles of a text in order, repeats included; null counts as empty."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")

    def hashed(*columns: Column) -> Column:
        return F.shiftrightunsigned(F.xxhash64(*columns), 64 - BITS)

    def every(all_words: Column) -> Column:
        count = F.size(all_words)
        shingles = F.when(
            count >= width,
            F.transform(
                F.sequence(F.lit(0), count - width),
                lambda i: hashed(*[F.get(all_words, i + j) for j in range(width)]),
            ),
        ).otherwise(F.array(hashed(F.array_join(all_words, " "))))
        return F.when(count > 0, shingles).otherwise(F.array().cast("array<bigint>"))

    return bound(words, every)


def sketch(text: Column, scale: int = SCALE, width: int = WIDTH) -> Column:
    """The sorted hashes of a text below the threshold; null counts as empty."""
    limit = (1 << BITS) // scale
    return F.sort_array(F.array_distinct(F.filter(shingle_hashes(text, width), lambda x: x < limit)))


def whole_set(text: Column, width: int = WIDTH) -> Column:
    """The sorted hashes of all shingles of a text."""
    return F.sort_array(F.array_distinct(shingle_hashes(text, width)))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once: a one-element array carries it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merged(*sketches: Column) -> Column:
    """The sketch of all texts together."""
    union = sketches[0]
    for other in sketches[1:]:
        union = F.array_union(union, other)
    return F.sort_array(union)


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller set of hashes that the larger holds; equal ones give 1, else an empty one 0."""
    least = F.least(F.size(a), F.size(b))
    return (
        F.when(a == b, 1.0)
        .when(least == 0, 0.0)
        .otherwise(F.size(F.array_intersect(a, b)) / least)
        .cast("double")
    )


def likeness(text: Column, kept: Column, other_text: Column, other_kept: Column) -> Column:
    """Containment by the sketches of two texts, or by all their hashes if a sketch is too small."""
    small = F.least(F.size(kept), F.size(other_kept)) < LEAST_KEPT
    return F.when(small, containment(whole_set(text), whole_set(other_text))).otherwise(
        containment(kept, other_kept)
    )


def fingerprint_text(text: Column, kept: Column) -> Column:
    """The sketch of a text, or all its hashes after a mark if none of them is kept."""
    whole = as_text(whole_set(text))
    return F.when(F.size(kept) > 0, as_text(kept)).when(whole == "", "").otherwise(F.concat(F.lit(WHOLE), whole))


def as_text(values: Column) -> Column:
    """A sketch as fixed-width hex numbers, one after the other."""
    digits = BITS // 4
    return F.array_join(F.transform(values, lambda h: F.lower(F.lpad(F.hex(h), digits, "0"))), "")


def _stretch(column: str, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most the value; a binary search over the list."""
    if not bounds:
        return F.lit(0)
    array = F.lit(bounds)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    value = F.col(column)
    return F.aggregate(
        F.lit(steps), F.lit(0),
        lambda low, step: low + F.when(
            (low + step <= len(bounds)) & (F.get(array, low + step - 1) <= value), step
        ).otherwise(0),
    )


def with_next(docs: DataFrame, **derived: Column) -> DataFrame:
    """Add ``next_text`` and the ``derived`` columns of a row and its next one, as ``next_*``.

    ``docs`` has ``doc_id, text``. The next row has the next smaller id; the smallest is
    followed by the largest. Ids are cut into stretches of near equal row
    counts at approximate quantiles; the first row of each stretch is copied to the end of
    the stretch before, so that every row finds its successor inside its own stretch and
    texts are shuffled once. Null ids come last; rows with one id follow the text's hash.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    wanted = min(MOST_STRETCHES, max(LEAST_STRETCHES, n // STRETCH))
    found = ids.agg(
        F.percentile_approx("doc_id", [k / wanted for k in range(1, wanted)], 10_000).alias("b")
    ).first()["b"]
    bounds = sorted(set(found or []))
    rows = docs.withColumn("tie", F.xxhash64("text")).withColumn("stretch", _stretch("doc_id", bounds))

    # One head for each stretch, at most MOST_STRETCHES rows.
    narrow = docs.select("doc_id", F.xxhash64("text").alias("tie")).withColumn(
        "stretch", _stretch("doc_id", bounds)
    )
    order = F.struct(
        F.col("doc_id").isNull().cast("int").alias("none"), F.bitwise_not("doc_id").alias("down"), F.col("tie")
    )
    heads = narrow.groupBy("stretch").agg(F.min(order).alias("head"))
    along = Window.orderBy("stretch")
    heads = heads.select(
        "head", "stretch",
        F.coalesce(F.lead("stretch").over(along), F.min("stretch").over(Window.partitionBy())).alias("before"),
    )
    copies = (
        rows.join(
            F.broadcast(heads.select(
                "before", F.col("stretch").alias("_s"),
                F.col("head.down").alias("_d"), F.col("head.tie").alias("_t"),
            )),
            (F.col("stretch") == F.col("_s")) & F.col("tie").eqNullSafe(F.col("_t"))
            & F.bitwise_not("doc_id").eqNullSafe(F.col("_d")),
        )
        .drop("stretch", "_s", "_d", "_t").withColumnRenamed("before", "stretch")
    )
    every = rows.withColumn("copy", F.lit(0)).unionByName(copies.withColumn("copy", F.lit(1)))
    every = every.withColumns(derived)
    inside = Window.partitionBy("stretch").orderBy("copy", F.col("doc_id").desc_nulls_last(), "tie")
    following = F.lead(F.struct("text", *derived)).over(inside)
    return (
        every.withColumn("following", following).filter("copy = 0")
        .select("doc_id", "text", *derived,
                *[F.col(f"following.{c}").alias(f"next_{c}") for c in ["text", *derived]])
    )


def fingerprint_documents(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and how alike they are.

    ``docs`` needs ``doc_id, text``; other columns are ignored. The edited text has the last
    half of the code points (rounded down) replaced by the first as many of the next
    document, ids descending. Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``; ``near_*`` estimate containment of the
    smaller shingle set in the larger, and are exact for sketches below ``LEAST_KEPT`` hashes.

    A null text counts as empty; its sketch is empty, two texts without words are alike. Equal
    texts have equal fingerprints. A single row is its own next; repeated rows follow each
    other; an empty table gives an empty result.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = with_next(rows, sketch=sketch(F.col("text"), scale))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), n - half),
        F.substring("next_text", F.lit(1), half),
    )
    out = placed.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), scale))
    return out.select(
        "doc_id", n.cast("long").alias("n_chars"), sha("edited").alias("edited_sha256"),
        fingerprint_text(F.col("text"), F.col("sketch")).alias("fingerprint"),
        fingerprint_text(F.col("edited"), F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("sketch"), F.col("edited"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("text"), F.col("sketch"), F.col("next_text"), F.col("next_sketch")).alias("near_next"),
    )
