"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: A lookup table up to this many rows and bytes (as JSON text) is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 10_000, 16 << 20
#: Beyond it, the rows of one key are spread over this many join partitions.
SPREAD = 32


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join that also matches null keys; keeps the left key columns."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    match = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, match, how).drop(*[f"__{k}" for k in keys])


def lookup(
    left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "inner",
    written: bool = False,
) -> DataFrame:
    """Join many rows with a table of one row per key, safe for keys of any size.

    The table is written once, counted and measured (``written`` tells that reading it is
    cheap already). A small one is broadcast, so ``left`` does not move. A larger one is
    repeated for each of ``SPREAD`` shares, and the rows of a key go to the share of their
    ``spread`` column; without that, a later grouping by the same key would keep all rows
    of a big key in one task.
    """
    right = right if written else cut(right)
    some = right.limit(BROADCAST_ROWS + 1).select(F.length(F.to_json(F.struct("*"))).alias("n"))
    rows, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        return join_on(left, F.broadcast(right), keys, how)
    shares = right.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    spread_left = left.withColumn("_share", F.pmod(F.xxhash64(spread), F.lit(SPREAD)).cast("int"))
    # Estimates come from compressed files and know nothing of the shares: without the hint
    # a table found too big for a broadcast could still get one.
    return join_on(spread_left, shares.hint("merge"), [*keys, "_share"], how).drop("_share")
