"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Edges of one task; few edges in many tasks would leave many tiny files.
TASK_EDGES = 50_000


def _tasks(edges: int) -> int:
    return 1 + edges // TASK_EDGES


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` links; the root is the smallest node reachable.

    Alternates two steps until nothing changes, which takes a number of rounds in the order
    of the logarithm of the largest component: every node links its larger neighbours to its
    smallest one, then itself and its smaller neighbours to the smallest. Minima are grouped
    in the tasks first and joined back by key, so a node with many links is an ordinary
    skewed join. Links with a null end and loops do not count. What is written has as many
    parts as the number of edges asks for, whatever the number of shuffle partitions.
    """
    known = cut(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    size = known.count()
    edges = known.coalesce(_tasks(size))
    state = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(found) == state or found[0] == 0:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state, size = tuple(found), found[0]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        large = cut(
            both.filter("b > a").join(least, F.col("a") == F.col("u"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct().coalesce(_tasks(size))
        )
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(least, F.col("a") == F.col("u"))
        edges = cut(
            joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
            .coalesce(_tasks(size))
        )
