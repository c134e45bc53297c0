"""Centroid clustering of whole-number vectors with a bisector tournament.

For centroids ``a`` before ``b`` the points nearer to ``b`` lie beyond the plane half way
between them: ``2 (b - a) . x > |b|^2 - |a|^2``. Normals and thresholds of all pairs are worked
out once a round. A vector then needs k - 1 sign tests, the champion so far against the next
centroid; zero is a tie and leaves the smaller number in place. Only the distance to the
winner is computed. All numbers are whole, so nothing depends on the order of the rows.

A round is one pass over the vectors: each task sums up its vectors per centroid, and Spark
adds those sums as decimals. What reaches the driver is k centroids.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Whole numbers up to these sizes are exact in doubles and in 64 bits.
EXACT_DOUBLE, EXACT_LONG = 1 << 53, (1 << 63) - 1


def kept_vectors(vectors: DataFrame, id_column: str, column: str, dimensions: int) -> DataFrame:
    """``vec_id, x`` of the rows with exactly ``dimensions`` components, all of them finite."""
    x = F.col(column).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != math.inf))
    return vectors.select(F.col(id_column).alias("vec_id"), x.alias("x")).filter(
        (F.size("x") == dimensions) & finite
    )


def _matrix(column: pa.ListArray, dimensions: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dimensions)


def whole_numbers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exact: 64-bit numbers where they fit, else Python's own."""
    largest = float(np.abs(x).max(initial=0))
    if largest * scale < EXACT_DOUBLE:
        return np.floor(x * scale).astype(np.int64)

    def one(v: float) -> int:
        up, down = float(v).as_integer_ratio()
        return scale * up // down

    return np.array([[one(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


class Bisectors:
    """Normals and thresholds of all pairs of ``centroids`` (lists of whole numbers)."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = centroids
        squares = [sum(c * c for c in centroid) for centroid in centroids]
        self._pairs = {
            (a, b): (
                [2 * (v - u) for u, v in zip(centroids[a], centroids[b])],
                squares[b] - squares[a],
            )
            for b in range(len(centroids)) for a in range(b)
        }
        self._largest = max((abs(c) for centroid in centroids for c in centroid), default=0)

    def _number_type(self, x: np.ndarray):
        """The fastest type in which every sum below is exact."""
        largest = max(self._largest, int(np.abs(x).max(initial=0)))
        # Sides of a sign test and squared distances stay within 8 d m^2.
        bound = 8 * max(1, x.shape[1]) * largest * largest
        return np.float64 if bound < EXACT_DOUBLE else np.int64 if bound < EXACT_LONG else object

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row and the squared distance to it."""
        kind = self._number_type(x)
        x = x.astype(kind)
        champion = np.zeros(len(x), dtype=np.int64)
        for rival in range(1, len(self.centroids)):
            for holder in range(rival):
                rows = np.flatnonzero(champion == holder)
                if not len(rows):
                    continue
                normal, threshold = self._pairs[holder, rival]
                side = x[rows] @ np.array(normal, dtype=kind)
                champion[rows[side > threshold]] = rival
        apart = x - np.array(self.centroids, dtype=kind)[champion]
        distance = (apart * apart).sum(axis=1)
        return champion, distance if kind is object else distance.astype(np.int64)


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest hashes; equal ids go by their components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    rows = kept.select(F.sha2(name, 256).alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return [[int(v) for v in whole_numbers(np.array([row["x"]]), scale)[0]] for row in rows]


def _sums(bisectors: Bisectors, dimensions: int, scale: int):
    """Per task and centroid: how many vectors are nearest to it, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(bisectors.centroids)
        counts, sums = [0] * k, [[0] * dimensions for _ in range(k)]
        for batch in batches:
            x = whole_numbers(_matrix(batch.column(1), dimensions), scale)
            number, _ = bisectors.nearest(x)
            for c in np.unique(number).tolist():
                own = x[number == c]
                counts[c] += len(own)
                wide = own.dtype != object and int(np.abs(own).max()) * len(own) > EXACT_LONG
                total = (own.astype(object) if wide else own).sum(axis=0).tolist()
                sums[c] = [a + int(b) for a, b in zip(sums[c], total)]
        rows = [
            (c, place, str(value), counts[c])
            for c in range(k) if counts[c] for place, value in enumerate(sums[c])
        ]
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds)], ["cluster", "place", "value", "n"]
        )

    return run


def next_centroids(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """One round: floors of the means of each centroid's vectors; a centroid without any stays."""
    dimensions = len(centroids[0])
    parts = kept.select("vec_id", "x").mapInArrow(
        _sums(Bisectors(centroids), dimensions, scale), "cluster int, place int, value string, n long"
    )
    totals = parts.groupBy("cluster", "place").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("value"),
        F.sum("n").alias("n"),
    )
    moved = [list(c) for c in centroids]
    for row in totals.collect():  # k times the dimensions
        moved[row["cluster"]][row["place"]] = int(row["value"]) // row["n"]
    return moved


def _assigned(bisectors: Bisectors, dimensions: int, scale: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = bisectors.nearest(
                whole_numbers(_matrix(batch.column(1), dimensions), scale)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number, pa.int32()),
                 pa.array([str(d) for d in distance.tolist()], pa.string())],
                ["vec_id", "cluster", "distance"],
            )

    return run


def cluster_vectors(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = 8,
    rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3,
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of each vector.

    Vectors with another number of components, or with null or non-finite ones, are left
    out. Components become floor(scale * x). The first centroids are the ``k`` vectors with
    the smallest SHA-256 of ``seed:id``, all of them if there are fewer; after ``rounds``
    rounds (fewer, if one moves no centroid) the vectors are assigned once more.

    Null ids count as the word null in that hash; repeated rows are vectors of their own;
    extra columns are ignored; an empty table gives an empty result. Components of any size
    are exact; a squared distance or sum beyond 64 bits is null. Sums per centroid hold 38
    digits, more fails the job.
    """
    kept = cut(kept_vectors(vectors, id_column, column, dimensions))
    centroids = first_centroids(kept, k, seed, scale)
    for _ in range(rounds if centroids else 0):
        moved = next_centroids(kept, centroids, scale)
        if moved == centroids:
            break
        centroids = moved
    kind = kept.schema["vec_id"].dataType.simpleString()
    assigned = cut(kept.mapInArrow(
        _assigned(Bisectors(centroids), dimensions, scale, kind),
        f"vec_id {kind}, cluster int, distance string",
    ).withColumn("distance", F.col("distance").try_cast("decimal(38,0)")))
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(
        F.sum("distance").cast("string").alias("d")).collect()}  # k rows

    def fits(value: int | None):
        return F.lit(value if value is not None and value <= EXACT_LONG else None).cast("long")

    def by_cluster(value):
        choice = F.lit(None)
        for c in range(len(centroids)):
            choice = F.when(F.col("cluster") == c, value(c)).otherwise(choice)
        return choice

    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return assigned.select(
        "vec_id", "cluster", F.col("distance").try_cast("long").alias("distance"),
        by_cluster(lambda c: fits(inertia.get(c))).cast("long").alias("cluster_inertia"),
        fits(sum(inertia.values())).alias("inertia"),
        by_cluster(lambda c: F.lit(shas[c])).cast("string").alias("centroid_sha256"),
    )


def oracle(k: int = 8, rounds: int = 10, dimensions: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same in SQL, a round after the other; distances are compared pair by pair there."""
    places = f"range(1, {dimensions + 1})"
    steps = [
        f"""kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding,
                lambda v: CAST(floor({scale} * CAST(v AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE len(embedding) = {dimensions}
              AND len(list_filter(embedding, lambda v: isfinite(v))) = {dimensions})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x AS m
            FROM (SELECT sha256('{seed}:' || vec_id) AS h, x FROM kept) ORDER BY h, x LIMIT {k})""",
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
            SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
                SELECT r, c, list_sum(list_transform({places},
                    lambda i: (x[i] - m[i]) * (x[i] - m[i])))::BIGINT AS d
                FROM kept, c{n}) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
            SELECT c{n}.c AS c, coalesce(g.m, c{n}.m) AS m FROM c{n} LEFT JOIN (
                SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (
                    SELECT best.c AS c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n
                    FROM (SELECT x, best, unnest({places}) AS i FROM kept JOIN a{n} USING (r))
                    GROUP BY best.c, i)
                GROUP BY c) g ON g.c = c{n}.c)""")
    return f"""WITH {", ".join(steps)}
        SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance,
               CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(list_transform(m, lambda v: CAST(v AS BIGINT)), ',')) AS centroid_sha256
        FROM kept JOIN a{rounds} USING (r) JOIN c{rounds} AS last ON last.c = best.c"""


ORACLE = oracle()
