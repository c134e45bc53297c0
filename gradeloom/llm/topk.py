"""Exact top-k inner products by best-first search over M-trees.

Vectors are dealt to blocks by hash of their id. A task turns each block into a paged
M-tree: leaves of near vectors, parents over leaves, and for every node its pivot (a vector
of the node), the covering radius and the distance to the parent's pivot. A query descends
best-first by an upper bound of its inner product with anything below a node:

    q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2  <=  (|q|^2 + N^2 - max(0, d(q, pivot) - radius)^2) / 2

where ``N`` is the node's largest norm. ``|d(q, parent) - d(parent, pivot)|`` bounds
``d(q, pivot)`` from below without computing it, so most nodes are put aside by stored
distances alone. A node is dropped only if its bound is below the k-th score, so equal
scores are all seen and ties go to the smaller id. Components are 64-bit integers. Where an
inner product could pass 2^53, scores are summed in 64-bit integers instead of doubles; those
are right modulo 2^64, so every score that fits a long is exact. A score among the best that
fits no long fails the job.

Queries are packed into blocks too. A task builds the tree of one block of vectors and then
streams all blocks of queries past it; only the queries are repeated, once for each block of
vectors. Each block returns k rows a query, which meet in a last ranking.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .packed import expand, squeeze

K = 20
SCALE = 64
#: Rows of a block of vectors, of a block of queries, and of a page of the tree.
BLOCK, QUERIES, PAGE = 8_192, 512, 256
#: Slack of the bounds, absolute and as a share of the squared norms; far above rounding errors.
SLACK, SHARE = 1e-3, 1e-9
#: Inner products below this are exact in doubles.
EXACT = float(1 << 53)


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, point``: ``floor(scale * x)`` of every component; unusable vectors are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        "vec_id",
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("point"),
    )


class Tree:
    """An M-tree over the rows of ``points``, loaded level by level into pages."""

    def __init__(self, points: np.ndarray):
        whole, self.points = points, points.astype(np.float64)
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.levels: list[dict] = []
        # Rows in the order of the leaves, so that a leaf is one stretch of memory.
        self.order = np.concatenate([np.zeros(0, dtype=np.int64), *self._halved(self.points)])
        self.points, self.norms = self.points[self.order], self.norms[self.order]
        # Integers are kept only if some score could need them.
        self.longest = float(np.sqrt(self.norms.max(initial=0.0)))
        self.whole = whole[self.order].astype(np.int64) if self.longest**2 >= EXACT / 4 else None
        members = np.arange(len(points))
        radius, largest = np.zeros(len(points)), self.norms
        while len(members) > 1 or not self.levels:
            level = self._paged(members, radius, largest)
            self.levels.append(level)
            members, radius, largest = level["pivot"], level["radius"], level["largest"]

    def _halved(self, rows: np.ndarray) -> list[np.ndarray]:
        """Pages of near rows: halves about two far ones until a page is small enough."""
        stack, pages = [np.arange(len(rows))], []
        while stack:
            part = stack.pop()
            if len(part) <= PAGE:
                pages.append(part)
                continue
            first = part[np.argmax(self._apart(rows[part], rows[part[0]]))]
            away = self._apart(rows[part], rows[first])
            second = part[np.argmax(away)]
            order = np.argsort(away - self._apart(rows[part], rows[second]), kind="stable")
            half = len(part) // 2
            stack += [part[order[half:]], part[order[:half]]]
        return pages

    def _paged(self, members: np.ndarray, radius: np.ndarray, largest: np.ndarray) -> dict:
        """One level over ``members``; the leaves are stretches, their rows are in order already."""
        if self.levels:
            pages = self._halved(self.points[members])
        else:
            sizes = self._halved_sizes(len(members))
            pages = np.split(members, np.cumsum(sizes)[:-1])
        rows = self.points[members]
        level = {"pages": pages, "members": members}
        pivot = np.array([members[p[0]] for p in pages], dtype=np.int64)
        level["to_parent"] = [self._apart(rows[p], self.points[v]) for p, v in zip(pages, pivot)]
        level["radius_in"] = [radius[p] for p in pages]
        level["pivot"] = pivot
        level["radius"] = np.array([
            (d + r).max(initial=0.0) for d, r in zip(level["to_parent"], level["radius_in"])
        ])
        level["largest_in"] = [largest[p] for p in pages]
        level["largest"] = np.array([x.max(initial=0.0) for x in level["largest_in"]])
        return level

    @staticmethod
    def _halved_sizes(n: int) -> list[int]:
        """Sizes of the pages that :meth:`_halved` makes, in its order."""
        stack, sizes = [n], []
        while stack:
            part = stack.pop()
            if part <= PAGE:
                sizes.append(part)
            else:
                stack += [part - part // 2, part // 2]
        return sizes

    @staticmethod
    def _apart(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        difference = rows - point
        return np.sqrt(np.einsum("ij,ij->i", difference, difference))

    def scores(self, rows, query: np.ndarray, asked: np.ndarray, norm: float) -> np.ndarray:
        """Exact inner products of a query (as doubles and as integers) with some rows."""
        approximate = self.points[rows] @ query
        # A sum of products is off by far less than a hundredth of the product of the norms.
        if 1.01 * self.longest * np.sqrt(norm) < EXACT:
            return approximate
        points = self.points[rows].astype(np.int64) if self.whole is None else self.whole[rows]
        if np.abs(approximate).max(initial=0.0) >= 2.0**63 * (1 - 1e-9):
            return (points.astype(object) * asked.astype(object)).sum(axis=1)
        with np.errstate(over="ignore"):
            return (points * asked).sum(axis=1, dtype=np.int64)

    def search(self, query: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
        """The ``k`` best ``(score, vec_id)`` of the block but for the row with id ``own``."""
        best: list[tuple[float, int]] = []  # a heap of (score, -id), the worst first
        asked, query = query.astype(np.int64), query.astype(np.float64)
        norm = float(query @ query)
        worst = -np.inf

        def bound(apart: np.ndarray, radius: np.ndarray, largest: np.ndarray) -> np.ndarray:
            near = np.maximum(apart - radius, 0.0)
            return (norm + largest - near * near) / 2 + SLACK + SHARE * (norm + largest)

        top = len(self.levels) - 1
        root = self.points[self.levels[top]["pivot"][0]]
        queue = [(-np.inf, 0, top, 0, float(self._apart(query[None], root)[0]))]
        turn = 0
        while queue:
            limit, _, at, page, to_pivot = heapq.heappop(queue)
            if -limit < worst:
                break
            level = self.levels[at]
            part = level["pages"][page]
            stored = np.abs(to_pivot - level["to_parent"][page])
            # First by stored distances alone, then by the distances of what is left.
            left = np.flatnonzero(bound(stored, level["radius_in"][page], level["largest_in"][page]) >= worst)
            if not len(left):
                continue
            if at == 0:
                if 2 * len(left) > len(part):
                    rows = part
                    scores = self.scores(slice(part[0], part[-1] + 1), query, asked, norm)
                else:
                    rows = part[left]
                    scores = self.scores(rows, query, asked, norm)
                # Only rows that can still get in; of many, the k best and their equals.
                if len(best) == k:
                    can = np.flatnonzero(scores >= best[0][0])
                elif len(scores) > 2 * k:
                    can = np.flatnonzero(scores >= np.partition(scores, -k - 1)[-k - 1])
                else:
                    can = np.arange(len(scores))
                for score, vec in zip(scores[can].tolist(), ids[rows[can]].tolist()):
                    if vec == own:
                        continue
                    item = (score, -vec)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
                if len(best) == k:
                    worst = best[0][0]
                continue
            apart = self._apart(self.points[level["members"][part[left]]], query)
            limits = bound(apart, level["radius_in"][page][left], level["largest_in"][page][left])
            for child, upper, d in zip(part[left].tolist(), limits.tolist(), apart.tolist()):
                if upper >= worst:
                    turn += 1
                    heapq.heappush(queue, (-upper, turn, at - 1, child, d))
        return sorted(((s, -v) for s, v in best), key=lambda x: (-x[0], x[1]))


def _packed(size: int):
    """Rows ``vec_id, point`` of a task as blocks of up to ``size`` rows of one dimension each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def close(width: int) -> pa.RecordBatch:
            ids, points = held.pop(width)
            data = squeeze(np.array(ids, dtype="<i8"), np.concatenate(points).astype("<i8"))
            return pa.RecordBatch.from_arrays(
                [pa.array([width], pa.int32()), pa.array([data], pa.binary())], ["width", "data"]
            )

        for batch in batches:
            points = batch.column(1)
            ends = points.offsets.to_numpy()
            flat = points.values.to_numpy(zero_copy_only=False)
            for vec, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                ids, rows = held.setdefault(b - a, ([], []))
                ids.append(vec)
                rows.append(flat[a:b])
                if len(ids) == size:
                    yield close(b - a)
        for width in list(held):
            yield close(width)

    return run


def _searched(k: int):
    """Rows ``block, kind, width, data`` in order: a block's vectors (kind 0), then all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tree, ids = None, None, None
        for batch in batches:
            for block, kind, width, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if kind == 0:
                    ids, points = expand(data, "<i8", "<i8")
                    at, tree = (block, width), Tree(points.reshape(len(ids), width))
                    ids = ids[tree.order]
                    continue
                if at != (block, width):
                    continue
                asked, points = expand(data, "<i8", "<i8")
                query, vec, score = [], [], []
                for own, point in zip(asked.tolist(), points.reshape(len(asked), width)):
                    for s, v in tree.search(point, ids, own, k):
                        if not -(1 << 63) <= s < 1 << 63:
                            raise OverflowError(f"the score of {own} and {v} does not fit a long")
                        query.append(own)
                        vec.append(v)
                        score.append(int(s))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(query, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.int64())],
                    ["query_id", "vec_id", "score"],
                )

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best vectors for every query.

    Both inputs need ``vec_id`` and ``embedding`` (array of float or double); other columns
    are ignored. A vector is no candidate for the query of its own id. Score is the inner
    product of the quantised vectors, ties go to the smaller id; fewer candidates than ``k``
    give fewer rows.

    Vectors that are null or hold null or non-finite components take no part, nor do rows
    without an id; repeated rows of one id count once. Vectors of different length do not
    meet. Empty tables give an empty result. Scores are exact as long as they fit 64
    bits; components beyond 64 bits after scaling count as the nearest 64-bit integer.
    """
    def packed(df: DataFrame, size: int, parts: int) -> DataFrame:
        rows = quantised(df.filter("vec_id is not null"), scale).dropDuplicates(["vec_id", "point"])
        return cut(rows.repartition(parts, "vec_id").mapInArrow(_packed(size), "width int, data binary"))

    n = -(-vectors.count() // BLOCK)
    trees = packed(vectors, BLOCK, max(1, n)).withColumn("block", F.monotonically_increasing_id())
    asked = packed(queries, QUERIES, max(1, n // 8))
    blocks = trees.select("block", "width")
    every = trees.select("block", F.lit(0).alias("kind"), "width", "data").unionByName(
        blocks.join(asked, "width").select("block", F.lit(1).alias("kind"), "width", "data")
    )
    found = (
        every.repartition(max(1, n), "block").sortWithinPartitions("block", "kind")
        .mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """WITH q AS (
 SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS DOUBLE)) AS p FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
 SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.p, b.p) AS BIGINT) AS score
 FROM q a JOIN q b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
 SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""
