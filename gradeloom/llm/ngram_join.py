"""Exact n-gram Jaccard join through count-vector R-trees.

A document is the set of its distinct word shingles. Its hashes fall into 64 groups, and
the counts of the groups are a point. The overlap of two sets is at most the sum of the
smaller coordinates of their points, and at most that sum with a tree node's upper corner
for every point in the node: a search puts aside nodes and points that cannot reach the
overlap a similarity of 0.85 needs, and verifies the rest on the sets.

Trees are built over blocks, not over all documents. In any fixed order of all shingles,
two sets of similarity ``t`` share one of the first ``n - ceil(t * n) + 1`` shingles of each;
a block holds the sets that share such a shingle and whose sizes allow a link. The order
puts shingles with a rare word first: a table of the document counts of all words ranks a
shingle by its rarest word, which no shingle exceeds in frequency. So the common lines and
passages of a corpus make no blocks. Any table of counts gives the same links; a good one
gives small blocks.

Equal sets are one point from the start, whatever the number of their documents. A large
block is searched in parts of bounded size; the parts' components are joined through one
set each, and only parts that then still are in different components are searched against
each other. A pair that is connected already is not verified again: the result is which
documents are connected, and no link that would connect two components is left out.

What moves is small: points first, and then the words, compressed, of the sets that may link
with another by their points. Shingles are hashed again where they are compared.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, small_batches
from .common import WORD, partitions, row_key
from .graph import components
from .packed import CHUNK_CHARS, Numbered, expand, releasing, squeeze

WIDTH, PERCENT = 4, 85
GROUPS = 64
#: Cells of the table of document counts that ranks the shingles: one byte each in every task.
CELL_BITS = 22
#: Sets, and shingles in all sets, of one part of a block.
PART_SETS, PART_SHINGLES = 128, 2_000_000
#: Size of the bitmap of wanted documents: 8 MB.
BITS = 1 << 26
#: Bits of hash of a prefix shingle besides its bucket.
SKETCH_MASK = (1 << 40) - 1
#: Words a task remembers the hashes of.
REMEMBERED = 200_000
#: Points of a leaf and children of an inner node.
LEAF, FAN = 16, 8
LEAST_BUCKETS = 64


def _word_bytes(text: str) -> list[bytes]:
    """The words; only A-Z are lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def _hashes(words) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Hashes of the shingles of a sequence of word hashes, with repeats; shorter ones are one shingle."""
    n = len(words)
    size = min(n, width)
    if not n:
        return words
    h = np.full(n - size + 1, np.uint64(size))
    for j in range(size):
        h = _stirred(h * np.uint64(0xC2B2AE3D27D4EB4F) + words[j : n - size + 1 + j])
    return h


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest overlap of sets of sizes ``a`` and ``b`` with that similarity."""
    return -(-percent * (a + b) // (100 + percent))


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _document_counts(buckets: int):
    """Packed rows ``bucket, data``: cells of words and in how many documents of the chunk they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            times = np.bincount(np.frombuffer(codes, dtype="<u4"), minlength=len(numbers))
            cells, at = np.unique(_cells(_hashes(numbers)), return_inverse=True)
            totals = np.bincount(at, weights=times).astype("<u4")
            edges = np.searchsorted(cells, _edges(buckets)).tolist()
            data = [
                squeeze(np.diff(cells[a:b], prepend=0).astype("<u4"), totals[a:b])
                for a, b in zip(edges[:-1], edges[1:])
            ]
            return pa.RecordBatch.from_arrays(
                [pa.array(range(buckets), pa.int32()), pa.array(data, pa.binary())], ["bucket", "data"]
            )

        numbers, codes, chars = Numbered(), array("I"), 0
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py() or ""
                codes.extend(map(numbers.__getitem__, set(_word_bytes(text))))
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield close()
                    numbers, codes, chars = Numbered(), array("I"), 0
        if codes:
            yield close()

    return run


def _edges(buckets: int) -> np.ndarray:
    """Where the cells of each bucket begin, and the end."""
    return np.arange(buckets + 1) * (1 << CELL_BITS) // buckets


def _summed_cells(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        low, high = _edges(buckets)[bucket : bucket + 2].tolist()
        totals = np.zeros(high - low, dtype=np.int64)
        for data in table.column("data"):
            gaps, times = expand(data.as_py(), "<u4", "<u4")
            totals[np.cumsum(gaps, dtype=np.int64) - low] += times
        # Eight steps for each doubling tell counts apart as far as an order needs.
        ranks = np.minimum(np.log2(np.maximum(totals, 1)) * 8, 255).astype("u1")
        return pa.table({"low": pa.array([low], pa.int64()), "ranks": pa.array([ranks.tobytes()], pa.binary())})

    return run


def word_ranks(docs: DataFrame, buckets: int) -> np.ndarray:
    """How frequent words are, in steps, by the cell of their hash.

    A cell holds the document counts of all its words, so every word of the corpus counts,
    however many there are; words of one cell rank alike. Links do not depend on the ranks,
    only the size of blocks does. The table has a fixed size.
    """
    parts = (
        docs.select("text").mapInArrow(releasing(_document_counts(buckets)), "bucket int, data binary")
        .groupBy("bucket").applyInArrow(_summed_cells(buckets), "low long, ranks binary")
    ).collect()
    table = np.zeros(1 << CELL_BITS, dtype="u1")
    for part in parts:
        ranks = np.frombuffer(bytes(part["ranks"]), dtype="u1")
        table[part["low"] : part["low"] + len(ranks)] = ranks
    return table


class _Listed(dict):
    """Numbers new words in order of arrival and keeps a list of those not yet hashed."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word):
        number = self[word] = len(self)
        self.new.append(word)
        return number


class _Sets:
    """Shingle sets of the documents of a task; remembers the words it has seen for a while."""

    def __init__(self, ranks: np.ndarray | None = None):
        self.ranks = ranks
        self._forget()

    def _forget(self):
        self.numbers = _Listed()
        self.hashes, self.times = np.zeros(1 << 16, dtype=np.uint64), np.zeros(1 << 16, dtype=np.int64)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingle hashes and, with ranks, the rank of their rarest word."""
        if len(self.numbers) > REMEMBERED:
            self._forget()
        codes = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if new := self.numbers.new:
            known = len(self.numbers) - len(new)
            if len(self.numbers) > len(self.hashes):
                more = max(len(self.hashes), len(new))
                self.hashes, self.times = (np.append(x, np.zeros(more, dtype=x.dtype)) for x in (self.hashes, self.times))
            self.hashes[known : len(self.numbers)] = hashes = _hashes(new)
            if self.ranks is not None:
                self.times[known : len(self.numbers)] = self.ranks[_cells(hashes)]
            self.numbers.new = []
        shingles = shingle_hashes(self.hashes[codes])
        if self.ranks is None or not len(shingles):
            return np.unique(shingles), np.zeros(0, dtype=np.int64)
        items, first = np.unique(shingles, return_index=True)
        times = self.times[codes]
        rarest = times[: len(shingles)].copy()
        for j in range(1, min(WIDTH, len(times))):
            np.minimum(rarest, times[j : j + len(shingles)], out=rarest)
        return items, rarest[first]


def _set_id(items: np.ndarray) -> int:
    """A 64-bit hash of a set: equal for equal sets."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(items.tobytes()))))


def _entries(h: np.ndarray, owner: np.ndarray, size: np.ndarray) -> bytes:
    """Prefix shingles in order of their sets: each set once, how many shingles, and their hashes."""
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    times = np.diff(np.r_[first, len(owner)])
    return squeeze(
        (h & np.uint64(0xFFFFFFFF)).astype("<u4"), (h >> np.uint64(32)).astype("u1"),
        owner[first], size[first], times.astype("<u4"),
    )


def _expanded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high, owner, size, times = expand(data, "<u4", "u1", "<i8", "<u4", "<u4")
    h = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
    return h, np.repeat(owner, times), np.repeat(size, times)


SKETCHED = "doc_id {kind}, text_key long, n long, set_id long, bucket int, data binary"


def _sketched(buckets: int, shared, kind: pa.DataType | None = None):
    """A row for each document (size, set and point), and packed rows of prefix shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, seen = _Sets(shared.value), set()
        hashes, owners, sizes, chars = [], [], [], 0

        def close(kind: pa.DataType) -> pa.RecordBatch:
            h = np.concatenate(hashes)
            lengths = [len(x) for x in hashes]
            owner = np.repeat(np.array(owners, dtype="<i8"), lengths)
            size = np.repeat(np.array(sizes, dtype="<u4"), lengths)
            bucket = (h >> np.uint64(40)) % np.uint64(buckets)
            # Sorted, for values that compress; 40 bits of hash besides the bucket only make blocks.
            h = h & np.uint64(SKETCH_MASK)
            order = np.lexsort((h, owner, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
            parts = [(b, order[edges[b] : edges[b + 1]]) for b in range(buckets) if edges[b] < edges[b + 1]]
            rows = len(parts)
            none = pa.nulls(rows, pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.nulls(rows, kind), none, none, none, pa.array([b for b, _ in parts], pa.int32()),
                 pa.array([_entries(h[p], owner[p], size[p]) for _, p in parts], pa.binary())],
                ["doc_id", "text_key", "n", "set_id", "bucket", "data"],
            )

        for batch in batches:
            ns, ids, points = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                items, rarest = sets.of(_word_bytes(text))
                ns.append(len(items))
                ids.append(_set_id(items) if len(items) else None)
                points.append(squeeze(_count_vector(items).astype("<u4")) if len(items) else None)
                if len(items) and ids[-1] not in seen:
                    # Copies inside a task are left out; the set is there already. So is a shingle
                    # with a word of one document only: no other set has it.
                    seen.add(ids[-1])
                    prefix = np.lexsort((items, rarest))[: prefix_length(len(items))]
                    hashes.append(items[prefix[rarest[prefix] > 0]])
                    owners.append(ids[-1])
                    sizes.append(len(items))
                    chars += len(text)
            n = len(ns)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(ids, pa.int64()),
                 pa.nulls(n, pa.int32()), pa.array(points, pa.binary())],
                ["doc_id", "text_key", "n", "set_id", "bucket", "data"],
            )
            if chars >= CHUNK_CHARS:
                yield close(batch.column(0).type)
                seen.clear()
                hashes, owners, sizes, chars = [], [], [], 0
        if hashes:
            yield close(batch.column(0).type)

    return run


def _blocks(table: pa.Table) -> pa.Table:
    """``block, set_id, n``: sets of one bucket that share a prefix shingle, and sizes that allow a link."""
    parts = [_expanded(d.as_py()) for d in table.column("data")]
    h, owner, size = (np.concatenate([p[i] for p in parts]) for i in range(3))
    size = size.astype(np.int64)
    order = np.lexsort((owner, size, h))
    h, owner, size = h[order], owner[order], size[order]
    # The same set may come from several tasks.
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner, size = h[new], owner[new], size[new]
    # A run ends where the shingle changes or the next size is too large for the one before.
    start = np.ones(len(h), dtype=bool)
    start[1:] = (h[1:] != h[:-1]) | (100 * size[:-1] < PERCENT * size[1:])
    run = np.cumsum(start) - 1
    shared = np.bincount(run)[run] > 1
    if not shared.any():
        return pa.table({c: pa.array([], pa.int64()) for c in ("block", "set_id", "n")})
    run, owner, size = run[shared], owner[shared], size[shared]
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    block = np.repeat(np.minimum.reduceat(owner, first), np.diff(np.r_[first, len(run)]))
    order = np.lexsort((owner, block))
    block, owner, size = block[order], owner[order], size[order]
    new = np.r_[True, (block[1:] != block[:-1]) | (owner[1:] != owner[:-1])]
    return pa.table({"block": block[new], "set_id": owner[new], "n": size[new]})


class RTree:
    """A static R-tree over count vectors: upper corners and size ranges, level by level."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Near sizes first, then near in the coordinates that differ most.
        spread = np.argsort(-points.std(axis=0))[:2]
        step = np.floor(np.log2(np.maximum(sizes, 1)) * 8).astype(int)
        self.order = np.lexsort((points[:, spread[1]], points[:, spread[0]], step))
        self.points, self.sizes = points, sizes
        self.levels = []
        upper, low, high = points[self.order], sizes[self.order], sizes[self.order]
        fan = LEAF
        while len(upper) > 1 or not self.levels:
            at = np.arange(0, len(upper), fan)
            upper = np.maximum.reduceat(upper, at, axis=0)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((upper, low, high, fan))
            fan = FAN

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """Rows that may link with a set of that point and size, the best bound first."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, low, high, fan = self.levels[depth]
            fits = (100 * low[nodes] * PERCENT <= 10_000 * size) & (100 * high[nodes] >= PERCENT * size)
            nodes = nodes[fits]
            bound = np.minimum(upper[nodes], point).sum(axis=1)
            nodes = nodes[bound >= least_overlap(size, np.maximum(low[nodes], -(-PERCENT * size // 100)))]
            below = len(self.levels[depth - 1][0]) if depth else len(self.order)
            nodes = (nodes[:, None] * fan + np.arange(fan)).reshape(-1)
            nodes = nodes[nodes < below]
        rows = self.order[nodes]
        bound = np.minimum(self.points[rows], point).sum(axis=1)
        need = least_overlap(size, self.sizes[rows])
        keep = bound >= need
        rows, bound, need = rows[keep], bound[keep], need[keep]
        return rows[np.argsort(need - bound, kind="stable")]


def _count_vector(items: np.ndarray) -> np.ndarray:
    return np.bincount((items >> np.uint64(20)).astype(np.int64) % GROUPS, minlength=GROUPS)


def linked(sets: list[np.ndarray], groups: list[int], sides: list[int]) -> list[tuple[int, int]]:
    """Verified links that connect different groups, as pairs of positions.

    ``groups`` tells which sets are connected already. With ``sides``, sets of one side are
    not compared (that was done); -1 means that a set is compared with all.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    tree = RTree(np.array([_count_vector(s) for s in sets]).reshape(len(sets), GROUPS), sizes)
    parent: dict[int, int] = {g: g for g in groups}

    def root(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    out = []
    for i in range(len(sets)):
        for j in tree.search(tree.points[i], int(sizes[i])).tolist():
            if j <= i or (sides[i] >= 0 and sides[i] == sides[j]):
                continue
            a, b = root(groups[i]), root(groups[j])
            if a == b:
                continue
            overlap = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * overlap >= PERCENT * (int(sizes[i]) + int(sizes[j]) - overlap):
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


ASKED = "block long, part int, other int, side int, set_id long, root long"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``block, part, other, side, set_id, root, n, point`` in order of the first three: those
    that may link with a set of another root and, with sides, of the other side.

    The trees on points alone: most sets that only share a passage go here, before any set is
    moved.
    """
    key, held = None, []
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]

    def kept() -> pa.RecordBatch:
        sides, roots = (np.array([r[i] for r in held], dtype=np.int64) for i in (3, 5))
        sizes = np.array([r[6] for r in held], dtype=np.int64)
        found = set()
        if (roots != roots[0]).any():
            tree = RTree(np.array([expand(r[7], "<u4")[0] for r in held]).astype(np.int64), sizes)
            for i in range(len(held)):
                near = tree.search(tree.points[i], int(sizes[i]))
                near = near[(roots[near] != roots[i]) & ((sides[near] != sides[i]) | (sides[i] < 0))]
                if len(near):
                    found.add(i)
                    found.update(near.tolist())
        rows = [held[i][:6] for i in sorted(found)]
        columns = list(zip(*rows)) if rows else [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["block", "part", "other", "side", "set_id", "root"]
        )

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
            if row[:3] != key:
                if len(held) > 1:
                    yield kept()
                key, held = row[:3], []
            held.append(row)
    if len(held) > 1:
        yield kept()


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``block, part, other, side, set_id, root, words`` in order of the first three: links."""
    key, ids, roots, sides, sets = None, [], [], [], []
    hashed, unpack = _Sets(), zstandard.ZstdDecompressor().decompress

    def links() -> pa.RecordBatch:
        pairs = linked(sets, roots, sides) if len(ids) > 1 else []
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i, _ in pairs], pa.int64()), pa.array([ids[j] for _, j in pairs], pa.int64())],
            ["a", "b"],
        )

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(7)]
        for block, part, other, side, set_id, root, words in zip(*columns):
            if (block, part, other) != key:
                if len(ids) > 1:
                    yield links()
                key, ids, roots, sides, sets = (block, part, other), [], [], [], []
            if ids and ids[-1] == set_id:
                continue
            ids.append(set_id)
            roots.append(root)
            sides.append(side)
            sets.append(hashed.of(unpack(words).split())[0])
    if len(ids) > 1:
        yield links()


def _grouped(rows: DataFrame) -> DataFrame:
    order = ["block", "part", "other"]
    return rows.repartition(partitions(rows.sparkSession), *order).sortWithinPartitions(*order, "set_id")


def _asked(rows: DataFrame, points: DataFrame) -> DataFrame:
    """Those of ``rows`` (as in :data:`ASKED`) that may link by their points; written."""
    joined = rows.join(points, F.col("set_id") == F.col("_set")).select(
        "block", "part", "other", "side", "set_id", "root", "size", "point"
    )
    return cut(_grouped(joined).mapInArrow(releasing(_near), ASKED))


def _bitmap(keys: DataFrame, bit: Column) -> np.ndarray:
    """A bitmap, of fixed size, of the ``bit`` of all rows."""
    maps = keys.select((bit + 1).alias("bit")).groupBy(F.call_function("bitmap_bucket_number", "bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    ).collect()  # at most BITS / 32,768 rows of 4 kB
    bitmap = np.zeros(BITS // 8, dtype=np.uint8)
    for r in maps:
        at = (r["bucket"] - 1) * 4096
        bitmap[at : at + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return bitmap


def _marked(bits: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of the ``bits`` are set."""
    return (marks[bits >> 3] >> (bits & 7).astype("u1") & 1).astype(bool)


def _links(rows: DataFrame, sets: DataFrame, few: bool = False) -> DataFrame:
    """Links inside each ``(block, part, other)`` of ``rows``; ``few`` rows do not move all sets."""
    if few:
        # A set that passes without being asked for meets no row.
        bit = F.pmod(F.xxhash64("set_id"), F.lit(BITS))
        listed = rows.sparkSession.sparkContext.broadcast(_bitmap(rows, bit))

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                wanted = pa.array(_marked(batch.column(2).to_numpy(), listed.value))
                yield batch.select(["set_id", "words"]).filter(wanted)

        sets = sets.withColumn("bit", bit).mapInArrow(asked, "set_id long, words binary")
    joined = rows.join(sets, "set_id").select("block", "part", "other", "side", "set_id", "root", "words")
    return cut(_grouped(joined).mapInArrow(releasing(_searched), "a long, b long"))


def _in_parts(members: DataFrame) -> DataFrame:
    """``members`` (``block, set_id, n``) with ``parts`` of their block and their own ``part``."""
    sizes = members.groupBy(F.col("block").alias("_block")).agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles")
    ).filter("sets > 1").select("_block", F.greatest(
        F.ceil(F.col("sets") / PART_SETS), F.ceil(F.col("shingles") / PART_SHINGLES)
    ).cast("int").alias("parts"))
    return members.join(sizes, F.col("block") == F.col("_block")).drop("_block").withColumn(
        "part", F.pmod(F.xxhash64("set_id"), F.col("parts")).cast("int")
    )


def _with_root(members: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.withColumnRenamed("root", "_root")
    return members.join(known, F.col("set_id") == F.col("node"), "left").withColumn(
        "root", F.coalesce("_root", "set_id")
    ).drop("node", "_root")


def _labelled(docs: DataFrame, buckets: int | None) -> DataFrame:
    """``doc_id, text_key, n, set_id, root``; sets with one root are connected."""
    spark = docs.sparkSession
    small_batches(spark)
    buckets = buckets or max(LEAST_BUCKETS, partitions(spark))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(word_ranks(rows, buckets))
    sketched = cut(rows.mapInArrow(releasing(_sketched(buckets, shared)), SKETCHED.format(kind=kind)))
    documents = sketched.filter("bucket is null").select("doc_id", "text_key", "n", "set_id", "data")

    members = cut(
        sketched.filter("bucket is not null").groupBy("bucket").applyInArrow(_blocks, "block long, set_id long, n long")
        .groupBy("block", "set_id").agg(F.max("n").alias("n"))
    )
    sized = cut(_in_parts(members))
    points = cut(documents.filter("set_id is not null").groupBy(F.col("set_id").alias("_set")).agg(
        F.min(F.struct("text_key", "doc_id")).alias("one"), F.any_value("n").alias("size"), F.any_value("data").alias("point")
    ))
    whole = [F.lit(-1).alias("other"), F.lit(-1).alias("side"), F.col("set_id").alias("root")]
    asked = _asked(sized.select("block", "part", "set_id", *whole), points)
    large = sized.filter("parts > 1")
    # The sets themselves, of one document each, for those that are left. A bitmap of those
    # documents' hashes, of fixed size, keeps the texts where they are: a document that
    # passes without being wanted only adds a set that nothing asks for.
    wanted = asked.select("set_id").union(large.select("set_id")).distinct()
    one = points.join(wanted, F.col("set_id") == F.col("_set"), "left_semi").select("one.*")
    bit = F.pmod(row_key("doc_id", "text_key"), F.lit(BITS))
    listed = spark.sparkContext.broadcast(_bitmap(one, bit))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, pack = _Sets(), zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = np.flatnonzero(_marked(batch.column(1).to_numpy(), listed.value)).tolist()
            words = [w for w in (_word_bytes(batch.column(0)[i].as_py() or "") for i in at) if w]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_set_id(sets.of(w)[0]) for w in words], pa.int64()),
                 pa.array([pack(b" ".join(w)) for w in words], pa.binary())],
                ["set_id", "words"],
            )

    sets = cut(rows.select("text", bit.alias("bit")).mapInArrow(releasing(sets_of), "set_id long, words binary"))
    links = _links(asked, sets)
    roots = components(links)
    if large.limit(1).count():
        # One set of each component of a block, and then parts that still are apart.
        some = _with_root(large, roots).groupBy("block", "root").agg(F.min(F.struct("set_id", "n")).alias("m"))
        some = _in_parts(some.select("block", "m.set_id", "m.n"))
        some = _asked(some.select("block", "part", "set_id", *whole), points)
        links = links.unionByName(_links(some, sets, few=True))
        roots = components(links)
        apart = cut(_with_root(large, roots))
        several = apart.groupBy(F.col("block").alias("_block")).agg(
            F.min("root").alias("low"), F.max("root").alias("high")
        ).filter("low <> high").select("_block")
        pairs = (
            apart.join(several, F.col("block") == F.col("_block"), "left_semi")
            .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("with <> part")
            .select("block", F.least("part", "with").alias("_low"), F.greatest("part", "with").alias("other"),
                    F.col("part").alias("side"), "set_id", "root").withColumnRenamed("_low", "part")
        )
        links = links.unionByName(_links(_asked(pairs, points), sets, few=True))
        roots = components(links)

    return _with_root(documents.drop("data"), roots)


def link_documents(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Two documents link if
    their sets of distinct 4-word shingles have a Jaccard similarity of at least 0.85; a text
    of one to three words is one shingle. ``component_id`` is the smallest id that links
    reach, the own one included.

    A text that is null, empty or without words has an empty set and links with nothing; its
    component is its own id. Repeated rows and equal texts are in one component. Null ids
    count as no id: they take the component's smallest other id, or null. An empty table
    gives an empty result.
    """
    labelled = _labelled(docs, buckets)
    least = labelled.filter("n > 0").groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("least"))
    return labelled.join(least, F.col("root") == F.col("_root"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def keep_one(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row of each group of linked documents, with all columns: the one with the smallest id.

    Null ids come last. Of repeated rows one stays. Texts without words link with nothing and
    all stay.
    """
    boxed = docs.select(
        F.struct("*").alias("row"), "doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_key"),
        F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False)).alias("words"),
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    kept = _labelled(docs, buckets).filter("n > 0").groupBy("root").agg(F.min(order).alias("one")).select(
        F.col("one.id").alias("_id"), F.col("one.key").alias("_key")
    )
    one = boxed.filter("words").join(
        kept, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi"
    ).dropDuplicates(["text_key", "doc_id"])
    return one.select("row.*").unionByName(boxed.filter("not words").select("row.*"))


ORACLE = r"""WITH RECURSIVE w AS (
 SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS words FROM documents),
sh AS (
 SELECT DISTINCT doc_id, CASE WHEN len(words) < 4 THEN array_to_string(words, ' ')
  ELSE words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] || ' ' || words[i + 3] END AS s
 FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
 least(w.doc_id, coalesce((SELECT min(b) FROM reach r WHERE r.a = w.doc_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id"""
