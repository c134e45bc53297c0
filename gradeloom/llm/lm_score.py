"""Cross-entropy difference of two matched bigram models.

The target model counts the documents of good quality, the background model all others.
Both have the same vocabulary (every word that all documents together hold at least twice,
so it grows with them; the rest is one unknown word), the same smoothing and the same
formula, so a document's score, its loss per token under the target model minus that under
the background model, compares like with like. A document's own counts are taken out of its own model first, so that no document is
scored by a model that has seen it.

    p(w)     = (c(w) + 1) / (N + V)                 with V words, the unknown one included
    p(w | v) = (c(v, w) + M * p(w)) / (c(v) + M)    with c(v) = times v has a successor

All documents are read once, where they are, and kept as chunks (distinct words by hash and
the number of the word at every position). Only their ids meet the labels; each chunk gets
the places of its target documents. Word counts, and then bigram counts, go from the chunks to
hash buckets, one packed row for each pair of chunk and bucket, where the counts of the
whole corpus meet. The word buckets number the words of the vocabulary and send each chunk
number and corpus counts of the words it asked for; the bigram buckets do the same for its
bigrams. So no table of words or bigrams is ever gathered or broadcast, only their totals.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import partitions
from .packed import CHUNK_CHARS, CODE_TYPES, Numbered, code_streams, codes_of, expand, squeeze

#: A word seen so often in all documents belongs to the vocabulary.
LEAST_SEEN = 2
#: Number of the start of a document among the numbers of words; 0 is the unknown word.
START = 2**32 - 1
LONGS = np.iinfo(np.int64)
#: Weight of the word model in the bigram model, in tokens.
M = 50.0
LEAST_BUCKETS = 64
#: Positions of a row of packed counts: target and background.
TARGET, BACKGROUND = 0, 1
#: In place of a bucket: a chunk itself, and the places of its target documents.
CHUNK, FLAGS = -1, -2


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents ``doc_id, text`` as chunks."""
    chunk = TaskContext.get().partitionId() << 32

    def close(numbers: Numbered, codes: array, counts: list, ids: list) -> pa.RecordBatch:
        raw = np.frombuffer(codes, dtype="<u4")
        times = np.bincount(raw, minlength=len(numbers))
        order = np.argsort(-times, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), dtype="<u8", count=len(numbers))
        data = squeeze(np.array(counts, dtype="<i8"), hashes[order], *code_streams(rank[raw]))
        doc_ids = pa.ListArray.from_arrays([0, len(ids)], pa.concat_arrays(ids))
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([data], pa.binary()), doc_ids],
            ["chunk", "data", "doc_ids"],
        )

    numbers, codes, counts, ids, chars = Numbered(), array("I"), [], [], 0
    for batch in batches:
        for at, text in enumerate(batch.column(1)):
            text = text.as_py() or ""
            before = len(codes)
            codes.extend(map(numbers.__getitem__, text.lower().encode("utf-8", "surrogatepass").split()))
            counts.append(len(codes) - before)
            ids.append(batch.column(0).slice(at, 1))
            chars += len(text)
            if chars >= CHUNK_CHARS:
                yield close(numbers, codes, counts, ids)
                chunk += 1
                numbers, codes, counts, ids, chars = Numbered(), array("I"), [], [], 0
    if counts:
        yield close(numbers, codes, counts, ids)


CHUNK_TYPES = ("<i8", "<u8", *CODE_TYPES)


def _opened(data: bytes, places: list[int] | None):
    """Document lengths, flags, word hashes, words by position, and the document of each position.

    ``places`` are those of the target documents in the chunk.
    """
    counts, hashes, *streams = expand(data, *CHUNK_TYPES)
    codes, good = codes_of(*streams), np.zeros(len(counts), dtype=bool)
    good[places or []] = True
    return counts, good, hashes, codes, np.repeat(np.arange(len(counts)), counts)


def _per_bucket(chunk: int, bucket: np.ndarray, buckets: int, *columns: np.ndarray):
    """Rows ``chunk, bucket, data`` with the columns' values of each bucket, in order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        part = order[edges[b] : edges[b + 1]]
        if len(part):
            yield chunk, b, squeeze(*[c[part] for c in columns])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    chunk, bucket, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(data, pa.binary())],
        ["chunk", "bucket", "data"],
    )


def _planes(values: np.ndarray) -> np.ndarray:
    """Numbers as their first bytes, then their second bytes and so on, which compress better."""
    return np.ascontiguousarray(values).view("u1").reshape(len(values), values.itemsize).T


def _joined(planes: np.ndarray, kind: str) -> np.ndarray:
    """The numbers that :func:`_planes` took apart."""
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _own_words(counts: np.ndarray, good: np.ndarray, codes: np.ndarray, doc: np.ndarray, n: int) -> list[np.ndarray]:
    """A chunk's occurrences and occurrences without a successor of its ``n`` words, in both corpora.

    The latter are nearly all 0, so they take hardly any bytes.
    """
    last = np.cumsum(counts)[counts > 0] - 1
    columns = []
    for corpus in (good, ~good):
        times = np.bincount(codes[corpus[doc]], minlength=n)
        ends = np.bincount(codes[last[corpus[counts > 0]]], minlength=n)
        columns += [times.astype("<u4"), ends.astype("<u4")]
    return columns


def _word_counts(buckets: int):
    """Per chunk and bucket: word hash, occurrences and occurrences without a successor, in both corpora."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                counts, good, hashes, codes, doc = _opened(data.as_py(), places.as_py())
                columns = _own_words(counts, good, codes, doc, len(hashes))
                yield _batch(list(_per_bucket(chunk, hashes % np.uint64(buckets), buckets, hashes, *columns)))

    return run


def _met(table: pa.Table):
    """One bucket's words, their corpus counts, and of each chunk's row the places of its words and its counts."""
    parts = [expand(d.as_py(), "<u8", "<u4", "<u4", "<u4", "<u4") for d in table.column("data")]
    hashes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = [
        np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(hashes)).astype(np.int64)
        for i in range(1, 5)
    ]
    ends = np.cumsum([0] + [len(p[0]) for p in parts]).tolist()
    rows = [(at[a:b], p[1:]) for a, b, p in zip(ends[:-1], ends[1:], parts)]
    return hashes.astype("<i8"), sums, rows


def _top_words(limit: int):
    """The ``limit`` most frequent words of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        words, sums, _ = _met(table)
        both = sums[0] + sums[2]
        top = np.lexsort((words, -both))[:limit]
        return pa.table({"word": pa.array(words[top], pa.int64()), "n": pa.array(both[top], pa.int64())})

    return run


def _with_next(sums: list[int]) -> list[int]:
    """Occurrences and occurrences with a successor, from :func:`_own_words`' sums."""
    return [sums[0], sums[0] - sums[1], sums[2], sums[2] - sums[3]]


def _numbers(buckets: int, least: int, last: int):
    """Per chunk, in the order it asked: each word's number and its counts in all other chunks.

    Known are the words seen more than ``least`` times, and of those seen ``least`` times the
    ones up to ``last``. One more row has the sums of the bucket: its known words, their four
    counts, and the four counts of all words.
    """

    def run(table: pa.Table) -> pa.Table:
        words, sums, rows = _met(table)
        bucket = table.column("bucket")[0].as_py()
        both = sums[0] + sums[2]
        known = np.flatnonzero((both > least) | ((both == least) & (words <= last)))
        known = known[np.argsort(-both[known], kind="stable")]
        if len(known) * buckets >= START:
            raise ValueError("more words than numbers")
        ids = np.zeros(len(words), dtype="<u4")
        ids[known] = np.arange(len(known)) * buckets + bucket + 1
        data = [
            squeeze(_planes(ids[at]), *[
                _planes(np.where(ids[at] > 0, s[at] - own, 0).astype("<i8")) for s, own in zip(sums, owns)
            ]) for at, owns in rows
        ]
        inside, totals = ([int(s[some].sum()) for s in sums] for some in (known, slice(None)))
        totals = [len(known), *_with_next(inside), *_with_next(totals)]
        return pa.table({
            "chunk": pa.array([*table.column("chunk").to_pylist(), -1 - bucket], pa.int64()),
            "bucket": pa.array([bucket] * (len(rows) + 1), pa.int32()),
            "data": pa.array([*data, None], pa.binary()),
            "sums": pa.array([None] * len(rows) + [totals], pa.list_(pa.int64())),
        })

    return run


def _numbered(buckets: int):
    """One chunk and the answers to its words as a chunk of known words; 0 is the code of all others."""

    def run(table: pa.Table) -> pa.Table:
        places, data = table.column("bucket").to_pylist(), table.column("data")
        if table.column("chunk")[0].as_py() < 0:
            return table.select(["chunk", "data", "doc_ids", "sums"])
        at = places.index(CHUNK)
        flags = [i for i, p in enumerate(places) if p == FLAGS]
        good = table.column("sums")[flags[0]].as_py() if flags else None
        counts, good, hashes, codes, doc = _opened(data[at].as_py(), good)
        ids, sums = np.zeros(len(hashes), dtype="<u4"), np.zeros((4, len(hashes)), dtype="<i8")
        bucket = hashes % np.uint64(buckets)
        for i, p in enumerate(places):
            if p >= 0:
                words = np.flatnonzero(bucket == np.uint64(p))
                number, *others = expand(data[i].as_py(), *["u1"] * 5)
                ids[words] = _joined(number, "<u4")
                sums[:, words] = [_joined(o, "<i8") for o in others]
        sums += np.array(_own_words(counts, good, codes, doc, len(hashes)), dtype="<i8").reshape(4, -1)
        known = ids > 0
        packed = squeeze(
            counts, good.astype("u1"), _planes(ids[known]), *[_planes(s[known]) for s in sums],
            *code_streams((np.cumsum(known) * known)[codes]),
        )
        return pa.table({
            "chunk": table.column("chunk").slice(at, 1), "data": pa.array([packed], pa.binary()),
            "doc_ids": table.column("doc_ids").slice(at, 1), "sums": table.column("sums").slice(at, 1),
        })

    return run


NUMBERED_TYPES = ("<i8", "u1", *["u1"] * 5, *CODE_TYPES)


def _bigrams(data: bytes):
    """Document lengths, flags, numbers and counts of known words, codes by position, codes before.

    The unknown word has the first code and the start of a document the last one.
    """
    counts, good, ids, *rest = expand(data, *NUMBERED_TYPES)
    codes, sums = codes_of(*rest[4:]), np.array([_joined(s, "<i8") for s in rest[:4]])
    ids = np.concatenate([[0], _joined(ids, "<u4"), [START]]).astype(np.uint64)
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[(np.cumsum(counts) - counts)[counts > 0]] = len(ids) - 1
    sums[1::2] = sums[::2] - sums[1::2]
    return counts, good.astype(bool), ids, sums, codes, before


def _asks(counts: np.ndarray, good: np.ndarray, ids: np.ndarray, codes: np.ndarray, before: np.ndarray):
    """A chunk's different bigrams, the one at each position, and their counts in both corpora."""
    keys, at = np.unique((ids[before] << np.uint64(32)) | ids[codes], return_inverse=True)
    of = np.repeat(good, counts)
    return keys, at, [np.bincount(at[c], minlength=len(keys)).astype("<u4") for c in (of, ~of)]


def _key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)


def _asked(buckets: int):
    """Per chunk and bucket: the chunk's different bigrams and their counts in both corpora."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts, good, ids, _, codes, before = _bigrams(data.as_py())
                keys, _, own = _asks(counts, good, ids, codes, before)
                bucket = _key_bucket(keys, buckets)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for b in range(buckets):
                    part = order[edges[b] : edges[b + 1]]
                    if len(part):
                        # Sorted, so the words before differ little from one bigram to the next.
                        first, second = keys[part] >> np.uint64(32), keys[part] & np.uint64(START)
                        steps = np.diff(first, prepend=np.uint64(0)).astype("<u4")
                        columns = [steps, second.astype("<u4"), *[o[part] for o in own]]
                        rows.append((chunk, b, squeeze(*map(_planes, columns))))
                yield _batch(rows)

    return run


def _answered(table: pa.Table) -> pa.Table:
    """Counts of one bucket's bigrams in all other chunks, for each chunk in the order it asked."""
    parts = [[_joined(c, "<u4") for c in expand(d.as_py(), *["u1"] * 4)] for d in table.column("data")]
    asked = [(np.cumsum(p[0], dtype=np.uint64) << np.uint64(32)) | p[1] for p in parts]
    keys, at = np.unique(np.concatenate(asked), return_inverse=True)
    ends = np.cumsum([0] + [len(a) for a in asked]).tolist()
    sums = [
        np.bincount(at, weights=np.concatenate([p[i] for p in parts]), minlength=len(keys)).astype(np.int64)
        for i in (2, 3)
    ]
    out = [
        squeeze(*[_planes((s[at[a:b]] - own).astype("<i8")) for s, own in zip(sums, p[2:])])
        for a, b, p in zip(ends[:-1], ends[1:], parts)
    ]
    return table.set_column(table.schema.names.index("data"), "data", pa.array(out, pa.binary()))


def _scored(buckets: int, weight: float, known: int, inside: list[int], totals: list[int]):
    """One chunk's documents and the answers to its bigrams as scores.

    ``known`` words are in the vocabulary; ``inside`` has their counts and ``totals`` those of all words.
    """

    def run(table: pa.Table) -> pa.Table:
        places = table.column("bucket").to_pylist()
        data = table.column("data")
        at = [i for i, p in enumerate(places) if p < 0]
        counts, good, ids, sums, codes, before = _bigrams(data[at[0]].as_py())
        keys, code, pairs = _asks(counts, good, ids, codes, before)
        pairs = np.array(pairs, dtype=np.float64)
        bucket = _key_bucket(keys, buckets)
        for i, p in enumerate(places):
            if p >= 0:
                answer = expand(data[i].as_py(), "u1", "u1")
                pairs[:, np.flatnonzero(bucket == np.uint64(p))] += [_joined(a, "<i8") for a in answer]
        words, nexts = [], []
        for c in (0, 2):
            # Every document with words has one first word and one word without a successor.
            starts = totals[c] - totals[c + 1]
            words.append(np.concatenate([[totals[c] - inside[c]], sums[c]]).astype(np.float64))
            nexts.append(np.concatenate([[totals[c + 1] - inside[c + 1]], sums[c + 1], [starts]]).astype(np.float64))
        tokens, size = [totals[0], totals[2]], known + 1
        losses = np.full((2, len(counts)), np.nan)
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        for d, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            if a == b:
                continue
            own = TARGET if good[d] else BACKGROUND
            _, u_at, u_n = np.unique(codes[a:b], return_inverse=True, return_counts=True)
            _, v_at, v_n = np.unique(before[a:b], return_inverse=True, return_counts=True)
            _, k_at, k_n = np.unique(code[a:b], return_inverse=True, return_counts=True)
            for corpus in (TARGET, BACKGROUND):
                mine = float(corpus == own)
                c_w = words[corpus][codes[a:b]] - mine * u_n[u_at]
                c_v = nexts[corpus][before[a:b]] - mine * v_n[v_at]
                c_vw = pairs[corpus][code[a:b]] - mine * k_n[k_at]
                p_w = (c_w + 1.0) / (tokens[corpus] - mine * (b - a) + size)
                losses[corpus, d] = -np.log((c_vw + weight * p_w) / (c_v + weight)).mean()
        empty = counts == 0
        columns = {"doc_id": table.column("doc_ids")[at[0]].values, "n_tokens": pa.array(counts, pa.int64())}
        for name, values in (
            ("loss_target", losses[TARGET]), ("loss_background", losses[BACKGROUND]),
            ("score", losses[TARGET] - losses[BACKGROUND]),
        ):
            columns[name] = pa.array(values, pa.float64(), mask=empty)
        return pa.table(columns)

    return run


def score_documents(
    docs: DataFrame, labels: DataFrame, vocabulary: int | None = None, weight: float = M,
    buckets: int | None = None,
) -> DataFrame:
    """``doc_id, n_tokens, loss_target, loss_background, score`` of every document.

    ``docs`` needs ``doc_id, text``, ``labels`` needs ``doc_id, quality``; other columns are
    ignored. Documents with a label of quality 1 are the target corpus, all others the
    background. A low score means closer to the target. The vocabulary holds every word seen
    at least ``LEAST_SEEN`` times, or the ``vocabulary`` most frequent words if that is given.

    A text that is null, empty or without words has 0 tokens and null losses. Null ids are
    never labelled; several labels of one id count as 1 if any is. Repeated rows count each.
    Without any target document its model is uniform. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    buckets = buckets or max(LEAST_BUCKETS, n)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    chunks = cut(rows.mapInArrow(_chunked, f"chunk long, data binary, doc_ids array<{kind}>"))
    # Labels grow with the documents, so they are never broadcast: one plan at every size.
    # The texts stay where they are; only ids move.
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    flags = cut(
        chunks.select("chunk", F.posexplode("doc_ids").alias("place", "doc_id"))
        .join(good.hint("merge"), F.col("doc_id") == F.col("_id"))
        .groupBy(F.col("chunk").alias("_chunk")).agg(F.collect_list(F.col("place").cast("long")).alias("places"))
    )
    packed = "chunk long, bucket int, data binary"
    flagged = chunks.join(flags.hint("shuffle_hash"), F.col("chunk") == F.col("_chunk"), "left")
    asked = flagged.select("chunk", "data", "places").mapInArrow(_word_counts(buckets), packed).groupBy("bucket")
    least, last = LEAST_SEEN, LONGS.max
    if vocabulary is not None:
        top = asked.applyInArrow(_top_words(vocabulary), "word long, n long")
        top = top.orderBy(F.col("n").desc(), "word").limit(vocabulary)
        end = top.orderBy("n", F.col("word").desc()).first()
        least, last = (end["n"], end["word"]) if end else (LONGS.max, LONGS.min)
    answers = asked.applyInArrow(_numbers(buckets, least, last), f"{packed}, sums array<long>")
    no_ids = F.lit(None).cast(f"array<{kind}>").alias("doc_ids")
    every = chunks.select(
        "chunk", F.lit(CHUNK).alias("bucket"), "data", "doc_ids", F.lit(None).cast("array<long>").alias("sums")
    ).unionByName(flags.select(
        F.col("_chunk").alias("chunk"), F.lit(FLAGS).alias("bucket"), F.lit(None).cast("binary").alias("data"),
        no_ids, F.col("places").alias("sums"),
    )).unionByName(answers.select("*", no_ids))
    numbered = cut(every.groupBy("chunk").applyInArrow(
        _numbered(buckets), f"chunk long, data binary, doc_ids array<{kind}>, sums array<long>"
    ))
    # In every pair of totals the second one counts words with a successor.
    known, *totals = numbered.filter("chunk < 0").agg(
        *[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0)) for i in range(9)]
    ).first()
    numbered = numbered.filter("chunk >= 0")
    answers = (
        numbered.select("chunk", "data").mapInArrow(_asked(buckets), packed)
        .groupBy("bucket").applyInArrow(_answered, packed)
        .withColumn("doc_ids", F.lit(None).cast(f"array<{kind}>"))
    )
    every = numbered.select("chunk", F.lit(-1).alias("bucket"), "data", "doc_ids").unionByName(answers)
    return every.groupBy("chunk").applyInArrow(
        _scored(buckets, weight, known, totals[:4], totals[4:]),
        f"doc_id {kind}, n_tokens long, loss_target double, loss_background double, score double",
    )
