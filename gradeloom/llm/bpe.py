"""Byte-level BPE by a global shuffle of distinct words.

Pre-tokens repeat a great deal, so each task first turns its documents into chunks: the
distinct pre-tokens of a chunk, and for every position the number of its pre-token. Distinct
pre-tokens go to hash buckets, where all chunks' copies of one word meet and are encoded
once; the ids go back to the chunks and are put in place by position. Between tasks a chunk
is one row of positions and one row for each bucket, all compressed, so the shuffles carry
far less than the texts. The frequent words of a chunk have small numbers.

Decoding sends the distinct ids of a batch of documents ahead of them, joins the table of
token bytes (one row for each id of the vocabulary, so it is broadcast) and puts the bytes
together by position. The join leaves the rows of a task where they are, so nothing is
shuffled; a document whose ids have not come before it fails the task.

Chunks must be whole: the positions' row tells how many bucket rows belong to it, and a
chunk that lacks some (a lost task that was run again over other rows) fails the task
instead of giving a wrong result. Input read from files always repeats.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import small_batches
from .common import partitions
from .packed import (
    CODE_TYPES, Numbered, code_streams, codes_of, expand, expand_words, in_slices,
    release, releasing, runs, squeeze, squeeze_words,
)

#: Least number of hash buckets for words.
LEAST_BUCKETS = 64
#: Words a task remembers the ids of; beyond it the memory is emptied and words are encoded again.
REMEMBERED = 200_000
#: Characters of one chunk of documents; a longer text is a chunk of its own.
CHUNK_CHARS = 8_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a ``.tiktoken`` vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, lines))}


def _chunked(pattern: str, buckets: int):
    def close(numbers: Numbered, codes: array, counts: list[int], ids: list, chunk: int):
        raw = np.frombuffer(codes, dtype="<u4")
        words = list(numbers)
        order = np.argsort(-np.bincount(raw, minlength=len(words)), kind="stable")
        place = np.empty(len(words), dtype=np.int64)
        held: list[list[bytes]] = [[] for _ in range(buckets)]
        for number in order.tolist():
            word = words[number].encode("utf-8", "surrogatepass")
            bucket = zlib.crc32(word) % buckets
            place[number] = len(held[bucket]) * buckets + bucket
            held[bucket].append(word)
        full = [b for b in range(buckets) if held[b]]
        rows = [(chunk, b, len(full), squeeze_words(held[b])) for b in full]
        positions = squeeze(np.array(counts, dtype="<i8"), *code_streams(place[raw]))
        place = place.astype(np.min_scalar_type(int(place.max(initial=0))))
        # The row of positions only passes the encoding tasks, spread by chunk.
        rows.append((chunk, -1 - zlib.crc32(b"%d" % chunk) % buckets, len(full), positions))
        a, b, c, d = zip(*rows)
        none = pa.nulls(len(rows) - 1, ids[0].type)
        known = pa.concat_arrays([none, pa.ListArray.from_arrays([0, len(counts)], pa.concat_arrays([i.values for i in ids]))]) if ids else None
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int32()),
             pa.array(d, pa.binary()), known],
            ["chunk", "place", "rows", "data", "doc_ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern)
        chunk = TaskContext.get().partitionId() << 32
        numbers, codes, counts, ids, chars = Numbered(), array("I"), [], [], 0
        for batch in batches:
            texts = batch.column(1)
            for at in range(len(texts)):
                text = texts[at].as_py() or ""
                before = len(codes)
                if len(text) <= CHUNK_CHARS:
                    codes.extend(map(numbers.__getitem__, find.findall(text)))
                else:
                    for part in in_slices(m.group() for m in find.finditer(text)):
                        codes.extend(map(numbers.__getitem__, part))
                counts.append(len(codes) - before)
                ids.append(pa.ListArray.from_arrays([0, 1], batch.column(0).slice(at, 1)))
                chars += len(text)
                if chars >= CHUNK_CHARS:
                    yield close(numbers, codes, counts, ids, chunk)
                    chunk += 1
                    numbers, codes, counts, ids, chars = Numbered(), array("I"), [], [], 0
                    release()
        if counts:
            yield close(numbers, codes, counts, ids, chunk)

    return run


def _encoded(pattern: str, ranks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding(
            "words", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={}
        )
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for place, data in zip(batch.column(1).to_pylist(), batch.column(3)):
                if place < 0:
                    out.append(data.as_py())
                    continue
                words = expand_words(data.as_py())
                if len(known) > REMEMBERED:
                    known.clear()
                for word in words:
                    if word not in known:
                        known[word] = np.array(
                            coder._encode_single_piece(word), dtype="<u4"
                        ).tobytes()
                found = [known[w] for w in words]
                counts = np.fromiter(map(len, found), dtype="<u4", count=len(found)) // 4
                out.append(squeeze(counts, np.frombuffer(b"".join(found), dtype="<u4")))
            yield batch.set_column(3, "data", pa.array(out, pa.binary()))

    return run


def _assembled(buckets: int):
    """Per chunk: the documents' ids in order, as (doc_id, binary of 32-bit ids)."""

    def run(table: pa.Table) -> pa.Table:
        places = table.column("place").to_pylist()
        at = [i for i, p in enumerate(places) if p < 0]
        if len(at) != 1 or len(places) - 1 != table.column("rows")[at[0]].as_py():
            raise RuntimeError("a chunk of documents is not whole; read the documents from files")
        data = table.column("data")
        counts, *streams = expand(data[at[0]].as_py(), "<i8", *CODE_TYPES)
        codes = codes_of(*streams)
        parts = {p: expand(data[i].as_py(), "<u4", "<u4") for i, p in enumerate(places) if p >= 0}
        # Code = position in the bucket * buckets + bucket.
        width = max((len(n) for n, _ in parts.values()), default=0)
        lengths = np.zeros((width, buckets), dtype=np.int64)
        starts = np.zeros((width, buckets), dtype=np.int64)
        base = 0
        for bucket, (n, flat) in parts.items():
            lengths[: len(n), bucket] = n
            starts[: len(n), bucket] = base + np.cumsum(n, dtype=np.int64) - n
            base += len(flat)
        flat = np.concatenate([f for _, f in parts.values()] or [np.zeros(0, dtype="<u4")])
        lengths, starts = lengths.reshape(-1), starts.reshape(-1)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        texts = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            texts.append(flat[runs(starts[codes[a:b]], lengths[codes[a:b]])].astype("<u4").tobytes())
        n_tokens = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) // 4
        doc_ids = table.column("doc_ids")[at[0]].values
        return pa.table({
            "doc_id": doc_ids, "n_tokens": pa.array(n_tokens, pa.int64()),
            "ids": pa.array(texts, pa.binary()),
        })

    return run


def _encoded_chunks(docs: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """Rows of chunks, by bucket: the ids of their distinct pre-tokens, and the positions."""
    spark = docs.sparkSession
    small_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"chunk long, place int, rows int, data binary, doc_ids array<{kind}>"
    return (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .mapInArrow(releasing(_chunked(pattern, buckets)), schema)
        .repartition(partitions(spark), "place")
        .mapInArrow(releasing(_encoded(pattern, ranks)), schema)
    )


def _buckets(docs: DataFrame) -> int:
    return max(LEAST_BUCKETS, partitions(docs.sparkSession))


def encode_documents(docs: DataFrame, path: str, pattern: str, buckets: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids``: the token ids of every text as little-endian 32-bit numbers.

    ``docs`` needs ``doc_id`` (any type) and ``text``; other columns are ignored. ``path`` is
    a ``.tiktoken`` file that the driver reads; each match of ``pattern`` is encoded on its
    own, without special tokens.

    A null or empty text has no ids. Null ids and repeated rows come back as they are, one
    row each. An empty table gives an empty result. Very long texts are cut into matches
    piece by piece; a document's ids must fit in one value (2 GB).
    """
    buckets = buckets or _buckets(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return _encoded_chunks(docs, path, pattern, buckets).groupBy("chunk").applyInArrow(
        _assembled(buckets), f"doc_id {kind}, n_tokens long, ids binary"
    )


def token_table(spark: SparkSession, path: str) -> DataFrame:
    """``id, bytes`` of the vocabulary."""
    rows = [(i, bytearray(b)) for b, i in read_ranks(path).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def _asking(heads: pa.StructArray) -> tuple[pa.Array, pa.Array]:
    """Columns ``head, token``: a row for each distinct id of the documents, then the documents."""
    ids = heads.field("ids")
    found = set()
    for value in ids:
        found.update(np.unique(np.frombuffer(value.as_py() or b"", dtype="<u4")).tolist())
    tokens = pa.array(sorted(found), pa.int64())
    return (
        pa.concat_arrays([pa.nulls(len(tokens), heads.type), heads]),
        pa.concat_arrays([tokens, pa.nulls(len(heads), pa.int64())]),
    )


def _asked_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*_asking(batch.column(0))], ["head", "token"])


def _assembled_asking(buckets: int):
    assemble = _assembled(buckets)

    def run(table: pa.Table) -> pa.Table:
        heads = assemble(table).to_struct_array().combine_chunks()
        out = pa.table(dict(zip(("head", "token"), _asking(heads))))
        del heads
        release()
        return out

    return run


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows ``head, token, bytes``: the documents, with the bytes of their ids in one value.

    The bytes of an id are the same wherever it occurs, so they are kept; there are no more
    than the vocabulary has.
    """
    known: dict[int, bytes] = {}
    for batch in batches:
        heads, tokens, found = batch.columns
        asked = np.flatnonzero(tokens.is_valid().to_numpy(zero_copy_only=False))
        at = pa.array(asked)
        if (words := found.take(at)).null_count:
            raise ValueError("an id that the token table does not hold")
        known.update(zip(tokens.take(at).to_pylist(), words.to_pylist()))
        heads = heads.take(pa.array(np.setdiff1d(np.arange(len(batch)), asked)))
        if not len(heads):
            continue
        decoded = [
            b"".join(map(known.__getitem__, np.frombuffer(v.as_py() or b"", dtype="<u4").tolist()))
            for v in heads.field("ids")
        ]
        names = [heads.type.field(i).name for i in range(heads.type.num_fields)]
        yield pa.RecordBatch.from_arrays(
            [*heads.flatten(), pa.array(decoded, pa.binary())], [*names, "decoded"]
        )


def _with_bytes(asking: DataFrame, path: str) -> DataFrame:
    """From ``head, token``: the columns of ``head`` and ``decoded``."""
    small_batches(asking.sparkSession)
    table = token_table(asking.sparkSession, path)
    names = asking.schema["head"].dataType
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names)
    return (
        asking.join(F.broadcast(table), F.col("token") == F.col("id"), "left")
        .select("head", "token", "bytes").mapInArrow(releasing(_put_together), f"{schema}, decoded binary")
    )


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes of all ``ids`` in order, and drop nothing.

    The token table has a row for each id of the vocabulary and is broadcast. An unknown id
    fails the task. Null ids decode to empty bytes; repeated rows all come back.
    """
    boxed = encoded.select(F.struct("*").alias("head"))
    kind = boxed.schema["head"].dataType.simpleString()
    return _with_bytes(boxed.mapInArrow(_asked_batches, f"head {kind}, token long"), path)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded again."""
    buckets = _buckets(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    # The chunk that puts a document's ids in place asks for their bytes as well.
    asking = _encoded_chunks(docs, path, pattern, buckets).groupBy("chunk").applyInArrow(
        _assembled_asking(buckets),
        f"head struct<doc_id: {kind}, n_tokens: bigint, ids: binary>, token long",
    )
    return _with_bytes(asking, path).select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
