"""Documents as token ids in binary files, in ascending order of ``doc_id``.

The texts are dealt to shards by ranges of ``doc_id``; one task encodes a shard with the
tokenizers library and packs it into pieces of :mod:`dac` files, which Spark writes and
commits like any table. A text is taken in units that begin at a single space after a
character that is no white space. No pre-token reaches over such a place, so the ids of a
text are those of its units. A worker remembers the units it met.

The folder of a piece names its shard, its place in the shard and how many ids it holds, so
the place of every document among all ids follows from the listing; the contents are read
once, by the readers of the documents.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import small_batches
from .common import partitions
from .dac import TokenFile, pack_file
from .packed import Numbered, runs

#: Ids of one file, more only by the rest of its last document.
FILE_IDS = 1 << 22
#: Characters encoded at a time.
SLICE_CHARS = 8_000_000
#: Units a worker remembers the ids of; beyond it, at most half stay: those that came most often.
REMEMBERED = 800_000
#: Units encoded in one call, and those of them that are one text to the library.
CALLED, JOINED = 20_000, 200
#: Files up to which the table of their places (24 bytes each) is broadcast.
BROADCAST_FILES = 100_000

# What any of the pattern languages at work may take for white space.
_SPACES = "\\t-\\r\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff"
_SPACE_BEFORE_SPACE = "[ " + re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", _SPACES) + "] "
_CUT = re.compile(f"(?<=[^ {_SPACES}])(?= )")
# Where units like this stand one after the other, each begins at a cut.
_PLAIN = re.compile(f" [^ ]*[^ {_SPACES}]").fullmatch


class Coder:
    """The ids of units of text. ``special_as_text`` takes the strings of special tokens as text."""

    def __init__(self, model: str, special_as_text: bool):
        # Imported here: only the workers need the library.
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._tokenizer = Tokenizer.from_str(model)
        self._tokenizer.encode_special_tokens = special_as_text
        self._numbers: dict[str, int] = {}
        self._starts, self._sizes, self._uses = np.zeros((3, 0), dtype=np.int64)
        self._flat = np.zeros(0, dtype="<u4")
        self._spaced = self._with_space()

    def _with_space(self) -> np.ndarray | None:
        """Which ids hold a space, if a space always is the first byte of a pre-token."""
        model = self._tokenizer
        if model.normalizer or not model.pre_tokenizer:
            return None
        parts = [p for p, _ in model.pre_tokenizer.pre_tokenize_str(" a b")]
        if parts != ["Ġa", "Ġb"]:
            return None
        vocabulary = model.get_vocab(with_added_tokens=True)
        spaced = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        spaced[[i for token, i in model.get_vocab(with_added_tokens=False).items() if "Ġ" in token]] = True
        return spaced

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def _forget(self) -> None:
        if len(self._sizes) <= REMEMBERED:
            return
        keep = self._uses > np.partition(self._uses, -REMEMBERED // 2)[-REMEMBERED // 2]
        self._numbers = {unit: i for i, unit in enumerate(compress(self._numbers, keep.tolist()))}
        self._flat = self._flat[runs(self._starts[keep], self._sizes[keep])]
        self._sizes, self._uses = self._sizes[keep], self._uses[keep] // 2
        self._starts = np.cumsum(self._sizes) - self._sizes

    def _learn(self, units: list[str]) -> None:
        """Encode new units and remember them."""
        names, parts, sizes = [], [], []
        plain, single = [], []
        for unit in units:
            (plain if self._spaced is not None and _PLAIN(unit) else single).append(unit)
        for at in range(0, len(plain), CALLED):
            texts = [plain[i : i + JOINED] for i in range(at, min(at + CALLED, len(plain)), JOINED)]
            for some, ids in zip(texts, self._ids(["".join(t) for t in texts])):
                # A unit has one space, and it is in its first id.
                begins = np.flatnonzero(self._spaced[ids])
                if len(begins) == len(some):
                    names += some
                    parts.append(ids)
                    sizes.append(np.diff(begins, append=len(ids)))
                else:
                    single += some
        for at in range(0, len(single), CALLED):
            found = self._ids(single[at : at + CALLED])
            names += single[at : at + CALLED]
            parts += found
            sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
        self._numbers.update(zip(names, range(len(self._sizes), len(self._sizes) + len(names))))
        self._flat = np.concatenate([self._flat, *parts])
        self._sizes = np.concatenate([self._sizes, *sizes])
        self._starts = np.cumsum(self._sizes) - self._sizes
        self._uses = np.append(self._uses, np.zeros(len(names), dtype=np.int64))

    def ids(self, units: list[str], times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in which each unit has a start and a size; ``times`` tells how often each comes.

        ``units`` are all different.
        """
        self._forget()
        numbers = np.fromiter(map(self._numbers.get, units, repeat(-1)), dtype=np.int64, count=len(units))
        new = np.flatnonzero(numbers < 0).tolist()
        if new:
            self._learn(some := [units[i] for i in new])
            numbers[new] = [self._numbers[u] for u in some]
        self._uses[numbers] += times
        return self._flat, self._starts[numbers], self._sizes[numbers]


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of texts without a space after white space: unit numbers, units per text, the units."""
    split = pc.split_pattern(texts, " ")
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    first = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]
    words = coded.dictionary.to_pylist()
    begins, where = np.unique(codes[first], return_inverse=True)
    # A word that only begins texts is no unit with a space before it; it stays unused.
    units = [" " + w for w in words] + [words[n] for n in begins.tolist()]
    codes[first] = len(words) + where
    return codes, np.diff(offsets), units


def _encode(coder: Coder, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in a row, and how many each has."""
    odd = pc.match_substring_regex(texts, _SPACE_BEFORE_SPACE).to_numpy(zero_copy_only=False)
    if odd.any():
        return _encode_odd(coder, texts, odd)
    codes, per_text, units = _units(texts)
    flat, starts, sizes = coder.ids(units, np.bincount(codes, minlength=len(units)))
    sizes = sizes[codes]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bounds = np.concatenate([[0], np.cumsum(per_text)])
    return flat[runs(starts[codes], sizes)], np.diff(ends[bounds])


def _encode_odd(coder: Coder, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same where some texts have a space after white space: their units are cut one by one."""
    found = {}
    for i in np.flatnonzero(odd).tolist():
        numbers = Numbered()
        codes = np.array([numbers[u] for u in _CUT.split(texts[i].as_py())], dtype=np.int64)
        flat, starts, sizes = coder.ids(list(numbers), np.bincount(codes))
        found[i] = flat[runs(starts[codes], sizes[codes])]
    counts = np.zeros(len(texts), dtype=np.int64)
    even = np.zeros(0, dtype="<u4")
    if not odd.all():
        even, counts[~odd] = _encode(coder, texts.filter(pa.array(~odd)))
    parts, at = [], 0
    for i, n in enumerate(counts.tolist()):
        parts.append(found[i] if i in found else even[at : at + n])
        at += n
        counts[i] = len(parts[-1])
    return np.concatenate(parts), counts


def _slices(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``most`` bytes; a longer text comes alone."""
    start = size = 0
    for at, length in enumerate(lengths):
        if at > start and size + length > most:
            yield start, at
            start, size = at, 0
        size += length
    if start < len(lengths):
        yield start, len(lengths)


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Small batches of ``doc_id, text`` together, up to ``most`` bytes of text."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.column(1).nbytes > most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
        held.append(batch)
        size += batch.column(1).nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _packed(model, special_as_text: bool, end_id: int | None, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A worker holds one copy of a broadcast value, so what is kept there outlives the task.
        memory = model.value
        if "coder" not in memory:
            memory["coder"] = Coder(memory["model"], special_as_text)
        coder = memory["coder"]
        shard, piece, before = TaskContext.get().partitionId(), 0, 0
        held, counts, names, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(held)
            data = pack_file(ids, np.concatenate(counts), pa.concat_arrays(names), shard, piece, before)
            return pa.RecordBatch.from_arrays(
                [pa.array([data], pa.binary()), pa.array([shard], pa.int64()),
                 pa.array([piece], pa.int64()), pa.array([len(ids)], pa.int64())],
                ["data", "shard", "piece", "n_ids"],
            )

        for some in _gathered(batches, SLICE_CHARS):
            doc_ids, texts = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in some.columns)
            texts = pc.fill_null(texts, "")
            for a, b in _slices(pc.binary_length(texts).to_pylist(), SLICE_CHARS):
                ids, n = _encode(coder, texts.slice(a, b - a))
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), np.uint32(end_id))
                    n = n + 1
                held.append(ids)
                counts.append(n)
                names.append(doc_ids.slice(a, b - a))
                size += len(ids)
                if size >= file_ids:
                    yield close()
                    piece, before = piece + 1, before + size
                    held, counts, names, size = [], [], [], 0
        if counts:
            yield close()

    return run


def write_token_files(
    docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None,
    special_as_text: bool = True, file_ids: int = FILE_IDS, shards: int | None = None,
) -> None:
    """Encode every text and write the ids to ``path``, in ascending order of ``doc_id``.

    ``docs`` needs ``doc_id`` (any type that has an order) and ``text``; other columns are
    ignored. ``tokenizer`` is a file of the tokenizers library that the driver reads; its
    pre-tokens must not reach from a character that is no white space over a space after it,
    as those of byte-level models do not. ``end_id`` follows each document.

    A null or empty text has no ids but the end. Null ids come first. Rows of one id are
    ordered by a hash of the text; repeated rows stay. An empty table leaves a folder
    without files of ids. A document is never cut between files: its ids must fit in one
    binary value (2 GB).

    There are as many shards as the input has splits, or shuffle partitions if those are
    more. Ranges are bounds of (id, hash, row), so many rows of one id span shards too.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer, encoding="utf-8") as lines:
        model = spark.sparkContext.broadcast({"model": lines.read()})
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"))
    shards = shards or max(partitions(spark), rows.rdd.getNumPartitions())
    order = ["doc_id", "_hash", "_row"]
    placed = (
        rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
        .repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    )
    files = placed.mapInArrow(
        _packed(model, special_as_text, end_id, file_ids),
        "data binary, shard long, piece long, n_ids long",
    )
    # The text writer puts out the bytes of a string as they are, and one line end after them.
    (
        files.withColumn("data", F.col("data").cast("string"))
        .write.partitionBy("shard", "piece", "n_ids").text(path)
    )


def list_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``shard, piece, n_ids, start`` of every file, from the listing; ``start`` counts the ids before it."""
    found = spark.read.format("binaryFile").load(path)
    if "shard" not in found.columns:  # nothing was written
        return spark.createDataFrame([], "shard long, piece long, n_ids long, start long")
    files = found.select(*[F.col(c).cast("long") for c in ("shard", "piece", "n_ids")])
    before = (Window.unboundedPreceding, -1)
    # One row per shard, then the pieces of each shard.
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("_n")).select(
        "shard", F.sum("_n").over(Window.orderBy("shard").rowsBetween(*before)).alias("_before")
    )
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("piece").rowsBetween(*before))
    return files.withColumn("_inside", inside).join(shards, "shard").select(
        "shard", "piece", "n_ids",
        (F.coalesce("_before", F.lit(0)) + F.coalesce("_inside", F.lit(0))).alias("start"),
    )


def read_token_files(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files under ``path``.

    ``start`` counts the ids of all documents before it, ``ids`` holds its own as
    little-endian 32-bit numbers. ``kind`` is the type of ``doc_id``.
    """
    schema = f"doc_id {kind}, start long, n_tokens long, ids binary"
    places = list_token_files(spark, path)
    many = places.limit(BROADCAST_FILES + 1).count()
    if not many:
        return spark.createDataFrame([], schema)
    places = F.broadcast(places) if many <= BROADCAST_FILES else places
    files = spark.read.format("binaryFile").load(path).select(
        F.col("shard").cast("long"), F.col("piece").cast("long"), "content"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column(0), batch.column(1).to_pylist()):
                file = TokenFile(content.as_buffer())
                bounds, ids = file.starts().astype(np.int64), file.tokens(0, file.n_ids).tobytes()
                cuts = zip(bounds[:-1].tolist(), bounds[1:].tolist())
                yield pa.RecordBatch.from_arrays(
                    [file.doc_ids(), pa.array(bounds[:-1] + start, pa.int64()),
                     pa.array(np.diff(bounds), pa.int64()),
                     pa.array([ids[4 * a : 4 * b] for a, b in cuts], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    joined = files.join(places, ["shard", "piece"]).select("content", "start")
    return joined.mapInArrow(run, schema)


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """``place, token``: the ids at some places among all ids (null beyond the end or before 0).

    ``places`` has a column ``place``. Each file with a place in it is opened once, and only
    the bytes of the wanted ids are decoded.
    """
    files = list_token_files(spark, path)
    wanted = places.select(F.col("place").cast("long")).distinct()
    # Files and places meet in cells of equally many ids.
    width = F.expr(f"place div {FILE_IDS}")
    ranges = files.filter("n_ids > 0").select(
        "shard", "piece", "start", "n_ids",
        F.explode(F.expr(f"sequence(start div {FILE_IDS}, (start + n_ids - 1) div {FILE_IDS})")).alias("_cell"),
    )
    found = wanted.withColumn("_cell", width).join(ranges, "_cell").filter(
        "place >= start and place < start + n_ids"
    )
    asked = found.groupBy("shard", "piece", "start").agg(F.sort_array(F.collect_list("place")).alias("places"))
    contents = spark.read.format("binaryFile").load(path)
    if "shard" not in contents.columns:
        return wanted.select("place", F.lit(None).cast("long").alias("token"))
    contents = contents.select(F.col("shard").cast("long"), F.col("piece").cast("long"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start, some in zip(*map(batch.column, range(2)), batch.column(2).to_pylist()):
                file, start = TokenFile(content.as_buffer()), start.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int64()),
                     pa.array([file.token(p - start) for p in some], pa.int64())],
                    ["place", "token"],
                )

    read = contents.join(asked, ["shard", "piece"]).select("content", "start", "places")
    return wanted.join(read.mapInArrow(run, "place long, token long"), "place", "left")
