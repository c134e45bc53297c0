"""Files of token ids in directly addressable codes.

An id is cut into chunks of a few bits, lowest first. Level 1 holds the first chunk of every
id, level 2 the second chunk of those that need one, and so on. A bitmap per level marks the
ids that go on, and a rank directory counts the marks before every stretch of 512, so the
place of an id's next chunk is a count of marks: any id is read from a few bytes, nothing
before it is decoded. The widths of the levels are those that make the file smallest.

File, all numbers little-endian::

    8 bytes       magic
    u64 each      shard, piece, ids before this piece in its shard, documents, ids, levels,
                  place and size of the document ids, place of the starts
    per level     u64 width, codes, place of chunks, place of marks, place of ranks
    sections      document ids (an Arrow IPC stream of one column), starts of the documents
                  (u64, one more than documents), then per level: chunks (width bits each,
                  the first in the lowest bits), marks (lowest bit first), ranks (u32)

What follows the last section does not count.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa

MAGIC = b"IDS-DAC1"
#: Marks between two counts of a rank directory.
STRETCH = 512
#: Most bits of a chunk; eight chunks then fit a 64-bit word.
WIDEST = 8
#: Chunks packed or unpacked at a time.
SLAB = 1 << 19
_FIXED, _LEVEL = "<8s9Q", "<5Q"
_FIXED_SIZE, _LEVEL_SIZE = struct.calcsize(_FIXED), struct.calcsize(_LEVEL)
_ONES = np.array([bin(n).count("1") for n in range(256)], dtype=np.uint8)


def best_widths(ids: np.ndarray) -> list[int]:
    """Chunk widths that take the least space for these ids: a shortest path over the bits.

    A level that begins at bit ``s`` holds every id longer than ``s`` bits.
    """
    top = max(1, int(ids.max(initial=0)).bit_length())
    lengths = np.zeros(top + 1, dtype=np.int64)
    for s in range(top):
        lengths[s] = len(ids) if s == 0 else int((ids >= (1 << s)).sum())
    mark = 1 + 32 / STRETCH
    cost, step = [0.0] * (top + 1), [0] * (top + 1)
    for s in range(top - 1, -1, -1):
        cost[s], step[s] = min(
            (int(lengths[s]) * (w + (mark if s + w < top else 0)) + cost[s + w], w)
            for w in range(1, min(WIDEST, top - s) + 1)
        )
    widths, s = [], 0
    while s < top:
        widths.append(step[s])
        s += step[s]
    return widths


def pack_chunks(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits (at most 8) one after the other, and a spare byte."""
    parts = []
    for at in range(0, len(values), SLAB):
        some = values[at : at + SLAB]
        padded = np.zeros(-(-len(some) // 8) * 8, dtype="u1")
        padded[: len(some)] = some
        words = padded.reshape(-1, 8)
        packed = np.zeros(len(words), dtype="<u8")
        for place in range(8):
            packed |= words[:, place].astype("<u8") << np.uint64(place * width)
        parts.append(packed.view("u1").reshape(-1, 8)[:, :width].reshape(-1))
    return np.concatenate([*parts, np.zeros(1, dtype="u1")])


def unpack_chunks(raw: np.ndarray, width: int) -> np.ndarray:
    """The values of whole groups of eight."""
    groups = len(raw) // width
    out, mask = np.empty((groups, 8), dtype="u1"), np.uint64((1 << width) - 1)
    for at in range(0, groups, SLAB // 8):
        some = raw[at * width : min(groups, at + SLAB // 8) * width].reshape(-1, width)
        padded = np.zeros((len(some), 8), dtype="u1")
        padded[:, :width] = some
        words = padded.reshape(-1).view("<u8")
        for place in range(8):
            out[at : at + len(some), place] = (words >> np.uint64(place * width)) & mask
    return out.reshape(-1)


def _ranks(marks: np.ndarray) -> np.ndarray:
    """Marks set before each stretch, from the packed marks."""
    padded = np.zeros(-(-max(len(marks), 1) // (STRETCH // 8)) * (STRETCH // 8), dtype="u1")
    padded[: len(marks)] = marks
    ones = _ONES[padded].reshape(-1, STRETCH // 8).sum(axis=1, dtype=np.int64)
    return np.concatenate([[0], np.cumsum(ones)]).astype("<u4")


def pack_file(
    ids: np.ndarray, counts: np.ndarray, doc_ids: pa.Array, shard: int = 0, piece: int = 0,
    before: int = 0, widths: list[int] | None = None,
) -> bytes:
    """One file of whole documents: all their ids, and how many each has."""
    widths = widths or best_widths(ids)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", doc_ids.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([doc_ids], ["doc_id"]))
    named = sink.getvalue().to_pybytes()
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    at = _FIXED_SIZE + _LEVEL_SIZE * len(widths)
    sections, levels = [named, starts.tobytes()], []
    names_at, starts_at = at, at + len(named)
    at = starts_at + starts.nbytes
    rest = ids.astype("<u4", copy=False)
    for number, width in enumerate(widths):
        n = len(rest)
        chunks = pack_chunks((rest & np.uint32((1 << width) - 1)).astype("u1"), width).tobytes()
        if number < len(widths) - 1:
            more = (rest >> np.uint32(width)) > 0
            marks = np.packbits(more, bitorder="little")
            rest = rest[more] >> np.uint32(width)
            parts = [chunks, marks.tobytes(), _ranks(marks).tobytes()]
        else:
            parts = [chunks, b"", b""]
        places = [at, at + len(parts[0]), at + len(parts[0]) + len(parts[1])]
        levels.append(struct.pack(_LEVEL, width, n, *places))
        sections += parts
        at += sum(map(len, parts))
    head = struct.pack(
        _FIXED, MAGIC, shard, piece, before, len(counts), len(ids), len(widths), names_at, len(named), starts_at
    )
    return b"".join([head, *levels, *sections])


class TokenFile:
    """Reads a file at any place. ``source`` is the file's bytes or anything with pyarrow's
    ``read_at(size, offset)``, an open local or remote file for instance; only the bytes that
    are asked for are read."""

    def __init__(self, source):
        if isinstance(source, bytes | memoryview | pa.Buffer):
            source = pa.BufferReader(source)
        self._read = source.read_at
        head = struct.unpack(_FIXED, self._read(_FIXED_SIZE, 0))
        if head[0] != MAGIC:
            raise ValueError("not a file of token ids")
        (self.shard, self.piece, self.before, self.n_docs, self.n_ids, levels,
         self._names_at, self._names_size, self._starts_at) = head[1:]
        raw = self._read(_LEVEL_SIZE * levels, _FIXED_SIZE)
        self._levels = list(struct.iter_unpack(_LEVEL, raw))

    def _bytes(self, offset: int, size: int) -> np.ndarray:
        return np.frombuffer(self._read(size, offset), dtype="u1")

    def _rank(self, level: tuple, place: int) -> int:
        """Marks set before ``place``."""
        _, _, _, marks, ranks = level
        stretch = place // STRETCH
        (count,) = struct.unpack("<I", self._read(4, ranks + 4 * stretch))
        size = (place - stretch * STRETCH + 7) // 8
        if size:
            raw = self._bytes(marks + stretch * (STRETCH // 8), size)
            count += int(_ONES[raw[:-1]].sum(dtype=np.int64))
            used = (place - 1) % 8 + 1
            count += int(_ONES[raw[-1] & ((1 << used) - 1)])
        return count

    def token(self, place: int) -> int:
        """The id at ``place``: a byte or two, a mark and a count from each level it reaches."""
        if not 0 <= place < self.n_ids:
            raise IndexError(place)
        value = shift = 0
        for number, level in enumerate(self._levels):
            width, _, chunks, marks, _ = level
            bit = place * width
            raw = int.from_bytes(self._read(2, chunks + bit // 8), "little")
            value |= (raw >> bit % 8 & ((1 << width) - 1)) << shift
            if number == len(self._levels) - 1:
                break
            if not self._read(1, marks + place // 8)[0] >> place % 8 & 1:
                break
            place, shift = self._rank(level, place), shift + width
        return value

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` up to ``end``, from their own stretch of every level."""
        start, end = max(0, start), min(end, self.n_ids)
        out = np.zeros(max(0, end - start), dtype="<u4")
        at, shift = slice(None), 0  # which ids the chunks of a level belong to
        for number, level in enumerate(self._levels):
            if start >= end:
                break
            width, _, chunks, marks, _ = level
            first = start // 8
            raw = self._bytes(chunks + first * width, (-(-end // 8) - first) * width)
            low = unpack_chunks(raw, width)[start - 8 * first : end - 8 * first]
            out[at] |= low.astype("<u4") << np.uint32(shift)
            if number == len(self._levels) - 1:
                break
            bits = np.unpackbits(self._bytes(marks + first, -(-end // 8) - first), bitorder="little")
            more = np.flatnonzero(bits[start - 8 * first : end - 8 * first])
            at = more if number == 0 else at[more]
            start = self._rank(level, start)
            end, shift = start + len(at), shift + width
        return out

    def starts(self) -> np.ndarray:
        """Where each document begins, and the end of the last."""
        return self._bytes(self._starts_at, 8 * (self.n_docs + 1)).view("<u8")

    def document(self, number: int) -> np.ndarray:
        start, end = struct.unpack("<2Q", self._read(16, self._starts_at + 8 * number))
        return self.tokens(start, end)

    def doc_ids(self) -> pa.Array:
        raw = pa.BufferReader(self._read(self._names_size, self._names_at))
        with pa.ipc.open_stream(raw) as names:
            return names.read_all().column(0).combine_chunks()
