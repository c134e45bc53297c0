"""Numbers and words packed into one binary value, for shuffles of many small items.

Word-level work on a large corpus moves billions of tiny rows. These helpers let a task
send one row for each pair of (chunk of documents, hash bucket) instead, with all its words
or numbers inside; rows stay small because chunks are bounded and buckets many.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard

#: Characters of text that one chunk gathers before it is sent; a longer text is a chunk of its own.
CHUNK_CHARS = 16_000_000
#: Matches of a text taken at a time.
SLICE = 1_000_000
#: Codes taken apart at a time.
SLAB = 1 << 18


class Numbered(dict):
    """Numbers new keys in order of arrival."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; :func:`expand` needs their types."""
    sizes = np.array([a.nbytes for a in arrays], dtype="<i8")
    return zstandard.ZstdCompressor(level=3).compress(
        b"".join([sizes.tobytes(), *[np.ascontiguousarray(a).tobytes() for a in arrays]])
    )


def expand(value: bytes, *types: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(value)
    sizes = np.frombuffer(raw, dtype="<i8", count=len(types))
    out, at = [], 8 * len(types)
    for kind, size in zip(types, sizes.tolist()):
        out.append(np.frombuffer(raw, dtype=kind, count=size // np.dtype(kind).itemsize, offset=at))
        at += size
    return out


def squeeze_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), dtype="<u4", count=len(words))
    return squeeze(lengths, np.frombuffer(b"".join(words), dtype="u1"))


def expand_words(value: bytes) -> list[bytes]:
    lengths, raw = expand(value, "<u4", "u1")
    ends = np.cumsum(lengths, dtype=np.int64)
    raw = raw.tobytes()
    return [raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]


def code_streams(codes: np.ndarray) -> list[np.ndarray]:
    """Codes as byte streams in which small codes take one byte; frequent items get small codes.

    First bytes: below 128 the code itself; 128 to 191, 192 to 254 and 255 announce one, two
    and four bytes more, which follow in streams of their own.
    """
    slabs = [_streams(codes[at : at + SLAB].astype(np.int64)) for at in range(0, max(len(codes), 1), SLAB)]
    return [np.concatenate(parts) for parts in zip(*slabs)]


def _streams(codes: np.ndarray) -> list[np.ndarray]:
    two, three, four = 128, 128 + (64 << 8), 128 + (64 << 8) + (63 << 16)
    head = np.minimum(codes, 127).astype("u1")
    kind = np.digitize(codes, [two, three, four])
    v2, v3, v4 = (codes[kind == k] - low for k, low in ((1, two), (2, three), (3, four)))
    head[kind == 1] = 128 + (v2 >> 8)
    head[kind == 2] = 192 + (v3 >> 16)
    head[kind == 3] = 255
    return [head, (v2 & 255).astype("u1"), (v3 & 65535).astype("<u2"), v4.astype("<u4")]


CODE_TYPES = ("u1", "u1", "<u2", "<u4")


def codes_of(head: np.ndarray, one: np.ndarray, two: np.ndarray, four: np.ndarray) -> np.ndarray:
    """The codes that :func:`code_streams` took apart."""
    codes = head.astype(np.int64)
    k1, k2, k3 = (head >= 128) & (head < 192), (head >= 192) & (head < 255), head == 255
    codes[k1] = 128 + ((codes[k1] - 128) << 8) + one
    codes[k2] = 128 + (64 << 8) + ((codes[k2] - 192) << 16) + two
    codes[k3] = 128 + (64 << 8) + (63 << 16) + four
    return codes


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, ...`` of all runs, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths, dtype=np.int64)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def release() -> None:
    """Give free memory back to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def releasing(run):
    """``run`` over batches, with memory given back at the end of each task."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def in_slices(items, size: int = SLICE):
    """Lists of up to ``size`` items, so that a very long text is never split up whole."""
    items = iter(items)
    while part := list(islice(items, size)):
        yield part
