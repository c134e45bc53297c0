"""Counting quotient filters of packed numbers, as sorted and compact as they travel.

A number of ``bits`` bits is permuted by an invertible mix, so its top bits are spread evenly
whatever the numbers were. They are the quotient, the rest the remainder. A filter holds its
entries by quotient: a bitmap of occupied quotients, a mark at the end of each quotient's run
of slots, the full remainders and a counter per slot. Nothing is hashed away: quotient and
remainder give the permuted number back, and undoing the mix gives the packed one. Filters of
one quotient range merge as sorted lists do.
"""

from __future__ import annotations

import numpy as np

from .packed import CODE_TYPES, code_streams, codes_of, expand, squeeze

# Two odd multipliers; any odd numbers can be undone.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _factor(number: int, bits: int, back: bool) -> np.uint64:
    size = 1 << bits
    return np.uint64(pow(number, -1, size) if back else number % size)


def permute(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the numbers below ``2 ** bits`` (at most 64 bits)."""
    keys = keys.astype(np.uint64)
    half = np.uint64((bits + 1) // 2)
    for factor in _FACTORS:
        keys = (keys * _factor(factor, bits, False)) & _mask(bits)
        keys ^= keys >> half
    return keys


def restore(keys: np.ndarray, bits: int) -> np.ndarray:
    """The numbers that :func:`permute` got."""
    keys = keys.astype(np.uint64)
    half = np.uint64((bits + 1) // 2)
    for factor in reversed(_FACTORS):
        keys = keys ^ (keys >> half)
        keys = (keys * _factor(factor, bits, True)) & _mask(bits)
    return keys


def write_filter(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A filter of ascending, different ``keys`` below ``2 ** bits`` and their counts.

    About as many quotients as entries, so runs are short.
    """
    quotient_bits = min(bits, max(0, len(keys).bit_length() - 1))
    low = bits - quotient_bits
    quotients = (keys >> np.uint64(low)).astype(np.int64) if low < 64 else np.zeros(len(keys), np.int64)
    remainders = keys & _mask(low)
    occupied = np.zeros(1 << quotient_bits, dtype=bool)
    occupied[quotients] = True
    run_ends = np.append(np.diff(quotients) > 0, True)[: len(keys)]
    planes = remainders.astype("<u8").view("u1").reshape(-1, 8)[:, : -(-low // 8)]
    return squeeze(
        np.array([bits, quotient_bits, len(keys)], dtype="<u4"),
        np.packbits(occupied), np.packbits(run_ends), np.ascontiguousarray(planes.T).reshape(-1),
        *code_streams(counts - 1),
    )


def read_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a filter, ascending, and their counts."""
    (head, occupied, run_ends, planes, *codes) = expand(data, "<u4", "u1", "u1", "u1", *CODE_TYPES)
    bits, quotient_bits, n = head.tolist()
    low = bits - quotient_bits
    taken = np.flatnonzero(np.unpackbits(occupied, count=1 << quotient_bits))
    ends = np.unpackbits(run_ends, count=n).astype(np.int64)
    quotients = taken[np.cumsum(ends) - ends].astype(np.uint64) if n else np.zeros(0, np.uint64)
    raw = np.zeros((n, 8), dtype="u1")
    raw[:, : -(-low // 8)] = planes.reshape(-(-low // 8), n).T
    keys = raw.reshape(-1).view("<u8")
    return (quotients << np.uint64(low) if low < 64 else 0) | keys, codes_of(*codes) + 1


def merge(filters: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys of all filters, ascending, their summed counts, and the place of each filter's own."""
    read = [read_filter(f) for f in filters]
    keys = np.concatenate([k for k, _ in read])
    order = np.argsort(keys, kind="stable")  # the runs are sorted already
    keys = keys[order]
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    at = np.flatnonzero(new)
    totals = np.add.reduceat(np.concatenate([c for _, c in read])[order], at) if len(at) else at
    place = np.empty(len(keys), dtype=np.int64)
    place[order] = np.cumsum(new) - 1
    return keys[at], totals, np.split(place, np.cumsum([len(k) for k, _ in read])[:-1])
