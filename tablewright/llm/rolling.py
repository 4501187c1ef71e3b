"""Hashes of words and word runs over whole batches of text with numpy.

A prefix sum of byte values times powers of an odd base gives the hash of any
byte range from two of its entries (arithmetic modulo 2^64); the result is mixed
so that all its bits can be used.  Everything works on the bytes of many texts
laid end to end, with no Python loop over words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACES = (9, 10, 11, 12, 13, 32)
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which neighbouring values look unrelated."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * BASE)


@lru_cache(maxsize=2)
def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE^0 … BASE^(n-1), or the same of its inverse modulo 2^64."""
    base = pow(int(BASE), -1, 1 << 64) if inverse else int(BASE)
    out = np.ones(n, np.uint64)
    out[1:] = U64(base)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def room(n: int) -> int:
    return 1 << max(16, int(n).bit_length())


class Ranges:
    """Hashes of ranges of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.inverse = powers(room(n), True)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * powers(room(n))[:n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def join(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and where each text starts (with the end as last entry)."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text (with the end as last entry)."""
    space = np.zeros(256, bool)
    space[list(SPACES)] = True
    inside = ~space[data]
    n = len(data)
    cut = np.zeros(n + 1, bool)  # a text begins here
    cut[bounds] = True
    begins, stops = inside.copy(), inside
    if n:
        begins[1:] &= ~inside[:-1] | cut[1:n]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Ranges(byte_values()[data]).hashes(starts, ends)


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: entry i covers values i … i + width - 1."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def xxhash64_of_longs(*columns: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of eight-byte values, each seeded with the hash of those before it, as Spark's xxhash64 does."""
    p1, p2, p3, p4, p5 = (U64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    hashed = np.full(len(columns[0]), seed, np.uint64)
    for column in columns:
        value = column.astype(np.int64).view(np.uint64) * p2
        value = ((value << U64(31)) | (value >> U64(33))) * p1
        hashed = (hashed + p5 + U64(8)) ^ value
        hashed = ((hashed << U64(27)) | (hashed >> U64(37))) * p1 + p4
        hashed = (hashed ^ (hashed >> U64(33))) * p2
        hashed = (hashed ^ (hashed >> U64(29))) * p3
        hashed = hashed ^ (hashed >> U64(32))
    return hashed
