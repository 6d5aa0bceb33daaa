"""Words, lines and rolling fingerprints of many texts at once (numpy, inside tasks).

Texts are laid end to end in one byte array with an offsets array, as Arrow
stores them.  A fingerprint is a polynomial modulo 2**64 whose coefficients are
random 64-bit values, so that the fingerprint of any range is a difference of
two prefix sums times an inverse power: all windows of a text cost one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

WORD = np.ones(256, bool)
WORD[[0x20, *range(0x09, 0x0E)]] = False

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=None)
def _coefficients(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 7919))


def _multiplier(seed: int) -> int:
    return int(mix(np.array([seed + 1000003], dtype=U))[0]) | 5


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, for exponents 0 to n at least."""
    have = _POWERS.get(seed)
    if have is None or len(have[0]) <= n:
        p = _multiplier(seed)
        size = max(n + 1, SLICE_BYTES + 4096)
        up, down = np.full(size, p, U), np.full(size, pow(p, -1, 1 << 64), U)
        up[0] = down[0] = 1
        have = (np.cumprod(up, dtype=U), np.cumprod(down, dtype=U))
        if n <= 4 * SLICE_BYTES:
            _POWERS[seed] = have
    return have


def prefix(values: np.ndarray, seed: int) -> np.ndarray:
    """Prefix sums of ``values[i] * p**i``, with a leading zero."""
    out = np.empty(len(values) + 1, U)
    out[0] = 0
    np.cumsum(values * _powers(seed, len(values))[0][: len(values)], dtype=U, out=out[1:])
    return out


def byte_prefix(data: np.ndarray, seed: int) -> np.ndarray:
    return prefix(_coefficients(seed)[data], seed)


def ranges(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, seed: int) -> np.ndarray:
    """Fingerprints of the ranges [lo, hi)."""
    return (sums[hi] - sums[lo]) * _powers(seed, len(sums))[1][lo]


def windows(values: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Fingerprints of all k consecutive values (of every start that has k left)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, U)
    sums = prefix(values, seed)
    return mix((sums[k:] - sums[:n]) * _powers(seed, len(values))[1][:n] + U(k))


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array, nulls as empty, and the offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.cast(pa.large_binary())
    if wide.null_count:
        wide = pa.array([x if x is not None else b"" for x in wide.to_pylist()], pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset: wide.offset + len(wide) + 1]
    raw = wide.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return (data[offsets[0]: offsets[-1]], offsets - offsets[0]) if len(wide) else (data[:0], np.zeros(1, np.int64))


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words (runs of bytes other than white space, or of those that a subclass's table names) of a slice of texts."""

    table = WORD

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        word = self.table[data]
        begins, ends = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        ends[:-1] &= ~word[1:]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edge] = word[edge]
        edge = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        ends[edge] = word[edge]
        self.word = word
        self.lo = np.flatnonzero(begins)
        self.hi = np.flatnonzero(ends) + 1
        # Words of row r are numbered bounds[r] to bounds[r + 1].
        self.bounds = np.searchsorted(self.lo, offsets)
        self.counts = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.lo)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 1, data: np.ndarray | None = None) -> np.ndarray:
        sums = byte_prefix(self.data if data is None else data, seed)
        return mix(ranges(sums, self.lo, self.hi, seed))

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.bounds[1:], self.counts) - np.arange(len(self.lo))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of ``length`` that begins at one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0
