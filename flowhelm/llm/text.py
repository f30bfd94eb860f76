"""Array helpers for whole texts in Arrow batches: bytes, words, lines and span hashes.

A span hash names a byte string of any length from two look-ups in a prefix array, so tasks hash words, lines and
windows of a whole batch with a few array operations. Names have 64 bits; where equality of names must mean equality of
texts at corpus size, callers take two independent ones (``seed``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[tuple[int, int], list[np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit words."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x1234567 + 1)) | np.uint64(1)


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n + 1`` of each."""
    base = int(constants(seed + 101, 1)[0]) & ~7 | 5
    got = _POWERS.get((seed, 0))
    if got is None or len(got[0]) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        got = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            got.append(np.multiply.accumulate(steps))
        _POWERS[seed, 0] = got
    return got[0], got[1]


class Spans:
    """Hashes of byte spans of one array."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.power, self.inverse = _powers(seed, len(data))
        self.salt = constants(seed + 7, 1)[0]
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(constants(seed, 256)[data] * self.power[: len(data)], out=self.prefix[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        got = (self.prefix[end] - self.prefix[start]) * self.inverse[start]
        return mix(got + (end - start).astype(np.uint64) * self.salt)

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all spans of ``k`` bytes."""
        n = len(self.prefix) - k
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n] + np.uint64(k * int(self.salt) % (1 << 64)))


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most ``limit`` bytes together (a longer text alone), whole: first row, the offsets of the
    rows in the bytes, the bytes. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes outside ``[\\x20\\x09-\\x0D]``, never across rows; and the row of each."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:-1] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(offsets, start, side="right") - 1


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """``n + 1`` bounds of the runs in ascending row numbers."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingle_hashes(word_hash: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside each row (a shorter row: its whole sequence), and the rows, ascending."""
    m = np.diff(bounds)
    count = np.where(m >= size, m - size + 1, np.minimum(m, 1))
    row = np.repeat(np.arange(len(m)), count)
    first = np.repeat(bounds[:-1], count) + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
    factor = constants(31, size)
    got = np.zeros(len(row), dtype=np.uint64)
    length = np.minimum(m, size)[row]
    padded = np.concatenate([word_hash, np.zeros(size, dtype=np.uint64)])
    whole = bool((length == size).all())
    for j in range(size):
        part = padded[first + j] * factor[j]
        got += part if whole else np.where(j < length, part, np.uint64(0))
    return mix(got + length.astype(np.uint64)), row


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, type=pa.int64())
