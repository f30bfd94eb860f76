"""A minimal perfect hash over distinct 128-bit keys, as a few arrays.

Keys are thrown on a bit array of twice their number; places hit once keep their bit, the keys of other places go to the
next, smaller array. The rank of its bit numbers a key, so n keys get the numbers 0 to n - 1 at about four bits a key. A
key outside the set gets an arbitrary number or none, so users compare a stored fingerprint.
"""

from __future__ import annotations

import numpy as np

from flowhelm.llm.text import mix


def _places(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    salt = np.uint64((level + 1) * 0xD1B54A32D192ED03 % (1 << 64))
    x = mix(low + high * np.uint64(0x9E3779B97F4A7C15) + salt)
    return (x >> np.uint64(11)).astype(np.float64) * (size / (1 << 53))


def build(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the levels and their joined bits (one byte each) for distinct keys."""
    sizes, bits = [], []
    while len(low):
        size = max(64, 2 * len(low))
        at = _places(low, high, len(sizes), size).astype(np.int64)
        hits = np.bincount(at, minlength=size)
        sizes.append(size)
        bits.append(hits == 1)
        again = hits[at] > 1
        low, high = low[again], high[again]
    return np.array(sizes, dtype=np.int64), np.concatenate(bits) if bits else np.zeros(0, dtype=bool)


class Index:
    """Look-up in what :func:`build` gave."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits) - 1

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where no level has its bit."""
        found = np.full(len(low), -1, dtype=np.int64)
        left, base = np.arange(len(low)), 0
        for level, size in enumerate(self.sizes):
            at = _places(low[left], high[left], level, int(size)).astype(np.int64) + base
            hit = self.bits[at]
            found[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            base += int(size)
        return found
