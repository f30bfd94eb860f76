"""CGK embeddings of benchmark items: random walks that turn edit distance into Hamming distance, and bit-sampling tables.

A walk over a string writes the byte it stands on and moves on or stays, as a random bit for (step, byte) says. Walks over near
strings fall into step again after an edit, so most of their steps agree. A text is walked from windows at fixed strides, an
item from every start, both as far as an item of the class is long. A repetition samples some steps of a short stretch of the walk; windows
and entries that agree in them meet in a sorted table, and candidates whose whole walks agree as often as near copies' do are left.

Repetitions are added until copies with the full share of edits (replaced, inserted and deleted bytes), put into foreign text at any
phase, are found as often as wanted; what was measured is kept per class. Steps that leave the item are never sampled.
"""

from __future__ import annotations

import numpy as np

from flowhelm.llm.text import constants, mix

RECALL = 0.99
SAMPLED, STRETCH = 20, 24
MOST_STEPS, LEAST_SIZE = 256, 32
LEAST_REPEATS, MOST_REPEATS = 2, 40
COPIES, COPY_BYTES = 240, 2 << 20
TRIES = 8  # windows that begin inside an item
_CHUNK = 1 << 15


class Walks:
    """Tables for items of ``low`` to ``2 * low - 1`` bytes; ``items`` are their numbers."""

    def __init__(self, low: int, numbers: np.ndarray, raws: list[bytes], edits: float, recall: float = RECALL):
        self.low, self.numbers = low, numbers
        self.steps, self.stride = min(low, MOST_STEPS), max(1, low // TRIES)
        bits = mix(np.arange(self.steps * 256, dtype=np.uint64) + np.uint64(low << 20)) >> np.uint64(60) & np.uint64(1)
        self.moves = bits.astype(np.int64).reshape(self.steps, 256)
        self.rng = np.random.Generator(np.random.PCG64(low))
        self.sampled = min(SAMPLED, self.steps - 2)
        self.factor = constants(53, self.sampled)
        self.size = np.array([len(r) for r in raws])
        self.base = np.cumsum(self.size + 1) - self.size - 1
        self.data = np.frombuffer(b"\x00".join(raws) + bytes(1), dtype=np.uint8)
        self.owner = np.repeat(np.arange(len(raws), dtype=np.int32), self.size)
        self.first = np.cumsum(self.size) - self.size  # entry of an item's first byte
        self.samples: list[np.ndarray] = []
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.agree, self.measured = 0.0, 0.0
        self._calibrate(raws, edits, recall)

    def places(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where entries begin and where their items end."""
        owner = self.owner[entries]
        return self.base[owner] + entries - self.first[owner], (self.base + self.size)[owner]

    def walk(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Written bytes, a row per step, a column per start."""
        out = np.empty((self.steps, len(start)), dtype=np.uint8)
        at, move = start.copy(), np.empty(len(start), dtype=np.int64)
        for j in range(self.steps):
            np.take(data, at, out=out[j], mode="clip")
            np.take(self.moves[j], out[j], out=move, mode="clip")
            at += move
        return out

    def _keys(self, walks: np.ndarray, steps: np.ndarray) -> np.ndarray:
        k = np.zeros(walks.shape[1], dtype=np.uint64)
        for f, j in zip(self.factor, steps, strict=True):
            k += walks[j] * f
        return mix(k)

    def _add(self) -> None:
        """A repetition: another stretch of the walk, the first from its beginning."""
        spread = min(self.steps, STRETCH)
        begin = int(self.rng.integers(0, self.steps - spread + 1)) if self.samples else 0
        steps = begin + np.sort(self.rng.choice(spread, self.sampled, replace=False))
        keys, entries = [], []
        for a in range(0, len(self.owner), _CHUNK):
            begin_at, stop = self.places(np.arange(a, min(a + _CHUNK, len(self.owner))))
            walks, ahead = self.walk(self.data, begin_at), begin_at
            for j in range(int(steps[-1])):
                ahead = ahead + self.moves[j][walks[j]]
            inside = ahead < stop
            keys.append(self._keys(walks[:, inside], steps))
            entries.append((a + np.flatnonzero(inside)).astype(np.int32))
        key, entry = np.concatenate(keys), np.concatenate(entries)
        order = np.lexsort((self.owner[entry], key))
        key, entry = key[order], entry[order]
        known = np.zeros(1 << 20, dtype=bool)
        known[(key >> np.uint64(44)).astype(np.int64)] = True
        self.samples.append(steps)
        self.tables.append((key, entry, known))

    def candidates(self, data: np.ndarray, start: np.ndarray, last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows and entries that meet in a repetition (``last``: in the last one), and the share of agreeing steps of their walks."""
        windows, entries, shares = [], [], []
        for a in range(0, len(start), _CHUNK):
            walks = self.walk(data, start[a : a + _CHUNK])
            pairs = []
            for steps, (keys, entry, known) in list(zip(self.samples, self.tables, strict=True))[-1 if last else 0 :]:
                k = self._keys(walks, steps)
                maybe = np.flatnonzero(known[(k >> np.uint64(44)).astype(np.int64)])
                k = k[maybe]
                lo = np.searchsorted(keys, k, side="left")
                n = np.searchsorted(keys, k, side="right") - lo
                at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs.append(np.repeat(maybe, n) * len(self.owner) + entry[at])
            both = np.unique(np.concatenate(pairs))
            for b in range(0, len(both), _CHUNK):
                w, e = np.divmod(both[b : b + _CHUNK], len(self.owner))
                theirs = self.walk(self.data, self.places(e)[0])
                same = (walks[:, w] == theirs).mean(axis=0)
                near = same >= self.agree
                windows.append(a + w[near])
                entries.append(e[near])
                shares.append(same[near])
        none = np.zeros(0, dtype=np.int64)
        return np.concatenate([none, *windows]), np.concatenate([none, *entries]), np.concatenate([np.zeros(0), *shares])

    def _edited(self, raw: bytes, edits: float) -> bytes:
        other = bytearray(raw)
        for _ in range(int(len(raw) * edits)):
            at, kind, byte = int(self.rng.integers(0, len(other))), int(self.rng.integers(0, 3)), int(self.rng.integers(97, 123))
            if kind == 0:
                other[at] = byte
            elif kind == 1 or len(other) == 1:
                other.insert(at, byte)
            else:
                del other[at]
        return bytes(other)

    def _calibrate(self, raws: list[bytes], edits: float, recall: float) -> None:
        of = np.arange(max(24, min(COPIES, COPY_BYTES // (4 * self.low)))) % len(raws)
        letters = np.frombuffer(b"".join(raws), dtype=np.uint8)
        foreign = letters[self.rng.integers(0, len(letters), 16 * self.low)].tobytes()
        texts = []
        for n in of:
            before, behind = (int(x) for x in self.rng.integers(0, len(foreign) - 2 * self.low, 2))
            phase = int(self.rng.integers(self.stride, 2 * self.stride + 1))
            texts.append(foreign[before : before + phase] + self._edited(raws[n], edits) + foreign[behind : behind + 2 * self.low])
        size = np.array([len(t) for t in texts])
        base = np.cumsum(size) - size
        data = np.frombuffer(b"".join(texts) + bytes(1), dtype=np.uint8)
        count = -(-size // self.stride)
        row = np.repeat(np.arange(len(texts)), count)
        start = base[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * self.stride
        best = np.zeros(len(texts))
        while len(self.samples) < LEAST_REPEATS or ((best > 0).mean() < recall and len(self.samples) < MOST_REPEATS):
            self._add()
            windows, entries, share = self.candidates(data, start, last=True)
            right = of[row[windows]] == self.owner[entries]
            np.maximum.at(best, row[windows[right]], share[right])
        # Near strings have near walks: what nearly all found copies reach is asked of a candidate.
        if (best > 0).any():
            self.agree = float(np.quantile(best[best > 0], 0.005))
        self.measured = float((best >= max(self.agree, 1e-9)).mean())
