"""Benchmark decontamination by CGK embeddings, bit-sampling tables and exact edit distance, without loss.

At most ``edits`` of an item's bytes may differ, say k. Item-sized windows of the texts are embedded by random walks and looked up in
sampled tables (:mod:`flowhelm.llm.cgk`), whose repetitions are added until copies with the full k edits are found; candidates are verified by the
exact edit distance of the whole item to the part of the text around them. The recall that was measured for the class of an item's length is
part of the result.

What sampling misses is found exactly: an item is cut into k + 1 pieces, so any near copy holds at least one of them unchanged.
Moreover, counting errors minus pieces from left to right, the pieces behind the last maximum are followed to the end by fewer
errors than pieces: some unchanged piece is followed by a piece with at most one error, by two with at most two, and so
on. Unchanged pieces are found by a look-up of eight bytes at every position of a text, then the next piece and the next three
are held against that, and what is left joins the candidates. So no true copy is dropped, at any edit rate; items below
``cgk.LEAST_SIZE`` bytes, too short for sampled walks, are found this way alone.

Texts and items are compared with A-Z lower-cased and every white-space byte as a space. Null or empty texts and items
match nothing; repeated rows are reported as rows of their own; equal items are all reported; an empty table on either
side gives no rows. The benchmark goes to every task in parts of at most ``PART_BYTES``, one pass over the texts for each;
what a task holds of a part is linear in its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowhelm.llm import cgk
from flowhelm.llm.text import IS_SPACE, LOWER, pieces
from flowhelm.session import stored

EDITS = 0.1
PART_BYTES = 2 << 20
AHEAD = 3  # pieces behind an unchanged one that are compared before the whole item
_POSITIONS, _HITS = 1 << 18, 1 << 20  # positions looked up and pieces compared at a time
_NORMAL = np.where(IS_SPACE, 32, LOWER).astype(np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FINDERS: dict[str, Finder] = {}
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on as a word, a view; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))


def _counted(n: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for every n, behind each other."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def distance(item: bytes, text: bytes, most: int) -> int:
    """Edit distance of ``item`` to the best part of ``text``, or most + 1: one bit-parallel column per byte of text."""
    return 0 if item in text else min(_best_end(item, text)[0], most + 1)


def begin_of(item: bytes, text: bytes) -> int:
    """Where the leftmost of the best parts begins: the last end of the best parts of the reversed text."""
    at = text.find(item)
    return at if at >= 0 else len(text) - _best_end(item[::-1], text[::-1])[1]


def _best_end(item: bytes, text: bytes) -> tuple[int, int]:
    """Edit distance of ``item`` to the best part of ``text``, and the last end of such a part."""
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    match: dict[int, int] = {}
    for i, c in enumerate(item):
        match[c] = match.get(c, 0) | 1 << i
    plus, minus, now, best, end = full, 0, n, n, 0
    for at, c in enumerate(text, 1):
        eq = match.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        if now <= best:
            best, end = now, at
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
    return best, end


def _overlapping(row: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of one text for one item that overlap: an order, the bounds of the groups in it, the end of each group."""
    order = np.lexsort((lo, item, row))
    row, item, lo, hi = (x[order] for x in (row, item, lo, hi))
    other = np.ones(len(row), dtype=bool)
    other[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
    group = np.cumsum(other) * (int(hi.max(initial=0)) + 1)
    reach = np.maximum.accumulate(group + hi) - group
    other[1:] |= lo[1:] > reach[:-1]
    bounds = np.append(np.flatnonzero(other), len(row))
    return order, bounds, reach[bounds[1:] - 1]


def _thinned(row: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Parts with so many unchanged pieces that looking at each costs more than the whole comparison become one row
    without a piece (-1)."""
    order, bounds, end = _overlapping(row, item, lo, hi)
    row, item, lo, hi, at, seed = (x[order] for x in (row, item, lo, hi, at, seed))
    begin, count = bounds[:-1], np.diff(bounds)
    dense = 32 * count > end - lo[begin]
    one, keep = begin[dense], np.repeat(~dense, count)
    none = np.full(len(one), -1)
    return tuple(np.concatenate(x) for x in (
        (row[keep], row[one]), (item[keep], item[one]), (lo[keep], lo[one]), (hi[keep], end[dense]), (at[keep], none), (seed[keep], none)))


class Finder:
    """Near copies of benchmark items in texts."""

    def __init__(self, items: list[tuple[int, str]], edits: float = EDITS):
        if not 0 <= edits < 1:
            raise ValueError(f"edits is a share of an item's bytes below 1, not {edits}")
        ids: dict[bytes, list[int]] = {}
        for i, t in items:
            raw = _NORMAL[np.frombuffer((t or "").encode(), dtype=np.uint8)].tobytes().strip()
            if raw:
                ids.setdefault(raw, []).append(i)
        self.items, self.ids = list(ids), list(ids.values())
        self.size = np.array([len(raw) for raw in self.items], dtype=np.int64)
        self.most = np.array([int(len(raw) * edits) for raw in self.items], dtype=np.int64)
        self.base = np.cumsum(self.size) - self.size
        self.words = _words(np.frombuffer(b"".join(self.items), dtype=np.uint8))
        parts = self.most + 1
        self.owner = np.repeat(np.arange(len(self.items)), parts)
        j, n, size = _counted(parts), parts[self.owner], self.size[self.owner]
        self.offset = j * size // n
        self.length = (j + 1) * size // n - self.offset
        self.following = np.where(j + 1 < n, np.append(self.length[1:], 0), 0)
        ahead = np.minimum(AHEAD, n - 1 - j)
        self.ahead, self.until = ahead, (j + 1 + ahead) * size // n
        raws = self.items
        classes = 1 << np.maximum(np.log2(np.maximum(self.size, 1)).astype(int), 0)
        self.walks = [
            cgk.Walks(int(low), numbers, [raws[n] for n in numbers], edits)
            for low in np.unique(classes) if low >= cgk.LEAST_SIZE for numbers in [np.flatnonzero(classes == low)]]
        self.recall: list[float | None] = [None] * len(raws)
        for walks in self.walks:
            for n in walks.numbers:
                self.recall[n] = walks.measured
        self.tables = []
        at, short = self.base[self.owner] + self.offset, np.minimum(self.length, 8)
        for n in np.unique(short):
            seeds = np.flatnonzero(short == n)
            keys = self.words[at[seeds]] & _MASK[n]
            order = np.argsort(keys, kind="stable")
            shift = np.uint64(64 - min(26, max(18, len(seeds).bit_length() + 5)))
            known = np.zeros(1 << 64 - int(shift), dtype=bool)
            known[(keys * _MIX >> shift).astype(np.int64)] = True
            self.tables.append((int(n), keys[order], seeds[order], known, shift))

    def _hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and the pieces that begin there, by their first eight bytes."""
        for n, keys, seeds, known, shift in self.tables:
            for begin in range(0, len(words), _POSITIONS):
                k = words[begin : begin + _POSITIONS] & _MASK[n]
                maybe = np.flatnonzero(known[(k * _MIX >> shift).astype(np.int64)])
                k = k[maybe]
                lo = np.searchsorted(keys, k, side="left")
                lo, maybe, k = (x[keys[np.minimum(lo, len(keys) - 1)] == k] for x in (lo, maybe, k))
                count = np.searchsorted(keys, k, side="right") - lo
                total = np.cumsum(count)
                a = 0
                while a < len(count):
                    b = max(a + 1, int(np.searchsorted(total, total[a] - count[a] + _HITS, side="right")))
                    yield begin + np.repeat(maybe[a:b], count[a:b]), seeds[np.repeat(lo[a:b], count[a:b]) + _counted(count[a:b])]
                    a = b

    def _likely(self, words: np.ndarray, at: np.ndarray, seed: np.ndarray) -> np.ndarray:
        """Whether the last eight bytes of the piece agree too, and a half of the next piece does where at most one error
        can have moved it."""
        last, begin = len(words) - 1, self.base[self.owner[seed]] + self.offset[seed]
        same = lambda by, n, s=0: (words[np.minimum(at + by + s, last)] ^ self.words[begin + by]) & _MASK[np.minimum(n, 8)] == 0
        length, following = self.length[seed], self.following[seed]
        half = following // 2
        back = np.maximum(length - 8, 0)
        near = same(length, half)
        for s in (-1, 0, 1):
            near |= same(length + half, following - half, s)
        return same(back, length) & near

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item_id, distance, start) of every item in every text: the smallest distance, and where the first part with it
        begins."""
        for row, item, d, start, *_ in self.found(texts):
            yield row, item, d, start

    def found(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, bool, float | None]]:
        """The same, whether the walks came upon it, and the recall measured for items of this length."""
        if not self.items:
            return
        for first, offsets, data in pieces(texts):
            data = _NORMAL[data]
            walked = list(self._walked(data, offsets))
            parts = [*walked, *self._seeded(_words(data), offsets)]
            by_walk = {(int(r), int(i)) for row, item, *_ in walked for r, i in zip(row, item, strict=True)}
            if parts:
                for r, item, d, start in self._verified(data.tobytes(), *(np.concatenate(x) for x in zip(*parts, strict=True))):
                    for i in self.ids[item]:
                        yield first + r, i, d, start - int(offsets[r]), (r, item) in by_walk, self.recall[item]

    def _around(self, row: np.ndarray, item: np.ndarray, begin: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The part of a text in which an item that begins at a place may lie."""
        lo, hi = begin - self.most[item], begin + self.size[item] + self.most[item]
        return np.maximum(lo, offsets[row]), np.minimum(hi, offsets[row + 1])

    def _walked(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Candidates whose walks agree with those of windows that begin at fixed strides in each text."""
        size = np.diff(offsets)
        for walks in self.walks:
            count = -(-size // walks.stride)
            row = np.repeat(np.arange(len(size)), count)
            start = offsets[row] + _counted(count) * walks.stride
            windows, entries, _ = walks.candidates(data, start)
            if len(windows):
                row, owner = row[windows], walks.owner[entries]
                item = walks.numbers[owner]
                lo, hi = self._around(row, item, start[windows] - (entries - walks.first[owner]), offsets)
                none = np.full(len(row), -1)
                yield row, item, lo, hi, none, none

    def _seeded(self, words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Candidates around unchanged pieces of items."""
        for at, seed in self._hits(words):
            row = np.searchsorted(offsets, at, side="right") - 1
            fits = at + self.length[seed] <= offsets[np.minimum(row + 1, len(offsets) - 1)]
            at, seed, row = at[fits], seed[fits], row[fits]
            near = self._likely(words, at, seed)
            at, seed, row = at[near], seed[near], row[near]
            item = self.owner[seed]
            lo, hi = self._around(row, item, at - self.offset[seed], offsets)
            yield _thinned(row, item, lo, hi, at, seed)

    def _verified(self, data: bytes, row: np.ndarray, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: np.ndarray, seed: np.ndarray):
        """(row, item, smallest distance, start) of the items with a near copy in their parts."""
        order, bounds, end = _overlapping(row, item, lo, hi)
        row, item, lo, at, seed = (x[order] for x in (row, item, lo, at, seed))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for a, b, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist(), end.tolist(), strict=True):
            key, begin = (int(row[a]), int(item[a])), int(lo[a])
            raw, most = self.items[key[1]], int(self.most[key[1]])
            known = best.get(key, (most + 1, 0))[0]
            if known and any(s < 0 or self._goes_on(data, raw, p, s) for p, s in zip(at[a:b].tolist(), seed[a:b].tolist(), strict=True)):
                d = distance(raw, data[begin:stop], most)
                if d < known:
                    best[key] = d, begin + begin_of(raw, data[begin:stop])
        for (r, i), (d, start) in sorted(best.items()):
            yield r, i, d, start

    def _goes_on(self, data: bytes, raw: bytes, at: int, seed: int) -> bool:
        """Whether the pieces behind the unchanged one hold at most an error each on the average."""
        n, end, until = int(self.ahead[seed]), int(self.offset[seed] + self.length[seed]), int(self.until[seed])
        at += int(self.length[seed])
        return n == 0 or distance(raw[end:until], data[at : at + until - end + n], n) <= n


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in parts that may go to every task; an item above ``PART_BYTES`` alone."""
    part, size = [], 0
    for r in benchmark.select("item_id", "text").where("text <> ''").orderBy("item_id", "text").toLocalIterator():
        n = len(r.text.encode())
        if part and size + n > PART_BYTES:
            yield part
            part, size = [], 0
        part.append((r.item_id, r.text))
        size += n
    yield part


def _finder(items: list[tuple[int, str]], edits: float) -> Finder:
    """The finder of a part of the benchmark, kept by a worker until another part comes."""
    name = hashlib.sha256(repr((items, edits)).encode()).hexdigest()
    if name not in _FINDERS:
        _FINDERS.clear()
        _FINDERS[name] = Finder(items, edits)
    return _FINDERS[name]


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, evidence: bool = False) -> DataFrame:
    """(doc_id, item_id, distance, start) of benchmark items in the texts of ``docs``, byte positions. With ``evidence`` also ``by_walk``, whether
    the sampled walks came upon it, and ``recall``, what was measured for the walks of items of that length in its part of the benchmark, null
    where only the exact way looks."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()]
    names = ["doc_id", "item_id", "distance", "start", "by_walk", "recall"]

    def searched(items: list[tuple[int, str]]) -> DataFrame:
        def search(batches):
            for batch in batches:
                found = list(_finder(items, edits).found(batch.column("text")))
                ids = batch.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([f[0] for f in found], pa.int64())), *[pa.array([f[k + 1] for f in found], t) for k, t in enumerate(kinds)]], names)

        return texts.mapInArrow(search, "doc_id long, item_id long, distance long, start long, by_walk boolean, recall double")

    done, parts = [], _parts(benchmark)
    part = next(parts)
    for following in parts:  # a part at a time, so the driver never holds more than two
        done.append(stored(searched(part), "leaks"))
        part = following
    found = reduce(DataFrame.unionByName, done, searched(part))
    return found if evidence else found.drop("by_walk", "recall")
