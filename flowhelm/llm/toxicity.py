"""A counterfactual-regularised toxicity classifier.

A text is the set of its words (runs of letters and digits, A-Z lower-cased) and of the beginnings of its words, which
catch inflected and compounded forms. A logistic model is fitted on a bounded sample of labelled rows: the ``SAMPLE``
rows of each label with the smallest hash of doc_id, so the sample doesn't change with the order of the input. In every
sampled text that names a group of people, the names are swapped for others of their kind, and the squared change of the
score is a penalty beside the usual ones: naming a group can't make a text toxic or harmless by itself, which keeps
neutral mentions from being rejected. All texts are then scored whole, in one pass, by the features that the fit kept.

Null or empty texts have no features and get the score of the bias; repeated rows get equal scores; without labelled
rows of both kinds, or for an empty table, the model has no features and scores 0.5 or the share of toxic rows.
Labels that contradict each other for a doc_id count as toxic; null labels are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowhelm.llm.text import LOWER, Spans, as_long, pieces
from flowhelm.session import stored

SAMPLE = 4_000
FEATURES = 30_000
LEAST_ODDS = 0.7
THRESHOLD = 0.7
BEGINNINGS = (3, 4, 5, 6)
#: Names of groups; each is swapped for the next of its line.
GROUPS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "arab"), ("immigrants", "refugees", "foreigners", "natives"), ("old", "young"), ("disabled", "blind", "deaf"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_NEXT = {name: line[(i + 1) % len(line)] for line in GROUPS for i, name in enumerate(line)}
_NAMES = re.compile(r"\b(" + "|".join(sorted(_NEXT, key=len, reverse=True)) + r")\b", re.IGNORECASE)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def swap_names(text: str) -> str:
    return _NAMES.sub(lambda m: _NEXT[m[0].lower()] if m[0].lower() in _NEXT else m[0], text)


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every occurrence of a feature."""
    data = LOWER[data]
    inside = np.concatenate([_LETTER[data], [False]])
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    last = offsets[1:-1] - 1
    last = last[last >= 0]
    ends[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    spans = Spans(data, 3)
    found, rows = [spans.hash(start, end)], [row]
    for n in BEGINNINGS:
        longer = end - start > n
        found.append(spans.hash(start[longer], start[longer] + n) + np.uint64(n))
        rows.append(row[longer])
    return np.concatenate(found), np.concatenate(rows)


def _sets(texts: pa.Array):
    """Distinct features of each text."""
    for _, offsets, data in pieces(texts):
        found, row = _features(data, offsets)
        order = np.lexsort((found, row))
        found, row = found[order], row[order]
        bounds = np.searchsorted(row, np.arange(len(offsets)))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(found[a:b])


@dataclass
class Model:
    features: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        total = np.full(len(texts), self.bias)
        shift = np.uint64(64 - 20)
        known = np.zeros(1 << 20, dtype=bool)
        known[(self.features >> shift).astype(np.int64)] = True
        for at, offsets, data in pieces(texts):
            found, row = _features(data, offsets)
            maybe = np.flatnonzero(known[(found >> shift).astype(np.int64)])
            found, row = found[maybe], row[maybe]
            place = np.minimum(np.searchsorted(self.features, found), max(len(self.features) - 1, 0))
            hit = self.features[place] == found if len(self.features) else np.zeros(len(found), dtype=bool)
            key = np.unique(row[hit] * np.int64(len(self.features)) + place[hit])
            if len(key):
                n = len(self.features)
                total[at : at + len(offsets) - 1] += np.bincount(key // n, self.weights[key % n], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _fit(kept: np.ndarray, own: list[np.ndarray], fewer: list[np.ndarray], more: list[np.ndarray], labels: np.ndarray, penalty: float, fairness: float, steps: int) -> Model:
    """Weights of the ``kept`` features from the numbers of those in each text (``own``), and of those that swapping the names of groups takes
    away or adds."""
    n, m = len(labels), len(kept)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in own])
    col = np.concatenate([np.zeros(0, dtype=np.int32), *own])
    # Change of each text under the swap of group names, as signed features.
    pair = np.concatenate([np.repeat(np.arange(n), [len(s) for s in side]) for side in (fewer, more)])
    change = np.concatenate([np.zeros(0, dtype=np.int32), *fewer, *more])
    sign = np.repeat([1.0, -1.0], [sum(len(s) for s in fewer), sum(len(s) for s in more)])
    # Accelerated gradient steps; each feature's step follows a bound of the curvature in its row (diagonal dominance).
    bend = 0.25 * np.bincount(col, np.bincount(row, minlength=n)[row] + 1, m) + penalty
    if len(pair):
        bend += 2 * fairness * np.bincount(change, np.bincount(pair, minlength=n)[pair], m)
    rate, rate_b = 1 / bend, 1 / (0.25 * (len(row) + n))
    w = v = np.zeros(m)
    b = c = 0.0
    for t in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[col], n) + c, -500, 500)))
        r = p - labels
        g = np.bincount(col, r[row], m) + penalty * v
        if len(pair):
            moved = np.bincount(pair, sign * v[change], n)
            g += fairness * 2 * np.bincount(change, sign * moved[pair], m)
        w2, b2 = v - rate * g, c - rate_b * r.sum()
        mu = t / (t + 3)
        v, c = w2 + mu * (w2 - w), b2 + mu * (b2 - b)
        w, b = w2, b2
    return Model(kept, w, float(b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, penalty: float = 0.1, fairness: float = 1.0, steps: int = 1000) -> Model:
    """The model from the ``sample`` labelled documents of each kind that come first by hash. Give only rows to learn
    from. Features are counted and chosen on Spark; what reaches the driver are numbers of the at most ``FEATURES`` kept ones in each text of
    the sample, a row for each different set of them."""
    told = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")) \
        .join(docs.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_h", F.md5(F.col("doc_id").cast("string")))
    chosen = told.where("toxic = 1").orderBy("_h").limit(sample).unionByName(told.where("toxic = 0").orderBy("_h").limit(sample))
    ids = {r.doc_id: r.toxic for r in chosen.select("doc_id", "toxic").collect()}
    listed = docs.sparkSession.createDataFrame(list(ids.items()), "doc_id long, toxic int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(listed), "doc_id")
    texts = stored(rows.distinct(), "sample")
    told = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n0, n1 = told.get(0, 0), told.get(1, 0)
    if not n0 or not n1:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0 if not n0 + n1 else float(np.log((n1 + 0.5) / (n0 + 0.5))))

    def count(batches):
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            sets = list(_sets(batch.column("text")))
            names, place = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
            toxic = np.repeat(label, [len(s) for s in sets])
            counts = [np.bincount(place, toxic == k, len(names)).astype(np.int64) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([as_long(names), *map(pa.array, counts)], ["feature", "toxic", "clean"])

    # Kept: features whose odds differ by a clear factor, beyond doubt. Weak ones would add up in long texts.
    counted = texts.select("text", "toxic").mapInArrow(count, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    clear = F.abs(F.log(t / c * F.lit((n0 + 1) / (n1 + 1)))) - 1.96 * F.sqrt(1 / t + 1 / c)
    chosen = counted.withColumn("clear", clear).where(F.col("clear") > LEAST_ODDS).orderBy(F.desc("clear"), "feature").limit(FEATURES)
    kept = np.sort(np.array([r.feature for r in chosen.select("feature").collect()], dtype=np.int64).view(np.uint64))

    def numbered(names: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(kept, names), max(len(kept) - 1, 0))
        return place[kept[place] == names].astype(np.int32) if len(kept) else np.zeros(0, np.int32)

    def take(batches):
        for batch in batches:
            whole = batch.column("text").to_pylist()
            other = [swap_names(x) if x and _NAMES.search(x) else None for x in whole]
            columns = ([], [], [])
            for x, y, changed in zip(_sets(batch.column("text")), _sets(pa.array(other, pa.string())), other, strict=True):
                none = x[:0]
                for column, names in zip(columns, (x, none if changed is None else np.setdiff1d(x, y), none if changed is None else np.setdiff1d(y, x)), strict=True):
                    column.append(numbered(names).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *[pa.array(c, pa.binary()) for c in columns]], ["doc_id", "toxic", "own", "fewer", "more"])

    # Rows of one id that keep the same features are one.
    schema = "doc_id long, toxic int, own binary, fewer binary, more binary"
    got = sorted(texts.mapInArrow(take, schema).distinct().toLocalIterator(), key=lambda r: (r.doc_id, bytes(r.own), bytes(r.fewer), bytes(r.more)))
    sides = [[np.frombuffer(r[k], np.int32) for r in got] for k in ("own", "fewer", "more")]
    return _fit(kept, *sides, np.array([r.toxic for r in got], dtype=np.float64), penalty, fairness, steps)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` and ``toxicity``, the probability of label 1."""
    names = docs.columns

    def add(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(batch.column("text")))], [*names, "toxicity"])

    plain = docs.drop("toxicity") if "toxicity" in names else docs
    names = plain.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields)
    return plain.mapInArrow(add, f"{kinds}, toxicity double")


def training_rows(labels: DataFrame, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """Labels that may be learnt from: crc32 of the doc_id as text decides."""
    return labels.where(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out, F.lit(False)))
