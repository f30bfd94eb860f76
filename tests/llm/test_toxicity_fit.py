"""The fit against a plain optimiser, the choice of features against counting, and neutral mentions at the default penalty."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import SYLLABLES
from pyspark.sql import functions as F

from flowhelm.llm import toxicity


def plain(own, fewer, more, labels, m, penalty, fairness):
    """Newton's method on the dense problem."""
    x = np.zeros((len(labels), m + 1))
    d = np.zeros((len(labels), m + 1))
    x[:, m] = 1
    for i in range(len(labels)):
        x[i, own[i]] = 1
        d[i, fewer[i]] += 1
        d[i, more[i]] -= 1
    w = np.zeros(m + 1)
    ridge = np.diag([penalty] * m + [0.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - labels) + ridge @ w + 2 * fairness * d.T @ (d @ w)
        h = (x.T * (p * (1 - p))) @ x + ridge + 2 * fairness * d.T @ d + 1e-12 * np.eye(m + 1)
        w -= np.linalg.solve(h, g)
    return w


@pytest.mark.parametrize("fairness", [0.0, 1.0, 20.0])
def test_fit_is_the_optimum(fairness):
    rng = np.random.default_rng(3)
    n, m = 120, 9
    own = [np.flatnonzero(rng.random(m) < 0.4).astype(np.int32) for _ in range(n)]
    fewer = [s[:1] if i % 4 == 0 else s[:0] for i, s in enumerate(own)]
    more = [np.array([(int(s[0]) + 1) % m], dtype=np.int32) if len(f) else s[:0] for s, f in zip(own, fewer, strict=True)]
    labels = np.array([float(rng.random() < (0.8 if 2 in s else 0.3)) for s in own])
    got = toxicity._fit(np.arange(m, dtype=np.uint64), own, fewer, more, labels, 0.1, fairness, 20_000)
    want = plain(own, fewer, more, labels, m, 0.1, fairness)
    assert np.allclose(got.weights, want[:m], atol=1e-4) and got.bias == pytest.approx(want[m], abs=1e-4)


def texts(rng, n):
    """Biased data: one group is named mostly in toxic texts."""
    rows = []
    for i in range(n):
        words = [rng.choice(SYLLABLES) * 2 for _ in range(20)]
        if i % 3 == 0:
            words[rng.randrange(10)] = rng.choice(["stupid", "idiot", "moron"])
        if rng.random() < (0.6 if i % 3 == 0 else 0.05):
            words[10 + rng.randrange(10)] = "muslims"
        elif rng.random() < 0.3:
            words[10 + rng.randrange(10)] = rng.choice(["christians", "jews"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_neutral_mentions_at_the_default_penalty(spark):
    rows = texts(random.Random(8), 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    rng = random.Random(9)
    neutral = pa.array([" ".join([rng.choice(SYLLABLES) * 2 for _ in range(9)] + ["muslims"]) for _ in range(300)])
    toxic = pa.array([" ".join([rng.choice(SYLLABLES) * 2 for _ in range(9)] + ["idiot"]) for _ in range(300)])
    without, default = (toxicity.fit(docs, labels, **o) for o in ({"fairness": 0.0}, {}))
    alarms = [float((m.score(neutral) >= toxicity.THRESHOLD).mean()) for m in (without, default)]
    assert alarms[1] <= 0.02 and alarms[1] <= alarms[0]
    assert default.score(neutral).mean() < 0.6 * without.score(neutral).mean()
    assert (default.score(toxic) >= toxicity.THRESHOLD).mean() > 0.95


def test_features_are_counted_over_the_sample(spark, monkeypatch):
    rows = texts(random.Random(5), 300)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(0, rows[0][1])] * 3, "doc_id long, text string").repartition(5)  # a row repeated
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    seen = {1: Counter(), 0: Counter()}
    for _, text, label in rows:
        seen[label].update(next(toxicity._sets(pa.array([text]))).tolist())
    n1, n0 = 100, 200
    want = set()
    for f in seen[1].keys() | seen[0].keys():
        t, c = seen[1][f] + 0.5, seen[0][f] + 0.5
        if abs(np.log(t / c * (n0 + 1) / (n1 + 1))) - 1.96 * np.sqrt(1 / t + 1 / c) > toxicity.LEAST_ODDS:
            want.add(f)
    assert set(model.features.tolist()) == want
    monkeypatch.setattr(toxicity, "FEATURES", 3)
    assert len(toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")).features) == 3
    one = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    assert len(one.features) == 0 and toxicity.score(docs, one).agg(F.max("toxicity")).first()[0] < 0.5
