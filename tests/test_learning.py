"""Fitted models against numpy: the gradient of the objective vanishes where training ends, predictions follow from the weights."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from flowhelm.operators import ml as M
from flowhelm.operators import select as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 2] + [0, 3, 1, -2]
    y = np.argmax(x @ rng.normal(size=(4, 3)) + rng.normal(size=(300, 3)), axis=1)
    frame = spark.createDataFrame([(i, float(c), Vectors.dense(v)) for i, (c, v) in enumerate(zip(y, x, strict=True))], ["id", "label", "features"])
    return x, y, frame


def probabilities(x, model):
    scaler, fitted = model.stages
    z = (x - scaler.mean.toArray()) / scaler.std.toArray()
    w, b = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    scores = z @ w.T + b
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return z, w, e / e.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("reg", [0.01, 0.3])
def test_training_ends_where_the_gradient_vanishes(rows, reg):
    x, y, frame = rows
    model = M.train_node_classifier(frame, reg=reg, max_iter=500)
    z, w, p = probabilities(x, model)
    assert np.allclose(z.std(axis=0, ddof=1), 1)
    off = p - np.eye(3)[y]
    # the penalty is taken on weights of features that Spark scales to deviation one once more
    gradient = off.T @ z / len(y) + reg * w
    assert np.abs(gradient).max() < 2e-3 and np.abs(off.mean(axis=0)).max() < 1e-3


def test_predictions_follow_from_the_weights(rows):
    x, y, frame = rows
    model = M.fit_final(frame)
    _, _, p = probabilities(x, model)
    got = {r.id: r for r in M.predict(model, frame).collect()}
    for i in range(len(y)):
        assert np.allclose(got[i].probs, p[i], atol=1e-9) and got[i].pred == p[i].argmax() and got[i].y == y[i]


def test_cross_validation_fits_each_fold_alone(rows, spark):
    x, y, frame = rows
    folds = [(f, "test" if i % 3 == f else "train", i) for f in range(3) for i in range(300)]
    got = {r.fold: r for r in M.cv_run(frame, spark.createDataFrame(folds, "fold int, role string, id long"), 3).collect()}
    for f in range(3):
        test = np.arange(300) % 3 == f
        model = M.train_node_classifier(frame.where(f"id % 3 <> {f}"))
        _, _, p = probabilities(x[test], model)
        assert got[f].tested == 100 and got[f].accuracy == pytest.approx((p.argmax(axis=1) == y[test]).mean())


def test_encodings_are_compared_on_the_same_rows(rows, spark):
    nodes = spark.createDataFrame([(f"n{i}", i % 2, [float(i % 2), 1.0]) for i in range(60)], "id string, label int, feat array<double>")
    edges = spark.createDataFrame([(i, f"n{i}", f"n{(i * 7 + 1) % 60}", float(i)) for i in range(60)], "flow_id long, src string, dst string, t double")
    from pyspark.sql import functions as F

    split = nodes.select("id", F.when(F.pmod(F.xxhash64("id"), F.lit(4)) == 0, "test").otherwise("train").alias("split"))
    encodings = {"one": (lambda t: F.array(F.cos(t)), 1), "two": (lambda t: F.array(F.cos(t), F.sin(t)), 2)}
    got = {r.encoding: r for r in M.encoding_comparison(edges, nodes, 2, encodings, split).collect()}
    assert {k: (r.accuracy, r.best) for k, r in got.items()} == {"one": (1.0, True), "two": (1.0, True)}  # the label is a feature


def test_upper_tail_and_dropped_features(spark):
    """F probabilities against numeric integration; a feature goes when it is neither significant nor informative."""
    def density(f, a, b):
        from math import exp, lgamma, log

        return exp(lgamma((a + b) / 2) - lgamma(a / 2) - lgamma(b / 2) + a / 2 * log(a / b) + (a / 2 - 1) * log(f) - (a + b) / 2 * log(1 + a * f / b))

    for a, b, f in ((2, 30, 1.5), (4, 100, 3.2), (1, 12, 0.4), (9, 50, 0.9)):
        grid = np.linspace(f, f + 400, 400_001)
        values = np.array([density(g, a, b) for g in grid[::40]])
        tail = float(((values[1:] + values[:-1]) / 2 * np.diff(grid[::40])).sum())
        assert S.f_upper_tail(f, a, b) == pytest.approx(tail, abs=2e-3)
    anova = spark.createDataFrame([("a", 1.0, 0.5), ("b", 9.0, 0.001), ("c", 1.0, 0.6)], "feature string, f double, p double")
    mi = spark.createDataFrame([("a", 0.01), ("b", 0.0), ("c", 0.5)], "feature string, mi double")
    assert [r.feature for r in S.insignificant(anova, mi, mi_quantile=0.9).collect()] == ["a"]
