"""Whitening against exact sums and a dense eigensolver."""

import random

import numpy as np
import pytest

from flowhelm.llm import queries, whitening

EPS = 1e-9


def check(rows, vectors, components=8):
    """Rows by id against numpy on the dense matrix."""
    ids = list(vectors)
    x = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in vectors[i]] for i in ids], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    y = ((x * n - sums) / n).astype(float)
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:components], basis[:, ::-1][:, :components]
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == n * len(values)
    z = np.array([[got[i, k + 1].whitened for k in range(len(values))] for i in ids])
    for k, e in enumerate(values):
        own = np.array([got[i, k + 1].whitened for i in ids]) * np.sqrt(e)
        direct = y @ basis[:, k]
        sign = np.sign(own @ direct)
        gap = min(abs(e - f) for j, f in enumerate(values) if j != k) if len(values) > 1 else e
        if gap > 1e-6 * values[0]:
            assert np.allclose(sign * own, direct, rtol=0, atol=EPS * max(1, np.abs(direct).max()) * values[0] / gap)
    assert np.abs(z.T @ z / n - np.eye(len(values))).max() < EPS
    trace = float((y * y).sum() / n)
    for j, i in enumerate(ids):
        for k, e in enumerate(values):
            r = got[i, k + 1]
            assert (r.n, r.deviation) == (n, sum(int(v) ** 2 for v in x[j] * n - sums))
            assert abs(r.explained - e / trace) < EPS and r.identity_error < EPS and r.residual <= 1e-12 * values[0]


def test_query(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    check(queries.QUERIES["op11_whitening"](spark, sf).collect(), vectors)


def test_dropped_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 50)  # blocks of ten rows
    rng = random.Random(1)
    good = {i: [rng.gauss(0, 3.0 / (k + 1)) for k in range(5)] for i in range(60)}
    bad = [(100, None), (101, [1.0, None, 1.0, 1.0, 1.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    rows = [(i, v, 1, "x", 0.5) for i, v in [*good.items(), *bad]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, wide string, whitened double").repartition(4)
    check(whitening.whiten(frame).collect(), good, 5)


@pytest.mark.parametrize("dim", [1, 3, 20])
def test_few_dimensions(spark, dim):
    rng = random.Random(dim)
    vectors = {i: [rng.random() * (k + 1) for k in range(dim)] for i in range(40)}
    frame = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    check(whitening.whiten(frame).collect(), vectors, min(8, dim))


def test_rank_ties_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0])], schema)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0, 3.0]), (None, [2.0, 4.0, 6.0]), (3, [3.0, 6.0, 9.0])], schema)).collect()
    assert [r.component for r in line] == [1, 1, 1] and sum(r.whitened for r in line) == pytest.approx(0, abs=1e-9)
    square = [(k, [float(a), float(b)]) for k, (a, b) in enumerate([(0, 0), (0, 1), (1, 0), (1, 1)])]  # equal eigenvalues
    got = whitening.whiten(spark.createDataFrame(square, schema)).collect()
    assert len(got) == 8 and all(r.identity_error < 1e-9 and r.explained == pytest.approx(0.5) for r in got)


def test_large_entries_and_deviations(spark):
    rows = [(i, [1e4 * i, 1.0 * (i % 7)]) for i in range(300)]  # wide blocks
    got = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for i, v in enumerate(x):
        exact = sum((300 * c - s) ** 2 for c, s in zip(v, sums, strict=True))
        assert got[i].deviation == (exact if exact < 2**63 else None)
    assert {r.deviation is None for r in got.values()} == {True, False}


@pytest.mark.parametrize("spectrum", ["gaps", "close", "groups", "rank"])
def test_pairs_of_known_matrices(spectrum):
    d = 120
    values = {"gaps": 1 / np.arange(1.0, d + 1), "close": 1 + np.linspace(0.1, 0, d), "groups": np.r_[[5.0] * 3, [4.0] * 4, np.full(d - 7, 0.1)], "rank": np.r_[5.0, 4, 3, np.zeros(d - 3)]}[spectrum]
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((d, d)))[0]
    matrix, passes = (q * values) @ q.T, []

    def product(u):
        passes.append(u.shape[1])
        return matrix @ u

    found, vectors, residuals = whitening.leading_pairs(product, d, 8)
    assert np.allclose(found, values[: len(found)], atol=1e-13 * values[0]) and (residuals <= 1e-12 * values[0]).all()
    assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-12 * values[0] and max(passes) <= 20


def test_inner_solver_solves_the_projected_equation():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    matrix = (q * np.arange(1.0, 31)) @ q.T
    basis, shift = q[:, -4:], np.array([30.0, 29.0])
    right = rng.standard_normal((30, 2))
    got = whitening.corrections(lambda u: matrix @ u, basis, shift, right, 40, 1e-12)
    rest = q[:, :-4]
    for j in range(2):
        inner = rest.T @ matrix @ rest - shift[j] * np.eye(26)
        assert np.allclose(got[:, j], rest @ np.linalg.solve(inner, -rest.T @ right[:, j]), atol=1e-8)
