"""Joins, samplers and searches on hot keys against plain or brute-force results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowhelm.operators import graph as G
from flowhelm.operators import gsample as S
from flowhelm.operators import windows as W
from flowhelm.operators.knn import knn_graph
from flowhelm.plans.skew import salted_join


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df.select(*cols).collect()))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, how):
    left = spark.range(500).select("id", F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 9).alias("k"))
    right = spark.range(6).select(F.col("id").cast("int").alias("k"), (F.col("id") * 10).alias("x"))
    assert rows(salted_join(left, right, ["k"], "id", how, hot_rows=50, pieces=8)) == rows(left.join(right, "k", how))


def test_proximity_in_a_crowded_bucket(spark):
    n = spark.range(120).select("id", F.when(F.col("id") < 60, F.col("id") % 5).otherwise(F.col("id") * 3).alias("t_us"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("feat"))
    t = {r["id"]: r["t_us"] for r in n.collect()}
    want = sorted((a, b) for a in t for b in t if a != b and 0 <= t[b] - t[a] <= 10)
    got = G.proximity_edges(n, 10, hot_rows=20).select("src", "dst").collect()
    assert sorted(map(tuple, got)) == want


@pytest.mark.parametrize("pivots,tile", [(1, 16), (7, 16), (20, 1000)])
def test_knn_equals_brute_force(spark, pivots, tile):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(8, 0.1, (40, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r["id"], r["rank"]): (r["neighbour"], r["distance"]) for r in knn_graph(df, "id", "v", 4, tile, pivots).collect()}
    assert len(got) == 400
    for i in range(100):
        d = np.linalg.norm(x - x[i], axis=1)
        d[i] = np.inf
        for rank, j in enumerate(np.argsort(d, kind="stable")[:4], 1):
            assert got[i, rank][0] == j and got[i, rank][1] == pytest.approx(d[j])


def test_dbscan_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    v = np.round(np.concatenate([rng.uniform(0, 100, 80), rng.normal(30, 1, 60)]), 2)
    eps, m = 0.8, 4
    core = np.array([(np.abs(v - a) <= eps).sum() >= m for a in v])
    order = np.sort(v[core])
    starts = np.concatenate([[True], np.diff(order) > eps])
    label = dict(zip(order, np.cumsum(starts) - 1))
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    for r in W.dbscan_1d(df, "v", eps, m, rows_per_block=25).collect():
        near = [label[c] for c in order if abs(c - r["v"]) <= eps]
        want = label[r["v"]] if r["core"] else min(near, default=-1)
        assert r["core"] == core[v == r["v"]].any() and r["cluster"] == want


def test_interval_join_covers_long_and_short_windows(spark):
    events = spark.range(200).select((F.col("id") * 7).alias("t_us"))
    w = spark.createDataFrame([("a", 1.0, 0.0, 3.0), ("b", 1.0, 100.5, 900.25), ("c", 1.0, 64.0, 128.0), ("d", 1.0, 0.0, 1393.0)], W.WINDOW_SCHEMA)
    got = W.assign_windows(events, w).groupBy("scale").count()
    times = [7 * i for i in range(200)]
    want = {"a": 1, "b": sum(100.5 <= t < 900.25 for t in times), "c": sum(64 <= t < 128 for t in times), "d": 200}
    assert {r["scale"]: r["count"] for r in got.collect()} == want


def test_walks_follow_edges_and_stop_at_sinks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "d"), ("c", "a")], "src string, dst string")
    starts = spark.createDataFrame([("a",), ("d",)], "id string")
    got = S.random_walks(e, starts, 6).collect()
    links = {(r["src"], r["dst"]) for r in e.collect()}
    by = {(r["walk"], r["step"]): r["id"] for r in got}
    assert ("d", 1) not in by
    assert all((by[w, s - 1], n) in links for (w, s), n in by.items() if s)


def test_walks_broadcast_counted_successors_only(spark, monkeypatch):
    """Successor tables beyond the counted size are shuffled, however small their files are; the walks stay the same."""
    from flowhelm.plans import lookup

    e = spark.range(300).select(F.concat(F.lit("n"), F.col("id") % 40).alias("src"), F.concat(F.lit("n"), F.col("id") * 7 % 55).alias("dst"))
    starts = e.select(F.col("src").alias("id")).distinct()
    small = S.random_walks(e, starts, 5)
    monkeypatch.setattr(lookup, "BROADCAST_ROWS", 30)
    large = S.random_walks(e, starts, 5)
    assert sorted(map(tuple, large.collect())) == sorted(map(tuple, small.collect()))
    assert "BroadcastHashJoin" not in large._jdf.queryExecution().toString()


def test_weighted_sample_prefers_heavy_nodes_and_handles_zero(spark):
    n = spark.range(100).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") < 5, 1000.0).otherwise(0.0).alias("importance"))
    got = {r["id"] for r in S.sample_nodes_weighted(n, 8).collect()}
    assert len(got) == 8 and {f"n{i}" for i in range(5)} <= got


@pytest.mark.parametrize("leaf,part", [(30, 32 << 20), (12, 600)])
def test_knn_tree_of_bounded_leaves(spark, monkeypatch, leaf, part):
    """Several levels, trees that go out in parts, clusters of many equal vectors: as comparing everything finds them."""
    import numpy as np

    from flowhelm.operators import knn

    monkeypatch.setattr(knn, "PART_BYTES", part)
    monkeypatch.setattr(knn, "QUERIES_PER_TASK", 50)
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(c, 0.05, (60, 3)) for c in rng.normal(0, 3, (7, 3))] + [np.zeros((90, 3)), np.ones((4, 3))]).round(3)
    ids = rng.permutation(len(v))
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "id long, v array<double>").repartition(5)
    got = {(r.id, r.rank): (r.neighbour, r.distance) for r in knn.knn_graph(df, "id", "v", 5, leaf, 4).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for a in range(len(v)):
        order = sorted(range(len(v)), key=lambda b: (d[a, b], ids[b]))[:5]
        assert [got[int(ids[a]), r + 1][0] for r in range(5)] == [int(ids[b]) for b in order]
    assert len(got) == 5 * len(v)
