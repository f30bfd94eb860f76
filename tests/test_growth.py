"""Steps whose cost has to follow the input: what is read once, kept small or shuffled."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowhelm.operators import graph as G
from flowhelm.operators import history as H
from flowhelm.operators import knn
from flowhelm.operators import ml as M
from flowhelm.plans import ordered, reach
from flowhelm.streaming import jobs as J
from flowhelm.streaming import state as S


def test_early_stop_orders_its_rows_once(spark, monkeypatch):
    rows = [(r, e, [0.1, 0.5, 0.5, 0.2, 0.5, 0.4, 0.9, 0.1][e - 1] * r, 1) for r in (1, 2) for e in range(1, 9)] + [(3, 1, 1.0, 0), (None, 1, 2.0, 0), (None, 2, None, 0)]
    df = spark.createDataFrame(rows, "run int, epoch int, f1 double, loss int")
    calls, cut = [], ordered.cut_rows
    monkeypatch.setattr(ordered, "cut_rows", lambda *a, **k: calls.append(1) or cut(*a, **k))
    got = {r.run: r.stop_epoch for r in H.early_stop_epoch(df, "run", "epoch", "f1", "loss", 3, 4).collect()}
    assert got == {1: 5, 2: 5, 3: None, None: None}
    assert len(calls) == 1


@pytest.mark.parametrize("short", [False, True])
def test_a_pair_in_reach_costs_one_written_product(spark, short):
    rows = [(i, i * 3, [float(i), 2.0, -1.0][: 2 if short and i == 4 else 3]) for i in range(9)] + [(9, 5, None)]
    nodes = spark.createDataFrame(rows, "id int, t_us long, feat array<double>")
    got = G.proximity_edges(nodes, 7)
    want = {(a, b) for a, s, _ in rows for b, t, _ in rows if a != b and 0 <= t - s <= 7}
    found = {(r.src, r.dst): r.similarity for r in got.collect()}
    assert found.keys() == want
    a, b = np.array(rows[2][2]), np.array(rows[3][2])
    assert found[2, 3] == pytest.approx(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b) + 1e-8), abs=1e-12)
    assert all((found[p] is None) == (9 in p or (short and 4 in p)) for p in found)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert short or "zip_with" not in plan[: plan.index("Join")]


def test_knn_queries_leave_in_bounded_batches(spark, monkeypatch):
    v = np.random.default_rng(2).normal(size=(300, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").coalesce(1)
    whole = sorted(map(tuple, knn.knn_graph(df, "id", "v", 4, 30, 4).collect()))
    monkeypatch.setattr(knn, "ROWS_OUT_BYTES", 400)
    assert sorted(map(tuple, knn.knn_graph(df, "id", "v", 4, 30, 4).collect())) == whole


def _shuffled(plan):
    """Rows written by all shuffles of a plan that has run."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return _shuffled(plan.finalPhysicalPlan())
    if "QueryStage" in name:
        return _shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" else 0
    below, children = own, plan.children().iterator()
    while children.hasNext():
        below += _shuffled(children.next())
    return below


def test_a_node_in_reach_of_others_is_shuffled_about_once(spark):
    nodes = spark.range(2000).select("id", (F.col("id") * 100).alias("t_us"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("feat"))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = G.proximity_edges(nodes, 700)
        assert len(got.collect()) == 7 * 2000 - 28
        assert _shuffled(got._jdf.queryExecution().executedPlan()) < 1.5 * 2000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)


@pytest.mark.parametrize("hot_rows", [5_000_000, 300])
def test_proximity_over_borders_of_cells_and_batches(spark, monkeypatch, hot_rows):
    """Negative and equal times, crowds at one time, missing ids, times and values, batches and results cut small."""
    rng = np.random.default_rng(8)
    t = np.concatenate([rng.integers(-400, 400, 150), np.full(40, 160), np.full(25, 159)]).tolist()
    rows = [(i if i % 29 else None, int(s) if i % 31 else None, None if i % 37 == 5 else [float(i), None if i % 41 == 7 else 2.0, -0.5][: 2 if i % 7 == 3 else 3]) for i, s in enumerate(t)]
    nodes = spark.createDataFrame(rows, "id int, t_us int, feat array<double>").repartition(5)
    monkeypatch.setattr(reach, "PAIRS_OUT", 9)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = G.proximity_edges(nodes, 10, hot_rows=hot_rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    whole = [r for r in rows if r[0] is not None and r[1] is not None]
    want = {(a[0], b[0]): (a, b) for a in whole for b in whole if a[0] != b[0] and 0 <= b[1] - a[1] <= 10}
    assert len(found) == len(want)
    for r in found:
        a, b = want[r.src, r.dst]
        assert (r.t_us, r.dt) == (b[1], pytest.approx((b[1] - a[1]) / 1e6))
        if a[2] is None or b[2] is None or len(a[2]) != len(b[2]) or None in a[2] or None in b[2]:
            assert r.similarity is None
        else:
            x, y = np.array(a[2]), np.array(b[2])
            assert r.similarity == pytest.approx(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y) + 1e-8), abs=1e-12)


@pytest.mark.parametrize("members,levels", [(64 << 20, 10), (2000, 10), (2000, 1)])
def test_knn_copies_no_vector_for_the_leaves_it_asks(spark, monkeypatch, members, levels):
    """Random vectors ask nearly every leaf; stored are as many vectors as there are, whether members go out in one part or in many, from
    leaves or from pieces of leaves that couldn't be split."""
    v = np.random.default_rng(4).normal(size=(300, 8))
    v[290:] = v[280]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    rows, write = [], knn.stored

    def store(table, *name):
        done = write(table, *name)
        rows.append(done.count() if "_v" in done.columns else 0)
        return done

    monkeypatch.setattr(knn, "stored", store)
    monkeypatch.setattr(knn, "MEMBER_BYTES", members, raising=False)
    monkeypatch.setattr(knn, "MOST_LEVELS", levels)
    monkeypatch.setattr(knn, "QUERIES_PER_TASK", 40)
    got = {(r.id, r.rank): (r.neighbour, r.distance) for r in knn.knn_graph(df, "id", "v", 4, 10, 4).collect()}
    assert max(rows) == 300
    far = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(far, np.inf)
    want = {(a, rank): (b, pytest.approx(far[a, b])) for a in range(300) for rank, b in enumerate(np.argsort(far[a], kind="stable")[:4].tolist(), 1)}
    assert got == want


def _counted(spark, rows):
    """Rows whose every computation is counted."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    return rows.mapInPandas(count, rows.schema), seen


def _points(spark):
    return spark.range(80).select("id", (F.col("id") % 2).cast("double").alias("label"), F.array(F.col("id") % 2 + F.rand(3), F.rand(4)).alias("f"))


def test_training_steps_read_stored_rows(spark):
    counted, seen = _counted(spark, _points(spark))
    rows = counted.select("id", "label", array_to_vector("f").alias("features"))
    M.train_early_stop(rows.where("id < 60"), rows.where("id >= 60"), steps=(2, 4, 8))
    assert seen.value == 2 * 80


def test_encodings_and_trials_share_the_means_of_neighbours(spark, monkeypatch):
    calls, means = [], M.neighbour_means
    monkeypatch.setattr(M, "neighbour_means", lambda *a, **k: calls.append(1) or means(*a, **k))
    counted, seen = _counted(spark, _points(spark).withColumnRenamed("f", "feat"))
    edges = spark.range(200).select(F.col("id").alias("flow_id"), (F.col("id") % 80).alias("src"), (F.col("id") * 7 % 80).alias("dst"), F.col("id").cast("double").alias("t"))
    split = spark.range(80).select("id", F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    encodings = {n: (lambda t, k=k: F.array(F.cos(t * k), F.sin(t)), 2) for k, n in enumerate("abc", 1)}
    got = M.encoding_comparison(edges, counted, 2, encodings, split)
    assert got.count() == 3 and got.where("best").count() >= 1
    assert len(calls) == 1 and seen.value == 80


class _Handle:
    def __init__(self):
        self.calls = []

    def __getattr__(self, name):
        return lambda *a: self.calls.append(name) or (None if name == "get" else self)


def test_a_node_costs_three_calls_of_its_state(spark):
    from pyspark.sql import Row

    handle = _Handle()
    lives = S.NodeLives(10)
    lives.init(handle)
    handle.calls.clear()
    out = list(lives.handleInputRows(("a",), iter([Row(id="a", t_us=5), Row(id="a", t_us=9), Row(id="a", t_us=40)]), None))
    assert [(r.first_us, r.last_us, r.activity) for r in out] == [(5, 9, 2), (40, 40, 1)]
    assert sorted(handle.calls) == ["get", "registerTimer", "update"]


def test_found_edges_are_plain_rows(spark):
    from pyspark.sql import Row

    into = S.EdgesInto(100, 1)
    into.edges = type("E", (), {"get": lambda self: iter([])})()
    row = Row(id="a", kind="found", dst="d", src="a", t_us=3, flow_id=1, bytes=1.0, hop=0)
    assert list(into.handleInputRows(("a",), iter([row]), None)) == [Row(dst="d", src="a", t_us=3, flow_id=1, bytes=1.0, hop=0)]


def test_edges_without_a_time_are_in_no_window(spark):
    from pyspark.sql import Row

    into = S.EdgesInto(100, 0)
    into.edges = type("E", (), {"get": lambda self: iter([]), "put": lambda self, rows: None, "clear": lambda self: None, "appendList": lambda self, rows: None})()
    rows = [Row(id="d", kind="edge", dst="d", src=s, t_us=t, flow_id=f, bytes=None, hop=None) for s, t, f in (("a", None, 1), ("b", 7, 2))]
    ask = Row(id="d", kind="ask", dst="d", src="a", t_us=None, flow_id=1, bytes=None, hop=None)
    assert [(r.src, r.t_us) for r in into.handleInputRows(("d",), iter([*rows, ask]), None)] == [("b", 7)]
    assert [(r.src, r.t_us) for r in into.handleInputRows(("d",), iter([ask]), None)] == [(None, None)]


def test_an_event_of_the_stream_join_is_held_once_a_cell(spark):
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("flow_id"), F.unix_micros("timestamp").alias("t_us"), F.col("timestamp").alias("ts"))
    plan = J.proximity_join(stream, stream, 60)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Generate ") == 1
