"""Hand-worked values and independent re-computations."""

import ipaddress
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowhelm.catalog import scoring
from flowhelm.catalog import views as V
from flowhelm.functions import encode as T
from flowhelm.functions.ip import ip_valid
from flowhelm.operators import attention as A
from flowhelm.operators import clean as C
from flowhelm.operators import lifecycle as L
from flowhelm.operators import metrics as M
from flowhelm.operators import sampling as P
from flowhelm.operators import select as S
from flowhelm.operators import windows as W
from flowhelm.sources import files

Y, PRED, PROB = [0, 1, 0, 1, 0, 1, 0, 1], [0, 1, 0, 0, 0, 1, 1, 1], [.1, .8, .2, .4, .3, .7, .6, .8]


def test_eight_labels(spark):
    df = spark.createDataFrame(list(zip(Y, PRED, PROB)), "y int, pred int, p double")
    assert M.accuracy(df).first()[0] == 0.75
    assert {(r.y, r.pred): r.n for r in M.confusion_matrix(df).collect()} == {(0, 0): 3, (0, 1): 1, (1, 0): 1, (1, 1): 3}
    for r in M.per_class(M.counts(df)).collect():
        assert (r.precision, r.recall, r.f1, r.support) == (0.75, 0.75, 0.75, 4)
    assert M.areas(M.points(df)).first().roc_auc == pytest.approx(15 / 16)


def test_confusion_of_a_blind_model(spark):
    cells = spark.createDataFrame([(0, 0, 0), (0, 1, 401), (1, 0, 71), (1, 1, 904428)], "y int, pred int, n long")
    a = M.averages(cells).first()
    assert a.precision_macro == pytest.approx(0.4997784112, abs=1e-9) and a.f1_macro == pytest.approx(0.4998695648, abs=1e-9)
    assert a.precision_weighted == pytest.approx(0.9991138758, abs=1e-9) and a.f1_weighted == pytest.approx(0.9992961024, abs=1e-9)


def test_roc_is_monotone_and_ends_at_one(spark):
    df = spark.createDataFrame(list(zip(Y, PROB)), "y int, p double")
    pts = sorted(M.roc_curve(M.points(df)).collect(), key=lambda r: -r.threshold)
    assert (pts[0].fpr, pts[0].tpr, pts[-1].fpr, pts[-1].tpr) == (0, 0, 1, 1)
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(pts, pts[1:]))


IPS = """1.2.3.4 01.2.3.4 256.1.1.1 ::1 :: 1::2::3 fe80::1%eth0 2001:db8::1 ::ffff:10.0.0.1 ::ffff:8.8.8.8 1:2:3:4:5:6:7:8 1:2:3:4:5:6:7 :1:2:3:4:5:6:7
1::: 100.64.0.1 192.0.0.9 192.0.0.1 2001:4860:4860::8888 64:ff9b:1::1 g::1 12345::1 fc00::1 1.2.3 1:2:3:4:5:6:1.2.3.4 1::2:3:4:5:6:7:8 255.255.255.255
2001:20::1 1:2:3:4:5:6:7:: ::2:3:4:5:6:7:8 x 240.0.0.1 2002::1 172.16.0.1 172.32.0.1 192.168.1.1 169.254.1.1""".split()


def test_ip_features_agree_with_the_standard_library(spark):
    df = spark.createDataFrame([(t,) for t in IPS], "a string").withColumns({"t": F.col("a"), "ok": ip_valid(F.col("a"))})
    for r in C.ip_features(df, ["a"]).collect():
        try:
            ip = ipaddress.ip_address(r.t)
        except ValueError:
            assert (r.ok, r.a_octet_1, r.a_is_private, r.a_is_global) == (False, -1, 0, 0)
            continue
        assert r.ok and bool(r.a_is_private) == ip.is_private and bool(r.a_is_global) == ip.is_global, r.t
        if ip.version == 4:
            assert r.a_subnet_24 == int(ip) // 256 * 256 and r.a_octet_4 == int(ip) % 256


@pytest.mark.parametrize("f,d1,d2,p", [(4.9646, 1, 10, 0.05), (3.0984, 5, 12, 0.0502), (2.3479, 10, 20, 0.05), (6.6349, 1, 10**6, 0.01)])
def test_f_tail_matches_tables(f, d1, d2, p):
    assert S.f_upper_tail(f, d1, d2) == pytest.approx(p, rel=0.01)


def test_selection_drops_copies_constants_and_noise(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("y"), (F.col("id") % 2 * 3 + F.col("id") % 7).cast("double").alias("signal"),
                                 ((F.col("id") % 2 * 3 + F.col("id") % 7) * 2).cast("double").alias("copy"), (F.col("id") * 0 + 0.5).alias("flat"), F.lit(1.0).alias("flow_duration"))
    kept, report = S.feature_selection(df, "y")
    dropped = {r.feature: r.step for r in report.collect()}
    assert dropped["signal"] == "correlated" and dropped["flat"] == "low_variance"
    assert "flow_duration" in kept.columns and "copy" in kept.columns


def test_quota_rules(spark):
    def quotas(rule, counts, *args):
        frame = spark.createDataFrame(list(counts.items()), "label string, n long")
        return {r.label: r.quota for r in rule(frame, "label", *args).collect()}

    assert quotas(P.proportional_quotas, {"a": 5, "b": 3, "c": 2}, 5) == {"a": 3, "b": 1, "c": 1}
    assert quotas(P.proportional_quotas, {"a": 5, None: 5}, 5) == {"a": 3, None: 2}
    assert quotas(P.minimum_quotas, {"a": 1000, "b": 90, "c": 10}, 0.1, 20) == {"a": 100, "b": 20, "c": 10}
    # 60 of 120 rows: floors 50, 5, 5 (all of c); nothing is left. With floors of 2: 50, 5, 5 again by ratio.
    assert quotas(P.minimum_quotas, {"a": 100, "b": 15, "c": 5}, 0.5, 5) == {"a": 50, "b": 7, "c": 5}
    # floors 1, 1, 1 of 3 x 3 rows at 0.5: one row is left and goes to the first of equal classes.
    assert quotas(P.minimum_quotas, {"a": 3, "b": 3, "c": 3}, 0.5, 1) == {"a": 2, "b": 1, "c": 1}
    assert quotas(P.minimum_quotas, {"a": 2, "b": 1}, 0.9, 5) == {"a": 2, "b": 1}  # no class gets more than it has
    assert quotas(P.minimum_quotas, {}, 0.9, 5) == {}


def test_no_label_and_no_rows(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 5 > 0, (F.col("id") % 2).cast("string")).alias("label"))
    split = P.split_train_test(df, "id", "label", 0.2)
    assert split.count() == 100 and split.where("split = 'test'").count() == 20
    assert P.sample_stratified(df, "id", "label", 0.5).count() == 50
    none = df.limit(0)
    assert P.split_train_test(none, "id", "label").count() == 0
    assert P.sample_stratified(none, "id", "label", 0.5).count() == 0


def test_folds_partition_rows_and_balance_classes(spark):
    df = spark.range(103).select("id", (F.col("id") % 3).alias("c"))
    folds = P.kfold_stratified(df, "id", "c", 4)
    test = folds.where("role = 'test'")
    assert test.count() == test.select("id").distinct().count() == 103
    sizes = test.join(df, "id").groupBy("c", "fold").count().groupBy("c").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert all(r.d <= 1 for r in sizes)
    assert folds.groupBy("fold").count().where("count != 103").isEmpty()


def test_softmax_sums_to_one_per_destination(spark, sf):
    scored, _, sides = scoring._scored(spark, sf)
    a = A.edge_softmax(scored, scoring.HEADS, sides)
    sums = a.groupBy("dst").agg(F.sum(F.get("a", 0)).alias("s0"), F.sum(F.get("a", 1)).alias("s1"))
    assert sums.where("abs(s0 - 1) > 1e-9 or abs(s1 - 1) > 1e-9").isEmpty()


def test_two_layers_equal_a_numpy_forward_pass(spark, sf):
    nodes = {r.id: np.array(r.feat) for r in V.node(spark, sf).collect()}
    edges = [(r.src, r.dst, r.t) for r in scoring.edges_with_time(spark, sf).collect()]
    w, b = np.array(scoring.TW), np.array(scoring.TB)
    for layer in scoring.LAYERS:
        incoming = {}
        for s, d, t in edges:
            incoming.setdefault(d, []).append((s, np.cos(w * t + b)))
        x = {i: np.concatenate([f, np.mean([e for _, e in incoming[i]], axis=0) if i in incoming else np.zeros(4)]) for i, f in nodes.items()}
        h = {i: (np.array(layer.weight) @ v + np.array(layer.bias)).reshape(layer.heads, layer.out) for i, v in x.items()}
        left, right, res = np.array(layer.left), np.array(layer.right), np.array(layer.residual)
        new = {}
        for i, f in nodes.items():
            r = np.zeros((layer.heads, layer.out))
            if i in incoming:
                e = np.array([(h[s] * left).sum(1) + (h[i] * right).sum(1) for s, _ in incoming[i]])
                e = np.where(e >= 0, e, 0.01 * e)
                a = np.exp(e - e.max(0))
                a /= a.sum(0)
                r = np.einsum("eh,eho->ho", a, np.array([h[s] for s, _ in incoming[i]]))
            z = r.ravel() + res @ f
            new[i] = np.where(z > 0, z, np.exp(np.minimum(z, 0)) - 1)
        nodes = new
    for r in scoring.tgat_encode(spark, sf).collect():
        assert r.value == pytest.approx(nodes[r.id][r.pos], abs=2e-6)


def test_encodings(spark):
    df = spark.createDataFrame([(0.0,), (7.3,), (3599.9,)], "t double")
    for r in df.select("t", T.time2vec("t", [0.5, 2.0], [0.1, 0.2]).alias("v"), T.bucket_index("t", 3600, 10).alias("b")).collect():
        assert r.v == pytest.approx([0.5 * r.t + 0.1, np.sin(2 * r.t + 0.2)]) and r.b == min(9, int(r.t / 360))
    up, down = T.fourier_frequencies(3), T.fourier_frequencies(3, rising=False)
    assert up == pytest.approx([0.1, 1.0, 10.0]) and down == pytest.approx([0.1, 0.01, 0.001])


def test_wide_projection_uses_batches(spark):
    x = np.arange(40, dtype=float)
    w = np.arange(30 * 40, dtype=float).reshape(30, 40) / 100
    df = spark.createDataFrame([("a", x.tolist())], "id string, feat array<double>")
    assert A.project(df, w.tolist(), [1.0] * 30).first().h == pytest.approx((w @ x + 1).tolist())


def test_scale_rules():
    stats = {"n": 100, "min": 0.1, "q1": 20.0, "median": 50.0, "q3": 90.0, "max": 9000.0}
    got = W.select_scales(stats, False, 0.0, True, ("micro", "small", "medium", "large", "macro"))
    assert got == [("micro", 0.5), ("micro", 1.0), ("micro", 2.5), ("small", 20.0), ("small", 40.0), ("small", 100.0), ("medium", 50.0), ("large", 180.0), ("large", 360.0), ("macro", 4500.0)]
    assert W.select_scales(stats | {"n": 2}, False, 0.0, False) == [("medium", 300.0)]


def test_period_of_a_repeating_pattern(spark):
    gaps, t, rows = [1, 1, 1, 10], 0, []
    for i in range(200):
        t += gaps[i % 4] * 1_000_000
        rows.append((i, t))
    df = spark.createDataFrame(rows, "id int, t_us long")
    g = W.gaps(df, ["t_us", "id"])
    stats = W.gap_statistics(g)
    assert W.estimate_period(W.autocorrelation(g, ["t_us", "id"], stats), stats) == 4.0
    assert W.windows_for_pattern(df, ["t_us", "id"], "periodic").where("scale = 'periodic'").count() > 100


def test_windows_cover_every_event(spark, sf):
    f = V.flow(spark, sf)
    t0, t1 = W.span(f)
    w = W.generate_windows(spark, [("a", 10.0), ("b", 86400.0)], t0, t1)
    joined = W.assign_windows(f.select("flow_id", "t_us"), w)
    assert joined.groupBy("scale").agg(F.count_distinct("flow_id").alias("n")).where(F.col("n") != f.count()).isEmpty()


def test_windows_of_all_default_scales(spark, sf):
    """Micro windows come whole, in parts of executors, and the windows of an event without making the empty ones."""
    from flowhelm.catalog.registry import QUERIES

    rng = np.random.default_rng(3)
    times = np.concatenate([[0], np.cumsum(rng.integers(100_000, 90_000_000, 400)), [20_000_000_000]])
    df = spark.createDataFrame([(i, int(t), float(i % 7)) for i, t in enumerate(times)], "flow_id long, t_us long, bytes double")
    scales = W.analyse(df, ["t_us", "flow_id"])[1]
    t0, t1 = W.span(df)
    windows = W.generate_windows(spark, scales, t0, t1)
    want = {}
    for scale, size in scales:
        want[scale] = want.get(scale, 0) + int(np.ceil((t1 - t0) / (size * 1e6)))
    assert {r.scale: r.n_windows for r in W.windows_per_scale(windows).collect()} == want and want["micro"] > 50_000
    rows = lambda d: sorted((r.flow_id, r.scale, r.size_s, r.start_us, r.end_us) for r in d.collect())
    assert rows(W.assign_generated(df, scales, t0, t1)) == rows(W.assign_windows(df, windows))
    coarse, whole = (QUERIES[f"events_in_windows{x}"](spark, sf).collect() for x in ("_coarse", ""))
    assert sorted(coarse) == sorted(r for r in whole if r.scale != "micro")
    events = V.flow(spark, sf).count()
    assert sum(r.n for r in whole if (r.scale, r.size_s) == ("micro", 0.5)) == events


def test_median_impute_keeps_whole_columns_untouched(spark):
    df = spark.createDataFrame([(1.0, 1), (None, 2), (float("nan"), 3), (4.0, 4), (9.0, 5)], "a double, b int")
    assert [r.a for r in C.impute_median(df).orderBy("b").collect()] == [1.0, 4.0, 4.0, 4.0, 9.0]


def test_rebucket_needs_a_positive_size(spark, sf):
    with pytest.raises(ValueError):
        L.rebucket(L.sightings(V.edge(spark, sf)), 10, 0)


def test_bad_prepared_data_is_refused(spark, tmp_path):
    data = spark.createDataFrame([(0, [1.0, 2.0], 0, "train"), (1, [1.0], 1, "test")], "row_id long, features array<double>, target int, split string")
    files.save_prepared(str(tmp_path / "p"), data, names=spark.createDataFrame([(0, "a"), (1, "b")], "pos int, name string"))
    with pytest.raises(ValueError):
        files.load_prepared(spark, str(tmp_path / "p"))


def test_no_readable_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("nothing")
    with pytest.raises(ValueError):
        files.scan_skip_bad_files(spark, str(tmp_path), "a long")


def test_no_detections_write_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.2, False)], "batch int, score double, alert boolean")
    assert not files.sink_detections_json(df, str(tmp_path / "d")) and not (tmp_path / "d").exists()
    assert files.sink_detections_json(df.withColumn("alert", F.lit(True)), str(tmp_path / "d"))
    found = [json.loads(x) for f in (tmp_path / "d").glob("part-*") for x in f.read_text().splitlines()]
    assert found == [{"batch": 1, "score": 0.2, "alert": True}]
