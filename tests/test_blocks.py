"""Blocked ordered operations equal the plain windows, also when one key holds most rows."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowhelm.functions.scalar import seeded_hash
from flowhelm.operators import features as X
from flowhelm.operators import history as H
from flowhelm.operators import metrics as M
from flowhelm.operators import sampling as P
from flowhelm.operators import select as S
from flowhelm.operators import windows as W
from flowhelm.plans import ordered as O
from flowhelm.plans.skew import salted_join

SMALL = 40


@pytest.fixture(scope="module")
def skewed(spark):
    """1200 rows; key 'hot' has two thirds of them, with many equal times."""
    return spark.range(1200).select(
        F.col("id"), F.when(F.col("id") % 3 != 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("key"),
        (F.pmod(F.xxhash64("id"), F.lit(300)) * 500_000).alias("t_us"), (F.col("id") * 37 % 101).cast("double").alias("v"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 4).alias("n"))


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda df: sorted(map(str, df.select(*cols).collect()))
    assert rows(a) == rows(b)


def test_blocks_are_ranges(skewed):
    placed, n = O.blocks(skewed, ["t_us", "id"], SMALL)
    assert n > 10
    edges = placed.groupBy("_blk").agg(F.min(F.struct("t_us", "id")).alias("lo"), F.max(F.struct("t_us", "id")).alias("hi"), F.count("*").alias("c")).orderBy("_blk").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(edges, edges[1:]))
    assert max(e["c"] for e in edges) < 10 * SMALL and sum(e["c"] for e in edges) == 1200


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_number_and_sums(skewed, keys):
    w = Window.partitionBy(*keys).orderBy("t_us", "id")
    want = skewed.withColumns({"rn": F.row_number().over(w).cast("long"), "s": F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    got = O.running_sums(O.number(skewed, ["t_us", "id"], keys, rows_per_block=SMALL), ["t_us", "id"], {"s": F.col("v")}, keys, SMALL)
    same(got, want)


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_running_maximum(skewed, keys):
    w = Window.partitionBy(*keys).orderBy("t_us", "id").rowsBetween(Window.unboundedPreceding, 0)
    got = O.running_sums(skewed, ["t_us", "id"], {"m": F.col("n")}, keys, SMALL, largest=True)
    same(got, skewed.withColumn("m", F.max("n").over(w)))


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_neighbours(skewed, keys):
    w = Window.partitionBy(*keys).orderBy("t_us", "id")
    want = skewed.withColumns({"p": F.lag("n").over(w), "q": F.lead("v").over(w)})
    same(O.neighbours(skewed, ["t_us", "id"], {"p": "n"}, {"q": "v"}, keys, SMALL), want)


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_hash_number(skewed, keys):
    h = skewed.withColumn("h", seeded_hash("id", "x"))
    want = h.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("h")).cast("long"))
    same(O.hash_number(h, "h", keys, rows_per_block=SMALL), want)


def test_percentiles(skewed):
    want = skewed.groupBy("key").agg(F.percentile("v", 0.25).alias("a"), F.median("v").alias("b")).collect()
    got = {(r["key"], r["p"]): r["value"] for r in O.percentiles(skewed, "v", [0.25, 0.5], ["key"], SMALL).collect()}
    for r in want:
        assert got[r["key"], 0.25] == pytest.approx(r["a"]) and got[r["key"], 0.5] == pytest.approx(r["b"])


def test_row_halo(skewed):
    rows = O.number(skewed, ["id"])
    w = Window.orderBy("rn").rowsBetween(-5, 3)
    cut = O.row_halo(rows, "rn", 5, 3, 50)
    got = cut.withColumn("s", F.sum("v").over(Window.partitionBy("_blk").orderBy("rn").rowsBetween(-5, 3))).where("_own").drop("_own", "_blk")
    same(got, rows.withColumn("s", F.sum("v").over(w)))


@pytest.mark.parametrize("run", [
    lambda d, n: X.time_delta_features(d, "key", "t_us", "id", (1, 5, 60), n),
    lambda d, n: X.rolling(d, ["t_us", "id"], 7, {"m": F.max("v"), "c": F.count("v")}, n),
    lambda d, n: W.session_bursts(d, "key", ["t_us", "id"], 1_000_000, rows_per_block=n),
    lambda d, n: W.dbscan_1d(d, "t_us", 900_000, 3, rows_per_block=n),
    lambda d, n: W.dbscan_1d(d, "t_us", 2_600_000, 4, ["key"], n),
    lambda d, n: P.sample_stratified(d, "id", "key", 0.3, rows_per_block=n),
    lambda d, n: P.split_train_test(d, "id", "key", 0.2, rows_per_block=n),
    lambda d, n: P.kfold_stratified(d, "id", "key", 4, rows_per_block=n),
    lambda d, n: P.kfold_plain(d, "id", ["id"], 7, n),
    lambda d, n: P.kfold_time(d, "id", ["t_us", "id"], 4, rows_per_block=n),
    lambda d, n: P.sample_systematic(d, ["id"], 0.2, n),
    lambda d, n: M.points(d.withColumn("y", F.col("id") % 2), p="v", cls="key", rows_per_block=n),
    lambda d, n: H.early_stop_epoch(O.number(d, ["id"], ["key"], "epoch"), "key", "epoch", "v", "t_us", 5, n),
    lambda d, n: W.gaps(d, ["t_us", "id"], keys=["key"], rows_per_block=n),
])
def test_operator_does_not_depend_on_blocks(skewed, run):
    same(run(skewed, SMALL), run(skewed, 10_000))


def test_autocorrelation_blocks(skewed):
    g = W.gaps(skewed, ["t_us", "id"])
    stats = W.gap_statistics(g)
    got = {r["lag"]: r["r"] for r in W.autocorrelation(g, ["t_us", "id"], stats, 150).collect()}
    x = [r["gap"] - stats["mean"] for r in g.orderBy("t_us", "id").collect()]
    n = len(x)
    assert len(got) == 100
    for k in (1, 7, 100):
        assert got[k] == pytest.approx(sum(a * b for a, b in zip(x, x[k:])) / ((n - k) * stats["std"] ** 2))


def test_null_keys_and_ids_survive_blocks(spark):
    """Blocked and plain paths agree, and no row is lost, when labels, entities and ids are missing."""
    df = spark.range(200).select(
        F.when(F.col("id") % 11 > 0, F.col("id")).alias("id"), F.when(F.col("id") % 5 > 0, (F.col("id") % 3).cast("string")).alias("label"),
        (F.col("id") * 700_000 % 9_000_000).alias("t_us")).cache()
    for block in (40, 100_000):
        assert P.kfold_stratified(df.where("id IS NOT NULL"), "id", "label", 4, rows_per_block=block).where("role = 'test'").count() == 181
        assert P.split_train_test(df, "id", "label", rows_per_block=block).count() == 200
        assert P.sample_stratified(df, "id", "label", 0.5, rows_per_block=block).count() == 100
        assert O.hash_number(df.withColumn("_h", F.md5(F.col("id").cast("string"))), "_h", ["label"], "n", block).count() == 200
    results = [sorted(map(str, X.forward_counts(df, "label", "t_us", (1, 3), block).collect())) for block in (40, 100_000)]
    assert len(results[0]) == 200 and results[0] == results[1]
    joined = salted_join(df, df.groupBy("label").count(), ["label"], "id", hot_rows=10)
    assert joined.count() == 200


def test_correlations_with_nulls_take_one_path(spark):
    wide = spark.range(60).select(*[F.when(F.col("id") % (k + 2) > 0, F.sin(F.col("id") * (k + 1))).alias(f"c{k}") for k in range(20)])
    got = {(r.a, r.b): r["corr"] for r in S.corr_matrix(wide, wide.columns).collect()}
    few = {(r.a, r.b): r["corr"] for r in S.corr_matrix(wide, ["c3", "c7", "c19"]).collect()}
    assert len(got) == 190 and all(abs(got[k] - v) < 1e-12 for k, v in few.items())


def test_null_keys_keep_windows_cells_and_percentiles(spark):
    rows = [(None if i % 2 else "a", 1_000_000 * (i // 2 % 7) + i // 14 * 10**9) for i in range(84)]
    events = spark.createDataFrame(rows, "key string, t_us long")
    got = sorted(map(str, W.burst_windows(events, keys=["key"]).drop("key").collect()))
    alone = [sorted(map(str, W.burst_windows(events.where(c), keys=["key"]).drop("key").collect())) for c in ("key IS NULL", "key = 'a'")]
    assert got and got == sorted(alone[0] + alone[1]) and alone[0] == alone[1]
    cells = M.confusion_matrix(spark.createDataFrame([(1, 1), (1, None), (None, 1), (None, None)], "y int, pred int"))
    assert {(r.y, r.pred): r.n for r in cells.collect()} == {(a, b): 1 for a in (1, None) for b in (1, None)}
    halves = O.percentiles(events.withColumn("v", F.col("t_us").cast("double")), "v", [0.5], ["key"])
    assert {r.key for r in halves.collect()} == {None, "a"}


def test_eighty_columns_in_one_scan(spark, tmp_path):
    """Columns with gaps, constants and large offsets; the parts of many tasks meet."""
    wide = spark.range(500).repartition(9).select(*[
        F.when((F.col("id") * (k + 3)) % 11 > 0, F.sin(F.col("id") * (k + 1)) + (10**7 if k % 5 == 0 else 0)).alias(f"c{k}") for k in range(78)], F.lit(0.1).alias("c78"), F.lit(None).cast("double").alias("c79"))
    wide.write.parquet(str(tmp_path / "wide"))
    stored = spark.read.parquet(str(tmp_path / "wide"))
    frame = S.corr_matrix(stored, stored.columns)
    assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = {(r.a, r.b): r["corr"] for r in frame.collect()}
    assert len(got) == 80 * 79 // 2 and all(v is None for (a, b), v in got.items() if b in ("c78", "c79"))
    data = stored.toPandas()
    for a, b in (("c0", "c5"), ("c0", "c1"), ("c7", "c70"), ("c35", "c77")):
        pair = data[[a, b]].dropna()
        assert got[a, b] == pytest.approx(abs(pair[a].corr(pair[b])), abs=1e-8)
    nan = S.corr_matrix(spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, float("nan"), None), (3.0, 5.0, 4.0)], "a double, b double, c double"), ["a", "b", "c"])
    found = {(r.a, r.b): r["corr"] for r in nan.collect()}
    assert found["a", "b"] != found["a", "b"] and found["a", "c"] == pytest.approx(1.0) and found["b", "c"] == pytest.approx(1.0)


def test_thousands_of_lags(spark):
    """Blocks far shorter and longer than the longest lag, against numpy."""
    import numpy as np

    x = np.random.default_rng(2).gamma(2.0, 3.0, 15_100).round(6)
    g = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id long, gap double").repartition(6)
    stats = W.gap_statistics(g)
    y = x - x.mean()
    want = np.correlate(y, y, "full")[len(y) :][:5000] / ((len(y) - np.arange(1, 5001)) * x.std() ** 2)
    for block in (700, 6000, 2_000_000):
        got = {r.lag: r.r for r in W.autocorrelation(g, ["id"], stats, block, max_lag=5000).collect()}
        assert len(got) == 5000 and np.allclose([got[k] for k in range(1, 5001)], want, atol=1e-9)
