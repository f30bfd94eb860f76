"""Order statistics and hash quotas by selection against sorted lists and plain windows."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowhelm.functions.scalar import seeded_hash
from flowhelm.operators import clean as C
from flowhelm.operators import sampling as P
from flowhelm.operators import select as S
from flowhelm.operators import windows as W
from flowhelm.plans import ranks as R


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(
        i, rng.gauss(0, 1), float(rng.choice([1, 1, 1, 1, 2, 3])), rng.choice([None, math.nan, math.inf, -math.inf, rng.random()]), rng.randrange(10**12),
        "hot" if i % 3 else rng.choice([None, "a", "b"])) for i in range(4000)]
    return rows, spark.createDataFrame(rows, "id long, normal double, ties double, odd double, whole long, key string").repartition(5).cache()


def plain(c):
    def column(rows, i):
        return sorted(float(r[i]) for r in rows if r[i] is not None and not math.isnan(r[i]))

    return column(c, 1), column(c, 2), column(c, 3), column(c, 4)


@pytest.mark.parametrize(("accuracy", "inside"), [(10_000, 200_000), (10, 1), (20, 40), (3, 1000)])
def test_order_statistics(table, accuracy, inside):
    rows, df = table
    lists = dict(zip(("normal", "ties", "odd", "whole"), plain(rows), strict=True))
    wanted = {c: [1, 2, len(v) // 4, len(v) // 2, len(v) - 1, len(v)] for c, v in lists.items()}
    got = R.order_statistics(df, wanted, {c: len(v) for c, v in lists.items()}, accuracy=accuracy, inside_rows=inside)
    assert got == {c: {r: lists[c][r - 1] for r in wanted[c]} for c in lists}
    assert R.order_statistics(df.limit(0), {"normal": []}, {"normal": 0}) == {"normal": {}}


def test_median_and_quartiles_shuffle_no_cells(table, spark):
    rows, df = table
    got = C.medians(df, ["normal", "ties", "odd"])
    for c, values in zip(("normal", "ties", "odd"), plain(rows), strict=False):
        assert got[c] == R.interpolated(dict(enumerate(values, 1)), len(values), 0.5)
    g = df.select(F.col("normal").alias("gap"))
    stats, values = W.gap_statistics(g), plain(rows)[0]
    for k, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        assert stats[k] == R.interpolated(dict(enumerate(values, 1)), len(values), p)
    assert W.gap_statistics(g.limit(0))["median"] is None


def test_mutual_information(table, spark):
    """Bins from the definition: rows below a value, times bins, over all rows; missing first, NaN last."""
    rows, df = table
    got = {r.feature: r.mi for r in S.mutual_info(df, ["normal", "ties", "odd", "whole"], "key").collect()}
    for at, name in ((1, "normal"), (2, "ties"), (3, "odd"), (4, "whole")):
        def order(v):
            return (0, 0.0) if v is None else (2, 0.0) if math.isnan(v) else (1, v)

        values = sorted(order(r[at]) for r in rows)
        first = {}
        for k, v in enumerate(values):
            first.setdefault(v, k)
        n = len(rows)
        cells = Counter((first[order(r[at])] * 32 // n, r[5]) for r in rows)
        by_bin, by_key = Counter(), Counter()
        for (b, k), c in cells.items():
            by_bin[b] += c
            by_key[k] += c
        want = sum(c / n * math.log(c * n / (by_bin[b] * by_key[k])) for (b, k), c in cells.items())
        assert got[name] == pytest.approx(want, abs=1e-12)


def ranked(df, keys, seed):
    h = F.coalesce(seeded_hash("id", seed), F.lit(""))
    return df.withColumn("_rk", F.row_number().over(Window.partitionBy(*keys).orderBy(h)))


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_quotas(table, spark, digits):
    _, df = table
    quotas = spark.createDataFrame([("hot", 777), ("a", 0), ("b", 10**6), (None, 13)], "key string, quota long")
    got = {r.id for r in R.mark_quota(df, "id", "s", quotas, ["key"], digits=digits).where("_in").collect()}
    limit = {"hot": 777, "a": 0, "b": 10**6, None: 13}
    assert {r.id for r in ranked(df, ["key"], "s").collect() if r._rk <= limit[r.key]} == got
    whole = {r.id for r in R.mark_quota(df, "id", "s", 1234, digits=digits).where("_in").collect()}
    assert whole == {r.id for r in ranked(df, [], "s").where("_rk <= 1234").collect()}


def test_repeated_and_missing_ids(spark):
    rows = [(None, "x")] * 5 + [(1, "x")] * 700 + [(k, "x") for k in range(2, 300)]
    df = spark.createDataFrame(rows, "id long, key string").repartition(4)
    for k in (0, 3, 5, 6, 100, 500, 1002, 1003):
        marked = P.mark_quota(df, "id", "0", k)
        assert marked.columns == ["id", "key", "_in"] and marked.count() == 1003 and marked.where("_in").count() == k
    assert P.sample_batch(df, "id", 2000).count() == 1003
    stored = spark.createDataFrame([(1, "test"), (1, "train"), (2, "test")], "id long, split string")
    again = P.split_reuse(P.split_train_test(df, "id", "key"), stored, "id")
    assert again.count() == 1003 and {r.split for r in again.where("id = 1").collect()} == {"train"} and again.where("id = 2").first().split == "test"


def test_rows_are_not_shuffled(table):
    """Splits and samples move hashes near a cut and counts, never the other columns."""
    _, df = table
    wide = df.selectExpr("*", "repeat('x', 100) AS payload")
    for frame in (P.split_train_test(wide, "id", "key"), P.sample_stratified(wide, "id", "key", 0.3), P.sample_random(wide, "id", 0.3), P.sample_batch(wide, "id", 99)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "payload" in plan and "Exchange hashpartitioning" not in plan and "SinglePartition" not in plan


def test_one_class_of_two_thirds(table):
    rows, df = table
    sizes = Counter(r[5] for r in rows)
    split = P.split_train_test(df, "id", "key", 0.25)
    test = {r.key: r["count"] for r in split.where("split = 'test'").groupBy("key").count().collect()}
    assert sum(test.values()) == 1000 and all(abs(test[k] - n / 4) <= 1 for k, n in sizes.items())
