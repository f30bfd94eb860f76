"""Statistical feature selection. Row data is aggregated on the cluster; decisions use per-column numbers."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowhelm.operators.clean import impute_median, long_form
from flowhelm.plans.ranks import order_statistics, points_below
from flowhelm.plans.skew import null_safe_join
from flowhelm.session import stored

# Name parts of columns that selection always keeps.
ALWAYS_KEPT_PARTS = ["_octet", "_subnet", "_is_private", "_is_global", "time", "duration"]


def _batch_moments(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Over the rows in which both columns of a pair have values: how many, the mean of the first column, its squared deviations and the products
    of both columns' deviations; and rows with a NaN in either. Sums are taken from the first value of a column, so constants stay exact."""
    d = x.shape[1]
    there = ~np.isnan(x)
    start = np.array([x[there[:, j], j][0] if there[:, j].any() else 0.0 for j in range(d)])
    z, m = np.where(there, x - start, 0.0), there.astype(float)
    n = m.T @ m
    safe = np.where(n > 0, n, 1.0)
    first, squares, products = z.T @ m, (z * z).T @ m, z.T @ z
    mean = first / safe
    return n, start[:, None] + mean, squares - first * mean, products - first * first.T / safe


def _merge_moments(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    (na, ma, va, ca), (nb, mb, vb, cb) = a, b
    n = na + nb
    safe = np.where(n > 0, n, 1.0)
    d = np.where((na > 0) & (nb > 0), mb - ma, 0.0)
    w = na * nb / safe
    return n, np.where(na > 0, ma + d * nb / safe, mb), va + vb + w * d * d, ca + cb + w * d * d.T


_PARTS = "n double, mean_a double, mean_b double, dev_a double, dev_b double, prod double"


def co_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, dev_a, dev_b, prod, nan) of all pairs i < j from one scan: every task adds up matrices of its Arrow batches and gives one row
    a pair; these meet around the means of the first. ``nan`` counts rows of a pair with a NaN."""
    d = len(columns)
    upper = np.triu_indices(d, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, nan = None, np.zeros((d, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            null = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in batch.columns])
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            nan += (np.isnan(x) & ~null).astype(float).T @ (~null).astype(float)
            part = _batch_moments(x)
            total = part if total is None else _merge_moments(total, part)
        if total is not None:
            n, mean, dev, prod = total
            values = [*upper, n[upper], mean[upper], mean.T[upper], dev[upper], dev.T[upper], prod[upper], (nan + nan.T)[upper]]
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["i", "j", "n", "mean_a", "mean_b", "dev_a", "dev_b", "prod", "nan"])

    cells = df.select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(columns)])
    parts = cells.mapInArrow(run, f"i long, j long, {_PARTS}, nan double")
    fields = [f.split()[0] for f in _PARTS.split(", ")]
    lists = parts.groupBy("i", "j").agg(F.sum("nan").alias("nan"), F.filter(F.collect_list(F.struct(*fields)), lambda x: x["n"] > 0).alias("p")).withColumn("first", F.get("p", 0))

    def total(value) -> Column:
        return F.aggregate("p", F.lit(0.0), lambda t, x: t + value(x))

    def a(x: Column) -> Column:
        return x["mean_a"] - F.col("first.mean_a")

    def b(x: Column) -> Column:
        return x["mean_b"] - F.col("first.mean_b")

    sums = lists.select(
        "i", "j", "nan", total(lambda x: x["n"]).alias("n"), total(lambda x: x["n"] * a(x)).alias("sa"), total(lambda x: x["n"] * b(x)).alias("sb"),
        total(lambda x: x["dev_a"] + x["n"] * a(x) * a(x)).alias("da"), total(lambda x: x["dev_b"] + x["n"] * b(x) * b(x)).alias("db"),
        total(lambda x: x["prod"] + x["n"] * a(x) * b(x)).alias("dp"))

    def less(value: str, one: str, other: str) -> Column:
        return F.col(value) - F.coalesce(F.try_divide(F.col(one) * F.col(other), F.col("n")), F.lit(0.0))

    return sums.select("i", "j", "n", less("da", "sa", "sa").alias("dev_a"), less("db", "sb", "sb").alias("dev_b"), less("dp", "sa", "sb").alias("prod"), "nan")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """|Pearson| of every column pair, upper triangle: (a, b, corr). A row counts for the pairs it has both values of. All pairs
    come from one scan; null when a column is constant in the pair's rows, NaN when there is a NaN among them."""
    columns = list(columns)
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    names = F.array(*[F.lit(c) for c in columns])
    corr = F.when(F.col("nan") > 0, F.lit(float("nan"))).otherwise(F.abs(F.try_divide(F.col("prod"), F.sqrt("dev_a") * F.sqrt("dev_b"))))
    return co_moments(df, columns).select(F.get(names, F.col("i").cast("int")).alias("a"), F.get(names, F.col("j").cast("int")).alias("b"), corr.alias("corr"))


def variances(df: DataFrame, columns: Sequence[str], population: bool = True) -> DataFrame:
    """(feature, variance)."""
    var = F.var_pop if population else F.var_samp
    one = df.agg(*[var(c).alias(f"v{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"v{i}").alias("variance")) for i, c in enumerate(columns)])))


def correlated_drops(df: DataFrame, columns: Sequence[str], limit: float = 0.95, keep: Sequence[str] = ()) -> DataFrame:
    """Columns to drop: of each pair above ``limit`` the one with less variance (tie: the first)."""
    var = variances(df, columns, population=False)
    pairs = corr_matrix(df, columns).where(F.col("corr") > limit)
    joined = (
        pairs.join(F.broadcast(var.toDF("a", "va")), "a").join(F.broadcast(var.toDF("b", "vb")), "b")
        .select(F.when(F.col("va") <= F.col("vb"), F.col("a")).otherwise(F.col("b")).alias("feature"))
    )
    return joined.where(~F.col("feature").isin(list(keep))).distinct() if keep else joined.distinct()


def low_variance(df: DataFrame, columns: Sequence[str], limit: float = 0.01) -> DataFrame:
    return variances(df, columns).where(F.col("variance") <= limit)


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """(feature, f, df_between, df_within) from per-class counts, means and variances."""
    groups = long_form(df, columns, [label]).groupBy("feature", label).agg(
        F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    n, m = F.col("n"), F.col("m")
    mean = groups.groupBy("feature").agg(F.try_divide(F.sum(n * m), F.sum("n")).alias("gm"))
    away = (m - F.col("gm")) * (m - F.col("gm"))
    s = groups.join(F.broadcast(mean), "feature").groupBy("feature").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.coalesce(F.sum(n * away), F.lit(0.0)).alias("ssb"), F.sum(n * F.col("v")).alias("ssw"))
    ssb = F.col("ssb")
    dfb, dfw = F.col("k") - 1, F.col("n") - F.col("k")
    f = F.try_divide(F.try_divide(ssb, dfb), F.try_divide(F.col("ssw"), dfw))
    perfect = (F.col("ssw") == 0) & (ssb > 0)
    return s.select("feature", F.when(perfect, F.lit(float("inf"))).otherwise(f).alias("f"), dfb.alias("df_between"), dfw.alias("df_within"))


def f_upper_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f): regularised incomplete beta by its continued fraction (driver scalars only)."""
    if f is None or math.isnan(f) or f <= 0:
        return 1.0
    return _beta(d2 / (d2 + d1 * f), d2 / 2.0, d1 / 2.0)


def _beta(x: float, a: float, b: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * total


def anova_p(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    rows = [(r["feature"], r["f"], f_upper_tail(r["f"], r["df_between"], r["df_within"])) for r in anova_f(df, columns, label).collect()]
    return df.sparkSession.createDataFrame(rows, "feature string, f double, p double")


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """(feature, edges): ascending values; the number of edges below a value is its equal-count bin. Missing values come first, NaN last;
    an edge among them is null or NaN."""
    counts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        counts += [F.count_if(v.isNull()).alias(f"m{i}"), F.count_if(F.isnan(v)).alias(f"a{i}")]
    row = df.agg(*counts).first()
    n = row["n"]
    places = sorted({-(-b * n // bins) for b in range(1, bins)}) if n else []
    sizes = {c: n - row[f"m{i}"] - row[f"a{i}"] for i, c in enumerate(columns)}
    ranks = {c: [t - row[f"m{i}"] for t in places if 0 < t - row[f"m{i}"] <= sizes[c]] for i, c in enumerate(columns)}
    found = order_statistics(df, ranks, sizes)
    rows = []
    for i, c in enumerate(columns):
        def at(rank: int, c: str = c) -> float:
            return -math.inf if rank <= 0 else math.nan if rank > sizes[c] else found[c][rank]

        edges = [at(-(-b * n // bins) - row[f"m{i}"]) for b in range(1, bins)] if n else []
        lowest = sum(-(-b * n // bins) <= row[f"m{i}"] for b in range(1, bins)) if n else 0
        rows.append((c, edges[lowest:], lowest))
    return df.sparkSession.createDataFrame(rows, "feature string, edges array<double>, lowest int")


def mutual_info(df: DataFrame, columns: Sequence[str], label: str, bins: int = 32) -> DataFrame:
    """Plug-in mutual information of each feature (equal-count bins, equal values share a bin) and the label. Bin edges come
    from selection; then one aggregate counts cells of feature, bin and class where the rows are."""
    edges = bin_edges(df, columns, bins)
    value = F.col("value")
    bin_ = F.when(value.isNull(), 0).otherwise(F.col("lowest") + points_below(F.col("edges"), value, bins - 1))
    placed = long_form(df, columns, [label]).join(F.broadcast(edges), "feature").select("feature", bin_.alias("bin"), label)
    cells = stored(placed.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("n")), "cells")
    total = cells.groupBy("feature").agg(F.sum("n").alias("total"))
    by_bin = cells.groupBy("feature", "bin").agg(F.sum("n").alias("nb"))
    by_label = cells.groupBy("feature", label).agg(F.sum("n").alias("nl"))
    p, pb, pl = F.col("n") / F.col("total"), F.col("nb") / F.col("total"), F.col("nl") / F.col("total")
    joined = null_safe_join(cells.join(total, "feature").join(by_bin, ["feature", "bin"]), by_label, ["feature", label])
    return joined.groupBy("feature").agg(F.sum(p * F.log(p / (pb * pl))).alias("mi"))


def insignificant(anova: DataFrame, mi: DataFrame, p_limit: float = 0.05, mi_quantile: float = 0.2) -> DataFrame:
    """Features that are neither significant nor informative; both inputs have one row per feature."""
    both = anova.join(mi, "feature")
    cut = both.agg(F.percentile("mi", mi_quantile)).first()[0]
    return both.where((F.col("p") > p_limit) & (F.col("mi") < F.lit(cut))).select("feature", "f", "p", "mi")


def feature_ranking(scores: DataFrame, by: str, top: int = 20) -> DataFrame:
    return scores.orderBy(F.desc(by), "feature").limit(top)


def feature_selection(df: DataFrame, label: str, exclude: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The reduced frame and a (step, feature) report of what was dropped and why."""
    kept_names = lambda c: any(p in c.lower() for p in ALWAYS_KEPT_PARTS)
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != label and f.name not in exclude]
    filled = impute_median(df.select(label, *numeric), numeric)
    dropped: list[tuple[str, str]] = []

    def free() -> list[str]:
        gone = {c for _, c in dropped}
        return [c for c in numeric if c not in gone]

    keep = [c for c in numeric if kept_names(c)]
    if len(free()) > 1:
        dropped += [("correlated", r["feature"]) for r in correlated_drops(filled, free(), keep=keep).collect()]
    candidates = [c for c in free() if c not in keep]
    if candidates:
        dropped += [("low_variance", r["feature"]) for r in low_variance(filled, candidates).collect()]
    candidates = [c for c in free() if c not in keep]
    if candidates:
        p, mi = anova_p(filled, candidates, label), mutual_info(filled, candidates, label)
        dropped += [("insignificant", r["feature"]) for r in insignificant(p, mi).collect()]
    report = df.sparkSession.createDataFrame(dropped, "step string, feature string")
    return df.drop(*[c for _, c in dropped]), report
