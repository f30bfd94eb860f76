"""Time-gap statistics, activity patterns and adaptive time windows.

Event times are long microseconds (``t_us``). Windows are rows (scale, size_s, start_us, end_us).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowhelm.plans.lookup import is_small
from flowhelm.plans.ordered import ROWS_PER_BLOCK, neighbours, number, row_halo, running_sums
from flowhelm.plans.ranks import ACCURACY, interpolated, order_statistics, ranks_around
from flowhelm.plans.skew import null_safe_join
from flowhelm.session import cut_lineage

MICROS = 1_000_000.0
MAX_LAG = 100
# Blocks with copied edges may be small: the copies stay far below one percent.
HALO_ROWS = 50_000
# Default window sizes in seconds.
SCALES = {"micro": 1.0, "small": 60.0, "medium": 300.0, "large": 3600.0, "macro": 86400.0, "extended": 604800.0}
DEFAULT_ENABLED = ("micro", "medium", "large")
WINDOWS_PER_PART = 100_000  # windows of a size that one task makes at a time
WINDOW_SCHEMA = "scale string, size_s double, start_us double, end_us double"


def gaps(df: DataFrame, order: Sequence[str], t_us: str = "t_us", keys: Sequence[str] = (), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Seconds between consecutive events (per key): column ``gap``; first events have none."""
    wanted = list(dict.fromkeys([*keys, t_us, *order]))
    prev = neighbours(df.select(*wanted), order, previous={"_prev": t_us}, keys=keys, rows_per_block=rows_per_block)
    return prev.where(F.col("_prev").isNotNull()).withColumn("gap", (F.col(t_us) - F.col("_prev")) / F.lit(MICROS)).drop("_prev")


def gap_statistics(g: DataFrame) -> dict:
    """n, min, max, median, q1, q3, iqr, mean, std (population) of ``gap`` as numbers: moments and a sketch in one pass, exact
    quartiles by selection in another."""
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    near = sorted(p + d for p in shares.values() for d in (-2 / ACCURACY, 2 / ACCURACY))
    base = g.agg(
        F.count("gap").alias("n"), F.min("gap").alias("min"), F.max("gap").alias("max"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("std"),
        F.percentile_approx("gap", near, ACCURACY).alias("near")).first().asDict()
    near, n = base.pop("near"), base["n"]
    if not n:
        return base | {"q1": None, "median": None, "q3": None, "iqr": None}
    found = order_statistics(g, {"gap": ranks_around(n, list(shares.values()))}, {"gap": n}, {"gap": near})["gap"]
    q = {k: interpolated(found, n, p) for k, p in shares.items()}
    return base | q | {"iqr": q["q3"] - q["q1"]}


def gap_statistics_row(spark: SparkSession, stats: dict) -> DataFrame:
    names = ["min", "max", "median", "q1", "q3", "iqr"]
    return spark.createDataFrame([tuple(stats[k] for k in names)], ", ".join(f"{k} double" for k in names))


def dbscan_1d(df: DataFrame, value: str, eps: Column | float, min_pts: int, keys: Sequence[str] = (), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """DBSCAN of one numeric column: (keys, value, n, core, cluster) per distinct value, noise -1.

    In sorted order a core value, and the nearest core of a border value, is decided by the
    ``min_pts`` distinct values on either side, so fixed row frames over row blocks suffice.
    """
    reach = F.lit(float(eps)) if isinstance(eps, (int, float)) else eps
    values = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.max(reach).alias("_eps")))
    full, total = [*keys, value], values.count()
    rows = running_sums(values, full, {"_rn": F.lit(1).cast("long")}, rows_per_block=rows_per_block, rows=total)

    def around(before: int, after: int, *fields: str) -> Column:
        w = Window.partitionBy("_blk", *keys).orderBy("_rn").rowsBetween(-before, after)
        return F.collect_list(F.struct(F.col(value).alias("v"), *fields)).over(w)

    def near(c: Column) -> Column:
        return F.abs(c["v"] - F.col(value)) <= F.col("_eps")

    cut = row_halo(rows, "_rn", 3 * min_pts, 3 * min_pts, min(rows_per_block, HALO_ROWS)).withColumn("_near", around(min_pts, min_pts, "n"))
    weight = F.aggregate(F.filter("_near", near), F.lit(0).cast("long"), lambda a, c: a + c["n"])
    cored = cut.withColumn("core", weight >= min_pts).withColumn("_near", around(min_pts, -1, "core"))
    starts = F.col("core") & ~F.exists(F.coalesce("_near", F.array().cast(cored.schema["_near"].dataType)), lambda c: c["core"] & near(c))
    flagged = cored.withColumn("_start", starts.cast("long")).where("_own").drop("_near", "_blk", "_own")
    summed = running_sums(flagged, [value], {"_cl": F.col("_start")}, keys, rows_per_block, rows=total)
    again = row_halo(summed, "_rn", min_pts, min_pts, min(rows_per_block, HALO_ROWS)).withColumn("_near", around(min_pts, min_pts, "core", "_cl"))
    border = F.array_min(F.transform(F.filter("_near", lambda c: c["core"] & near(c)), lambda c: c["_cl"]))
    cluster = F.when(F.col("core"), F.col("_cl")).otherwise(border) - 1
    return again.where("_own").select(*keys, value, "n", "core", F.coalesce(cluster, F.lit(-1).cast("long")).alias("cluster"))


def burst_flag(g: DataFrame, stats: dict, rows_per_block: int = ROWS_PER_BLOCK) -> bool:
    """High variation of the gaps, or (from 50 gaps) at least two clusters of gaps."""
    if stats["n"] < 10:
        return False
    if stats["mean"] and stats["std"] / stats["mean"] > 2.0:
        return True
    if stats["n"] < 50 or not stats["median"]:
        return False
    clusters = dbscan_1d(g, "gap", stats["median"] / 2, 5, rows_per_block=rows_per_block).where("cluster >= 0")
    return clusters.agg(F.coalesce(F.max("cluster"), F.lit(-1))).first()[0] >= 1


def autocorrelation(g: DataFrame, order: Sequence[str], stats: dict, rows_per_block: int = ROWS_PER_BLOCK, max_lag: int = MAX_LAG) -> DataFrame:
    """(lag, r) of the gap series for lags up to min(n // 3, max_lag), the longest period looked for.

    The series is cut into blocks of consecutive rows with the rows before them that the longest lag reaches; a block's sums for
    all lags come from one product of Fourier transforms (overlap-save), and only these sums leave the tasks.
    """
    lags = min(stats["n"] // 3, max_lag)
    spark = g.sparkSession
    if lags < 1 or not stats["std"]:
        return spark.createDataFrame([], "lag int, r double")
    series = number(g.select(*order, "gap"), order, name="_rn", rows_per_block=rows_per_block)
    cut = row_halo(series.select("_rn", (F.col("gap") - F.lit(stats["mean"])).alias("_x")), "_rn", lags, 0, min(rows_per_block, HALO_ROWS))

    def lag_sums(block: pa.Table) -> pa.Table:
        at, x, own = (block.column(c).to_numpy(zero_copy_only=False) for c in ("_rn", "_x", "_own"))
        line = np.argsort(at, kind="stable")
        x, own = x[line], own[line].astype(bool)
        size = 1 << int(len(x) + lags - 1).bit_length()  # room for the longest lag, so that nothing wraps around
        products = np.fft.irfft(np.fft.rfft(np.where(own, x, 0.0), size) * np.conj(np.fft.rfft(x, size)), size)
        return pa.table({"lag": np.arange(1, lags + 1, dtype=np.int32), "s": products[1 : lags + 1]})

    sums = cut.groupBy("_blk").applyInArrow(lag_sums, "lag int, s double").groupBy("lag").agg(F.sum("s").alias("s"))
    return sums.select("lag", (F.col("s") / ((F.lit(stats["n"]) - F.col("lag")) * F.lit(stats["std"] ** 2))).alias("r"))


def first_peak(acf: DataFrame) -> int | None:
    """Smallest lag with a local maximum above 0.2 (never the first or last lag)."""
    r = {x["lag"]: x["r"] for x in acf.collect()}
    peaks = [k for k in sorted(r) if k - 1 in r and k + 1 in r and r[k] > r[k - 1] and r[k] > r[k + 1] and r[k] > 0.2]
    return peaks[0] if peaks else None


def periodic_flag(acf: DataFrame, n_events: int) -> bool:
    return n_events >= 20 and first_peak(acf) is not None


def estimate_period(acf: DataFrame, stats: dict) -> float:
    peak = first_peak(acf)
    return 0.0 if peak is None else stats["median"] * peak


def low_slow_flag(stats: dict) -> bool:
    return stats["n"] >= 10 and stats["max"] > 10 * stats["q3"]


def low_slow_by_entity(g: DataFrame, entity: str) -> DataFrame:
    """Entities with at least three gaps, one of them long both absolutely and against their mean."""
    per = g.groupBy(entity).agg(F.count("gap").alias("n_gaps"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))
    return per.where((F.col("n_gaps") >= 3) & (F.col("max_gap") > 5 * F.col("mean_gap")) & (F.col("max_gap") > 300))


# Per scale the statistic of the gaps that sizes it, the condition on it, the finding that
# also asks for the scale, the smallest size, the factor of the statistic, and the multiples used.
SCALE_RULES = (
    ("micro", "min", lambda x: x < 2.0, "bursty", 0.5, 1.0, (1, 2, 5)),
    ("small", "q1", lambda x: x < 30, "bursty", 2.0, 1.0, (1, 2, 5)),
    ("medium", "median", lambda x: True, "", 10.0, 1.0, (1,)),
    ("large", "q3", lambda x: x > 60, "low_slow", 60.0, 2.0, (1, 2)),
    ("macro", "max", lambda x: x > 3600, "low_slow", 3600.0, 0.5, (1,)),
)


def select_scales(stats: dict, bursty: bool, period: float, low_slow: bool, enabled: Sequence[str] = DEFAULT_ENABLED, min_events: int = 5) -> list[tuple[str, float]]:
    """Window sizes per scale from the gap numbers: [(scale, seconds)], by :data:`SCALE_RULES`."""
    standard = [("medium", SCALES["medium"])]
    if stats["n"] < max(2, min_events - 1):
        return standard
    seen = {"bursty": bursty, "low_slow": low_slow, "": False}
    sized = {
        scale: [max(least, stats[name] * factor) * m for m in multiples]
        for scale, name, fits, finding, least, factor, multiples in SCALE_RULES
        if scale in enabled and (fits(stats[name]) or seen[finding])
    }
    if "medium" in sized and period > 0:
        sized["medium"].append(period)
    return [(scale, size) for scale, sizes in sized.items() for size in sizes] or standard


def analyse(df: DataFrame, order: Sequence[str], t_us: str = "t_us", enabled: Sequence[str] = DEFAULT_ENABLED, rows_per_block: int = ROWS_PER_BLOCK) -> tuple[dict, list[tuple[str, float]]]:
    """Gap numbers and the window sizes chosen from them and from the detected patterns."""
    g = cut_lineage(gaps(df, order, t_us, rows_per_block=rows_per_block))  # one global ordering, read four times
    stats = gap_statistics(g)
    if stats["n"] < 2:
        return stats, select_scales(stats, False, 0.0, False, enabled)
    acf = autocorrelation(g, order, stats, rows_per_block)
    period = estimate_period(acf, stats) if stats["n"] + 1 >= 20 else 0.0
    return stats, select_scales(stats, burst_flag(g, stats, rows_per_block), period, low_slow_flag(stats), enabled)


def span(df: DataFrame, t_us: str = "t_us") -> tuple[int, int]:
    return tuple(df.agg(F.min(t_us), F.max(t_us)).first())


def _explode_windows(sizes: DataFrame, count: Column, start: Column, end: Column) -> DataFrame:
    return sizes.withColumn("i", F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))).select("scale", "size_s", start.alias("start_us"), end.alias("end_us"))


def _sizes(spark: SparkSession, scales: Sequence[tuple[str, float]], t0: int, t1: int, max_windows: int | None = None) -> tuple[DataFrame, Column, Column]:
    """Window sizes with ``n``, the number of their windows, and start and end of window ``i`` of them."""
    sizes = spark.createDataFrame(list(scales), "scale string, size_s double")
    step = F.col("size_s") * MICROS
    n = F.ceil(F.lit(float(t1 - t0)) / step)
    n = F.greatest(F.lit(1), n if max_windows is None else F.least(n, F.lit(max_windows)))
    start = F.lit(float(t0)) + F.col("i") * step
    end = F.when(F.col("i") == F.col("n") - 1, F.greatest(start + step, F.lit(float(t1)))).otherwise(start + step)
    return sizes.withColumn("n", n), start, end


def generate_windows(spark: SparkSession, scales: Sequence[tuple[str, float]], t0: int, t1: int, max_windows: int | None = None) -> DataFrame:
    """Back-to-back windows per size up to the final event; with ``max_windows`` at most so many, the
    last one stretched. Sizes with many windows are made in parts by all executors."""
    sizes, start, end = _sizes(spark, scales, t0, t1, max_windows)
    parts = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {WINDOWS_PER_PART}"))))
    if sizes.agg(F.sum("n")).first()[0] > WINDOWS_PER_PART:
        parts = parts.repartition("scale", "size_s", "_part")
    first = F.col("_part") * WINDOWS_PER_PART
    numbered = parts.withColumn("i", F.explode(F.sequence(first, F.least(first + WINDOWS_PER_PART, F.col("n")) - 1)))
    return numbered.select("scale", "size_s", start.alias("start_us"), end.alias("end_us")).orderBy("start_us", "scale", "size_s")


def assign_generated(events: DataFrame, scales: Sequence[tuple[str, float]], t0: int, t1: int, t_us: str = "t_us") -> DataFrame:
    """What :func:`assign_windows` gives for the windows of :func:`generate_windows`, from the number of the window that
    an event falls into and its neighbours (bounds are rounded): only windows with events are made."""
    sizes, start, end = _sizes(events.sparkSession, scales, t0, t1)
    stop = F.lit(float(t0)) + (F.col("n") - 1) * (F.col("size_s") * MICROS)
    stop = F.greatest(stop + F.col("size_s") * MICROS, F.lit(float(t1)))
    at = F.floor((F.col(t_us) - F.lit(float(t0))) / (F.col("size_s") * MICROS))
    # The last window may be stretched to the final event, and its end belongs to it.
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.least(at, F.col("n") - 1) - 1), F.least(at + 1, F.col("n") - 1))
    spread = events.crossJoin(F.broadcast(sizes.withColumn("_stop", stop))).where(F.col(t_us).between(t0, t1))
    marked = spread.withColumn("i", F.explode(near)).withColumns({"start_us": start, "end_us": end})
    inside = (F.col(t_us) >= F.col("start_us")) & ((F.col(t_us) < F.col("end_us")) | ((F.col("end_us") == F.col("_stop")) & (F.col(t_us) == F.col("_stop"))))
    return marked.where(inside).drop("n", "i", "_stop")


def periodic_windows(spark: SparkSession, t0: int, t1: int, period_s: float) -> DataFrame:
    """Windows of one period and the same shifted by half a period, clipped to the last event."""
    step = period_s * MICROS
    n = math.ceil((t1 - t0) / step)
    kinds = spark.createDataFrame([("periodic", period_s, n, 0.0), ("periodic_overlap", period_s, n - 1, 0.5)], "scale string, size_s double, n int, shift double").where("n > 0")
    start = F.lit(float(t0)) + (F.col("i") + F.col("shift")) * step
    return _explode_windows(kinds, F.col("n"), start, F.least(start + step, F.lit(float(t1)))).where(F.col("start_us") < t1)


def low_slow_windows(spark: SparkSession, t0: int, t1: int, parts: int = 5) -> DataFrame:
    """``parts`` large windows (each at least an hour) and sliding ones of a third with half overlap."""
    large = max(3600 * MICROS, (t1 - t0) / parts)
    medium = large / 3
    kinds = spark.createDataFrame([("low_slow_large", large / MICROS, parts, large), ("low_slow_medium", medium / MICROS, math.ceil((t1 - t0) / (medium / 2)), medium / 2)],
                                  "scale string, size_s double, n int, step double").where("n > 0")
    start = F.lit(float(t0)) + F.col("i") * F.col("step")
    return _explode_windows(kinds, F.col("n"), start, F.least(start + F.col("size_s") * MICROS, F.lit(float(t1)))).where(F.col("start_us") < t1)


def burst_windows(df: DataFrame, t_us: str = "t_us", keys: Sequence[str] = (), rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """A window around every cluster of events (reach 1 % of the time range, three events) and a wider
    context window, per key. A key whose events share one time has no range and no windows."""
    ranges = df.groupBy(*keys).agg(F.min(t_us).alias("_t0"), F.max(t_us).alias("_t1"))
    if keys:
        with_eps = df.select(*keys, t_us).groupBy(*keys, t_us).agg(F.count(F.lit(1)).alias("_n"))
        with_eps = null_safe_join(with_eps, ranges, keys)
    else:
        t0, t1 = span(df, t_us)
        with_eps = df.groupBy(t_us).agg(F.count(F.lit(1)).alias("_n")).withColumns({"_t0": F.lit(t0), "_t1": F.lit(t1)})
    points = with_eps.where("_t1 > _t0").withColumn("_m", F.explode(F.sequence(F.lit(1), F.least("_n", F.lit(3)).cast("int"))))
    clusters = dbscan_1d(points, t_us, (F.col("_t1") - F.col("_t0")) * 0.01, 3, keys, rows_per_block).where("cluster >= 0")
    edge = clusters.groupBy(*keys, "cluster").agg(F.min(t_us).cast("double").alias("a"), F.max(t_us).cast("double").alias("b"))
    edge = null_safe_join(edge, ranges, keys) if keys else edge.withColumns({"_t0": F.lit(t0), "_t1": F.lit(t1)})
    length = F.col("b") - F.col("a")
    pad = F.when(length < MICROS, (F.lit(MICROS) - length) / 2).otherwise(F.lit(0.0))
    a, b = F.col("a") - pad, F.col("b") + pad
    both = F.array(
        F.struct(F.lit("burst").alias("scale"), (length / MICROS).alias("size_s"), a.alias("start_us"), b.alias("end_us")),
        F.struct(F.lit("burst_context").alias("scale"), (length / MICROS * 2).alias("size_s"), F.greatest(F.col("_t0").cast("double"), a - length).alias("start_us"), F.least(F.col("_t1").cast("double"), b + length).alias("end_us")))
    return edge.select(*keys, "cluster", F.inline(both))


def windows_for_pattern(df: DataFrame, order: Sequence[str], pattern: str | None, t_us: str = "t_us", enabled: Sequence[str] = DEFAULT_ENABLED) -> DataFrame:
    """Windows suited to a named pattern: burst, periodic, low_slow; anything else adaptive."""
    spark = df.sparkSession
    t0, t1 = span(df, t_us)
    if pattern == "burst":
        return burst_windows(df, t_us).drop("cluster")
    if pattern == "low_slow":
        return low_slow_windows(spark, t0, t1)
    if pattern == "periodic":
        g = cut_lineage(gaps(df, order, t_us))
        stats = gap_statistics(g)
        period = estimate_period(autocorrelation(g, order, stats), stats)
        if period > 0:
            return periodic_windows(spark, t0, t1, period)
    return generate_windows(spark, analyse(df, order, t_us, enabled)[1], t0, t1)


def windows_per_scale(windows: DataFrame) -> DataFrame:
    return windows.groupBy("scale").agg(F.count(F.lit(1)).alias("n_windows"))


def assign_windows(events: DataFrame, windows: DataFrame, t_us: str = "t_us") -> DataFrame:
    """Every (event, window) with ``start <= t < end`` (``t = end`` too in the last window of a size).

    Interval join: windows fall into classes by length (powers of two), a window touches at most two
    grid cells of its class, an event one per class; (class, cell) is the equi-join key.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("end_us") - F.col("start_us"), F.lit(1.0))))).cast("int")
    ends = windows.groupBy("scale", "size_s").agg(F.max("end_us").alias("_stop"))
    marked = windows.join(ends, ["scale", "size_s"]).withColumn("_lv", level)
    levels = sorted(r[0] for r in marked.select("_lv").distinct().collect())
    grid = marked.withColumn("_cell", F.explode(F.sequence(
        F.expr("shiftright(cast(floor(start_us) as bigint), _lv)"), F.expr("shiftright(cast(floor(end_us) as bigint), _lv)"))))
    spots = F.array(*[F.struct(F.lit(v).alias("_lv"), F.shiftright(F.col(t_us), v).alias("_cell")) for v in levels])
    spread = events.select("*", F.inline(spots))
    small = is_small(windows)
    inside = (F.col(t_us) >= F.col("start_us")) & ((F.col(t_us) < F.col("end_us")) | ((F.col("end_us") == F.col("_stop")) & (F.col(t_us) == F.col("_stop"))))
    return spread.join(F.broadcast(grid) if small else grid, ["_lv", "_cell"]).where(inside).drop("_lv", "_cell", "_stop")


def multi_scale_tumbling(df: DataFrame, t_us: str = "t_us", value: str = "bytes", scales: dict[str, float] | None = None) -> DataFrame:
    """Counts and sums in epoch-aligned windows of every scale; one shuffle for all scales."""
    sizes = F.array(*[F.struct(F.lit(k).alias("scale"), F.lit(int(s * MICROS)).cast("long").alias("size_us")) for k, s in (scales or SCALES).items()])
    start = F.col(t_us) - F.pmod(F.col(t_us), F.col("size_us"))
    return df.select(t_us, value, F.inline(sizes)).groupBy("scale", start.alias("start_us")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def sliding_windows(df: DataFrame, t_us: str = "t_us", value: str = "bytes", size: str = "120 seconds", step: str = "40 seconds") -> DataFrame:
    at = F.timestamp_micros(F.col(t_us))
    out = df.groupBy(F.window(at, size, step).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.unix_micros("w.start").alias("start_us"), "n", "total")


def session_bursts(df: DataFrame, entity: str, order: Sequence[str], gap_us: int, t_us: str = "t_us", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Activity islands per entity separated by gaps of at least ``gap_us``."""
    wanted = list(dict.fromkeys([entity, t_us, *order]))
    prev = neighbours(df.select(*wanted), order, previous={"_prev": t_us}, keys=[entity], rows_per_block=rows_per_block)
    fresh = F.when(F.col("_prev").isNull() | (F.col(t_us) - F.col("_prev") >= gap_us), 1).otherwise(0)
    sessions = running_sums(prev.withColumn("_new", fresh), order, {"session": F.col("_new")}, [entity], rows_per_block)
    return sessions.groupBy(entity, "session").agg(F.min(t_us).alias("start_us"), F.max(t_us).alias("last_us"), F.count(F.lit(1)).alias("n"))
