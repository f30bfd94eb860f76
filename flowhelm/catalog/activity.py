"""Queries for gap statistics, activity patterns and time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions.scalar import r6
from flowhelm.operators import windows as W
from flowhelm.session import cut_lineage

ORDER = ["t_us", "flow_id"]
ALL_SCALES = ("micro", "small", "medium", "large", "macro")


def _f(spark, sf):
    return V.flow(spark, sf).select("flow_id", "t_us", "src", "bytes")


def _gaps(spark, sf):
    g = cut_lineage(W.gaps(_f(spark, sf), ORDER))
    return g, W.gap_statistics(g)


def _ms(df, *keep):
    """Window bounds as whole milliseconds, sizes to a thousandth of a second."""
    return df.select(*keep, "scale", F.round("size_s", 3).alias("size_s"), F.floor(F.col("start_us") / 1000).alias("start_ms"), F.floor(F.col("end_us") / 1000).alias("end_ms"))


_MS = "scale, round(size_s,3) AS size_s, CAST(floor(start_us/1000) AS BIGINT) AS start_ms, CAST(floor(end_us/1000) AS BIGINT) AS end_ms"


@query("gap_statistics", 'SELECT ' + ", ".join(f'round({e},6)+0.0 AS "{n}"' for n, e in (("min", "lo"), ("max", "hi"), ("median", "med"), ("q1", "q1"), ("q3", "q3"), ("iqr", "q3-q1"))) + " FROM gst", "gst")
def _(spark, sf):
    row = W.gap_statistics_row(spark, W.gap_statistics(W.gaps(_f(spark, sf), ORDER)))
    return row.select(*[r6(c).alias(c) for c in row.columns])


@query("burst_flag", "SELECT bursty FROM burst", "burst")
def _(spark, sf):
    g, stats = _gaps(spark, sf)
    return spark.createDataFrame([(W.burst_flag(g, stats),)], "bursty boolean")


@query("dbscan_1d", """SELECT round(d.v,6)+0.0 AS gap, d.n, core, coalesce(CASE WHEN core THEN (SELECT c FROM dcl WHERE dcl.v = d.v) ELSE b.c END, -1) AS cluster
    FROM dcore d LEFT JOIN (SELECT x.v, min(dcl.c) AS c FROM dcore x JOIN gst ON true JOIN dcl ON dcl.v BETWEEN x.v - (med/2 + 1) AND x.v + (med/2 + 1) AND abs(dcl.v - x.v) <= med/2 GROUP BY x.v) b USING (v)""", "gst dcore dcl")
def _(spark, sf):
    g, stats = _gaps(spark, sf)
    return W.dbscan_1d(g, "gap", stats["median"] / 2, 5).withColumn("gap", r6("gap"))


@query("autocorrelation", "SELECT lag, round(r,6)+0.0 AS r FROM acf", "acf")
def _(spark, sf):
    g, stats = _gaps(spark, sf)
    return W.autocorrelation(g, ORDER, stats).withColumn("r", r6("r"))


@query("periodic_flag", "SELECT (SELECT count(*) FROM flow) >= 20 AND period > 0 AS periodic FROM per", "per")
def _(spark, sf):
    g, stats = _gaps(spark, sf)
    return spark.createDataFrame([(W.periodic_flag(W.autocorrelation(g, ORDER, stats), stats["n"] + 1),)], "periodic boolean")


@query("estimate_period", "SELECT round(period,6)+0.0 AS period FROM per", "per")
def _(spark, sf):
    g, stats = _gaps(spark, sf)
    return spark.createDataFrame([(float(W.estimate_period(W.autocorrelation(g, ORDER, stats), stats)),)], "period double")


@query("low_slow_flag", "SELECT low_slow FROM burst", "burst")
def _(spark, sf):
    return spark.createDataFrame([(W.low_slow_flag(_gaps(spark, sf)[1]),)], "low_slow boolean")


@query("low_slow_by_entity", """SELECT src, count(g) AS n_gaps, round(avg(g),6)+0.0 AS mean_gap, max(g) AS max_gap FROM (SELECT src, (t_us - lag(t_us) OVER (PARTITION BY src ORDER BY t_us, flow_id))/1000000.0::DOUBLE AS g FROM flow)
    GROUP BY src HAVING count(g) >= 3 AND max(g) > 5*avg(g) AND max(g) > 300""", "flow")
def _(spark, sf):
    return W.low_slow_by_entity(W.gaps(_f(spark, sf), ORDER, keys=["src"]), "src").withColumn("mean_gap", r6("mean_gap"))


@query("select_scales", "SELECT scale, round(size_s,3) AS size_s FROM scales", "scales")
def _(spark, sf):
    scales = W.analyse(_f(spark, sf), ORDER, enabled=ALL_SCALES)[1]
    return spark.createDataFrame(scales, "scale string, size_s double").withColumn("size_s", F.round("size_s", 3))


def all_scales(spark, sf):
    """Events, the sizes of all default scales and the time range."""
    f = _f(spark, sf)
    return f, W.analyse(f, ORDER)[1], *W.span(f)


def adaptive_windows(spark, sf):
    return W.generate_windows(spark, *all_scales(spark, sf)[1:])


def _per_hour(windows):
    """Windows summed up by size and the hour they start in: how many, the first start, the last end, and the sums of both in milliseconds
    after the hour."""
    hour = F.floor(F.col("start_us") / 3_600_000_000)
    start, end = (F.floor(F.col(c) / 1000).cast("long") - F.col("hour") * 3_600_000 for c in ("start_us", "end_us"))
    return windows.withColumn("hour", hour).groupBy("scale", F.round("size_s", 3).alias("size_s"), "hour").agg(
        F.count(F.lit(1)).alias("n"), F.min(start).alias("first_ms"), F.max(end).alias("last_ms"), F.sum(start).alias("starts_ms"), F.sum(end).alias("ends_ms"))


_HOURS = """SELECT scale, round(size_s,3) AS size_s, hour, count(*) AS n, min(s) AS first_ms, max(e) AS last_ms, CAST(sum(s) AS BIGINT) AS starts_ms, CAST(sum(e) AS BIGINT) AS ends_ms FROM (
    SELECT scale, size_s, hour, CAST(floor(start_us/1000) AS BIGINT) - hour*3600000 AS s, CAST(floor(end_us/1000) AS BIGINT) - hour*3600000 AS e
    FROM (SELECT *, CAST(floor(start_us/3600000000) AS BIGINT) AS hour FROM win)) GROUP BY ALL"""


@query("generate_windows", _HOURS, "win")
def _(spark, sf):
    """All windows of all default scales, without a cap, summed up by hour."""
    return _per_hour(adaptive_windows(spark, sf))


@query("generate_windows_capped", f"SELECT {_MS} FROM wincap", "wincap")
def _(spark, sf):
    """At most 100 windows per size, of all default scales."""
    f = _f(spark, sf)
    return _ms(W.generate_windows(spark, W.analyse(f, ORDER)[1], *W.span(f), max_windows=100))


_PER_SCALE = "SELECT scale, CAST(sum(n) AS BIGINT) AS n_windows FROM winn GROUP BY scale"


@query("windows_per_scale_all_scales", _PER_SCALE, "winn")
@query("windows_per_scale", _PER_SCALE, "winn")
def _(spark, sf):
    return W.windows_per_scale(adaptive_windows(spark, sf))


_BURST = """WITH ev AS (SELECT src, t_us AS v, count(*) AS n FROM flow GROUP BY ALL), r AS (SELECT src, min(v) AS t0, max(v) AS t1, (max(v)-min(v))*0.01::DOUBLE AS eps FROM ev GROUP BY src HAVING max(v) > min(v)),
    co AS (SELECT a.src, a.v, sum(b.n) >= 3 AS core FROM ev a JOIN r USING (src) JOIN ev b ON a.src = b.src AND abs(a.v - b.v) <= eps GROUP BY a.src, a.v),
    cl AS (SELECT src, v, CAST(sum(CASE WHEN v - prev <= eps THEN 0 ELSE 1 END) OVER (PARTITION BY src ORDER BY v) - 1 AS BIGINT) AS c FROM (SELECT src, v, lag(v) OVER (PARTITION BY src ORDER BY v) AS prev FROM co WHERE core) JOIN r USING (src)),
    al AS (SELECT src, v, c FROM cl UNION ALL SELECT x.src, x.v, min(c) FROM co x JOIN r USING (src) JOIN cl ON cl.src = x.src AND abs(cl.v - x.v) <= eps WHERE NOT x.core GROUP BY x.src, x.v),
    e AS (SELECT src, c AS cluster, min(v)::DOUBLE AS a, max(v)::DOUBLE AS b, (max(v)-min(v))::DOUBLE AS len, CASE WHEN max(v)-min(v) < 1000000 THEN (1000000.0::DOUBLE-(max(v)-min(v)))/2 ELSE 0 END AS pad FROM al GROUP BY src, c),
    ww AS (SELECT src, cluster, 'burst' AS scale, len/1000000.0 AS size_s, a-pad AS start_us, b+pad AS end_us FROM e UNION ALL
      SELECT src, cluster, 'burst_context', len/1000000.0*2, greatest(t0::DOUBLE, a-pad-len), least(t1::DOUBLE, b+pad+len) FROM e JOIN r USING (src))
    SELECT src, cluster, """ + _MS + " FROM ww"


@query("burst_windows", _BURST, "flow")
def _(spark, sf):
    return _ms(W.burst_windows(_f(spark, sf), keys=["src"]), "src", "cluster")


_PERIODIC = """WITH p AS (SELECT t0, t1, 86400000000.0::DOUBLE AS step, CAST(ceil((t1-t0)/86400000000.0::DOUBLE) AS BIGINT) AS n FROM rng),
    pw AS (SELECT 'periodic' AS scale, 0.0::DOUBLE AS sh, unnest(range(n)) AS i, * FROM p UNION ALL SELECT 'periodic_overlap', 0.5::DOUBLE, unnest(range(n-1)), * FROM p),
    ww AS (SELECT scale, 86400.0::DOUBLE AS size_s, t0::DOUBLE+(i+sh)*step AS start_us, least(t0::DOUBLE+(i+sh)*step+step, t1::DOUBLE) AS end_us, t1 FROM pw WHERE t0::DOUBLE+(i+sh)*step < t1)
    SELECT """ + _MS + " FROM ww"


@query("periodic_windows", _PERIODIC, "rng")
def _(spark, sf):
    return _ms(W.periodic_windows(spark, *W.span(_f(spark, sf)), 86400.0))


@query("periodic_windows_auto", _HOURS, "win")
def _(spark, sf):
    """The events have no period, so the pattern falls back to adaptive windows."""
    return _per_hour(W.windows_for_pattern(_f(spark, sf), ORDER, "periodic"))


_LOWSLOW = """WITH p AS (SELECT t0, t1, greatest(3600000000.0::DOUBLE, (t1-t0)/5::DOUBLE) AS large FROM rng),
    pw AS (SELECT 'low_slow_large' AS scale, large AS len, large AS step, unnest(range(5)) AS i, t0, t1 FROM p UNION ALL
      SELECT 'low_slow_medium', large/3, large/3/2, unnest(range(CAST(ceil((t1-t0)/(large/3/2)) AS BIGINT))), t0, t1 FROM p),
    ww AS (SELECT scale, len/1000000.0::DOUBLE AS size_s, t0::DOUBLE+i*step AS start_us, least(t0::DOUBLE+i*step+len/1000000.0::DOUBLE*1000000.0::DOUBLE, t1::DOUBLE) AS end_us FROM pw WHERE t0::DOUBLE+i*step < t1)
    SELECT """ + _MS + " FROM ww"


@query("low_slow_windows", _LOWSLOW, "rng")
def _(spark, sf):
    return _ms(W.low_slow_windows(spark, *W.span(_f(spark, sf))))


def _window_counts(joined):
    return joined.groupBy("scale", F.round("size_s", 3).alias("size_s"), F.floor(F.col("start_us") / 1000).alias("start_ms")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("bytes")).alias("mean_bytes"))


_IN_WINDOWS = """WITH spot AS (SELECT *, CAST(floor((t_us - t0::DOUBLE)/step) AS BIGINT) AS i FROM flow, winn),
    near AS (SELECT *, t0::DOUBLE + k*step AS start_us, CASE WHEN k = n-1 THEN stop ELSE t0::DOUBLE + k*step + step END AS end_us FROM (SELECT *, unnest([least(i,n-1)-1, least(i,n-1), least(i+1,n-1)+CASE WHEN i >= n-1 THEN n ELSE 0 END]) AS k FROM spot) WHERE k BETWEEN 0 AND n-1)
    SELECT scale, round(size_s,3) AS size_s, CAST(floor(start_us/1000) AS BIGINT) AS start_ms, count(*) AS n, round(avg(bytes),6)+0.0 AS mean_bytes FROM near
    WHERE t_us >= start_us AND (t_us < end_us OR (t_us = end_us AND end_us = stop)) GROUP BY ALL"""


@query("events_in_windows_all_scales", _IN_WINDOWS, "flow winn")
@query("events_in_windows", _IN_WINDOWS, "flow winn")
def _(spark, sf):
    """Events counted in all windows of all default scales; only windows with events are made."""
    return _window_counts(W.assign_generated(*all_scales(spark, sf)))


@query("events_in_windows_coarse", """SELECT scale, round(size_s,3) AS size_s, CAST(floor(start_us/1000) AS BIGINT) AS start_ms, count(*) AS n, round(avg(bytes),6)+0.0 AS mean_bytes
    FROM (SELECT *, max(end_us) OVER (PARTITION BY scale, size_s) AS stop FROM win WHERE scale <> 'micro') JOIN flow ON t_us >= start_us AND (t_us < end_us OR (t_us = end_us AND end_us = stop)) GROUP BY ALL""", "win flow")
def _(spark, sf):
    """The same by an interval join with given windows, here those of the two coarser scales."""
    f, scales, t0, t1 = all_scales(spark, sf)
    return _window_counts(W.assign_windows(f, W.generate_windows(spark, [s for s in scales if s[0] != "micro"], t0, t1)))


@query("multi_scale_tumbling", """SELECT scale, t_us - t_us % size_us AS start_us, count(*) AS n, round(sum(bytes),4)+0.0 AS total FROM flow,
    (SELECT unnest(['micro','small','medium','large','macro','extended']) AS scale, unnest([1,60,300,3600,86400,604800])*1000000::BIGINT AS size_us) GROUP BY ALL""", "flow")
def _(spark, sf):
    return W.multi_scale_tumbling(_f(spark, sf)).withColumn("total", F.round("total", 4) + 0.0)


@query("sliding_windows", "SELECT (t_us//40000000 - k)*40000000 AS start_us, count(*) AS n, round(sum(bytes),4)+0.0 AS total FROM flow, (SELECT unnest([0,1,2]) AS k) GROUP BY ALL", "flow")
def _(spark, sf):
    return W.sliding_windows(_f(spark, sf)).withColumn("total", F.round("total", 4) + 0.0)


_SESSIONS = """SELECT src, CAST(session AS BIGINT) AS session, min(t_us) AS start_us, max(t_us) AS last_us, count(*) AS n FROM (SELECT *, sum(CASE WHEN prev IS NULL OR t_us - prev >= 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING) AS session
    FROM (SELECT src, t_us, flow_id, lag(t_us) OVER (PARTITION BY src ORDER BY t_us, flow_id) AS prev FROM flow)) GROUP BY src, session"""


@query("session_bursts", _SESSIONS, "flow")
def _(spark, sf):
    return W.session_bursts(_f(spark, sf), "src", ORDER, 3_600_000_000)
