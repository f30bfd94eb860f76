"""The flagship query: flows to a per-source activity profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import flows, graphs
from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions.scalar import r6
from flowhelm.operators import lifecycle as L
from flowhelm.plans.skew import null_safe_join

_SQL = f"""WITH td AS (SELECT src, avg(CASE WHEN d >= 0 THEN d END) AS mean_gap, max(c) AS busiest_hour FROM (SELECT src, {flows._DELTA} AS d,
      count(*) OVER (PARTITION BY src ORDER BY t_us RANGE BETWEEN CURRENT ROW AND 3600000000 FOLLOWING) AS c FROM flow) GROUP BY src),
    lk AS (SELECT src, count(*) AS n_links FROM ({graphs._E1}) e JOIN flow ON flow_id = src_flow GROUP BY src),
    lf AS (SELECT src, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS activity, sum(y) AS n_errors FROM flow GROUP BY src)
    SELECT lf.src, round(mean_gap,6)+0.0 AS mean_gap, busiest_hour, coalesce(n_links,0) AS n_links, first_us, last_us, activity, CAST(n_errors AS BIGINT) AS n_errors FROM lf JOIN td ON td.src IS NOT DISTINCT FROM lf.src LEFT JOIN lk ON lk.src IS NOT DISTINCT FROM lf.src"""


@query("source_activity", _SQL, "flow")
def source_activity(spark, sf):
    flow = V.flow(spark, sf)
    feats = flows.time_delta_features(spark, sf).groupBy("src").agg(
        F.avg(F.when(F.col("time_delta") >= 0, F.col("time_delta"))).alias("mean_gap"), F.max("count_3600s").alias("busiest_hour"))
    links = graphs.temporal_edges(spark, sf, ends=True).groupBy("src").agg(F.count(F.lit(1)).alias("n_links"))
    life = L.lifecycle(flow.select(F.col("src").alias("id"), "t_us", "y"), F.sum("y").alias("n_errors")).withColumnRenamed("id", "src")
    out = null_safe_join(null_safe_join(life, feats, ["src"]), links, ["src"], "left")
    return out.select("src", r6("mean_gap").alias("mean_gap"), "busiest_hour", F.coalesce("n_links", F.lit(0)).alias("n_links"), "first_us", "last_us", "activity", "n_errors")
