"""Queries over flows, the edge store and node lives."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions.scalar import r6
from flowhelm.operators import edges as E
from flowhelm.operators import features as X
from flowhelm.operators import lifecycle as L
from flowhelm.session import scratch_path

SIZES = (1, 60, 3600, 21600)
MIN_US, HOUR_US, DAY_US = 60_000_000, 3_600_000_000, 86_400_000_000

_DELTA = "coalesce((t_us - lag(t_us) OVER (PARTITION BY src ORDER BY t_us, flow_id))/1000000.0::DOUBLE, -1.0::DOUBLE)"
_FWD = ", ".join(
    f"count(*) OVER (PARTITION BY src ORDER BY t_us RANGE BETWEEN CURRENT ROW AND {w * 1_000_000} FOLLOWING) AS count_{w}s" for w in SIZES)


@query("time_delta", f"SELECT flow_id, round({_DELTA},6)+0.0 AS time_delta FROM flow", "flow")
def _(spark, sf):
    return X.time_delta(V.flow(spark, sf).select("flow_id", "src", "t_us"), "src", "t_us", "flow_id").select("flow_id", r6("time_delta").alias("time_delta"))


@query("forward_counts", f"SELECT flow_id, {_FWD} FROM flow", "flow")
def _(spark, sf):
    return X.forward_counts(V.flow(spark, sf).select("flow_id", "src", "t_us"), "src", "t_us", SIZES).drop("src", "t_us")


@query("time_delta_features", f"SELECT flow_id, src, t_us, round({_DELTA},6)+0.0 AS time_delta, {_FWD} FROM flow", "flow")
def time_delta_features(spark, sf):
    f = V.flow(spark, sf).select("flow_id", "src", "t_us")
    return X.time_delta_features(f, "src", "t_us", "flow_id", SIZES).withColumn("time_delta", r6("time_delta"))


def _agg_sql(prefix: str, keys: str) -> str:
    c = f"{prefix}_bytes"
    return (f"SELECT {keys}, t_us - t_us % 60000000 AS minute_us, round(avg(bytes),6)+0.0 AS {c}_mean, max(bytes) AS {c}_max, min(bytes) AS {c}_min, "
            f"round(stddev_samp(bytes),6)+0.0 AS {c}_std, count(bytes) AS {c}_count FROM flow GROUP BY ALL")


def _rounded(df):
    return df.withColumns({c: r6(c) for c in df.columns if c.endswith("_mean") or c.endswith("_std")})


for _prefix, _keys in (("src", ["src"]), ("dst", ["dst"]), ("pair", ["src", "dst"])):
    def _minute(spark, sf, prefix=_prefix, keys=_keys):
        f = V.flow(spark, sf).select(*keys, "t_us", "bytes")
        return _rounded(X.minute_agg(f, keys, "t_us", ["bytes"], prefix))
    query(f"{_prefix}_minute_agg", _agg_sql(_prefix, ", ".join(_keys)), "flow")(_minute)


_JOINED = "SELECT f.*, " + ", ".join(
    f"{p}.{p}_bytes_{s}" for p in ("src", "dst", "pair") for s in ("mean", "max", "min", "std", "count")) + f"""
    FROM (SELECT flow_id, src, dst, t_us, bytes, t_us - t_us % 60000000 AS minute_us FROM flow) f
    LEFT JOIN ({_agg_sql('src', 'src')}) src USING (src, minute_us)
    LEFT JOIN ({_agg_sql('dst', 'dst')}) dst USING (dst, minute_us)
    LEFT JOIN ({_agg_sql('pair', 'src, dst')}) pair USING (src, dst, minute_us)"""


@query("packet_features", _JOINED, "flow")
def _(spark, sf):
    f = V.flow(spark, sf).select("flow_id", "src", "dst", "t_us", "bytes")
    return _rounded(X.packet_features(f, "src", "dst", "t_us", "flow_id", ["bytes", "absent feature"]))


@query("recent_view", """SELECT flow_id, max(bytes) OVER w AS recent_max, CAST(sum(CAST(bytes > 50 AS INT)) OVER w AS BIGINT) AS recent_alerts
    FROM flow WINDOW w AS (ORDER BY t_us, flow_id ROWS BETWEEN 100 PRECEDING AND CURRENT ROW)""", "flow")
def _(spark, sf):
    f = V.flow(spark, sf).select("flow_id", "t_us", "bytes")
    return X.recent_view(f, ["t_us", "flow_id"], "bytes", 100, 50.0).select("flow_id", "recent_max", "recent_alerts")


# --- edge store -----------------------------------------------------------------------------

@query("edges_append", "SELECT *, t_us // 86400000000 AS day FROM edge UNION ALL SELECT *, t_us // 86400000000 FROM edge", "edge")
def _(spark, sf):
    path = scratch_path(spark, "edges")
    E.append(V.edge(spark, sf), path)
    E.append(V.edge(spark, sf), path)
    return E.read(spark, path).withColumn("day", F.col("day").cast("long"))


@query("edges_group_by_time", "SELECT t_us, count(*) AS n_edges FROM edge GROUP BY t_us", "edge")
def _(spark, sf):
    return E.group_by_time(V.edge(spark, sf))


@query("edges_in_window", "SELECT * FROM edge WHERE t_us BETWEEN 1704672000000000 AND 1704844800000000", "edge")
def _(spark, sf):
    return E.in_window(V.edge(spark, sf), 1704672000000000, 1704844800000000).orderBy("t_us", "flow_id")


@query("edges_recent", "SELECT * FROM edge WHERE t_us >= (SELECT max(t_us) FROM edge) - 172800000000", "edge")
def _(spark, sf):
    return E.recent(V.edge(spark, sf), 2 * DAY_US)


@query("edges_expire", "SELECT * FROM edge WHERE t_us >= 1704844800000000", "edge")
def _(spark, sf):
    return E.expire(V.edge(spark, sf), 1704844800000000)


@query("edges_expire_report", """SELECT count(*) FILTER (t_us < 1704844800000000) AS removed, count(*) FILTER (t_us >= 1704844800000000) AS kept FROM edge""", "edge")
def _(spark, sf):
    return E.expire_report(V.edge(spark, sf), 1704844800000000)


@query("edges_retention", "SELECT * FROM edge WHERE t_us >= (SELECT max(t_us) FROM edge) - 86400000000", "edge")
def _(spark, sf):
    return E.retention(V.edge(spark, sf))


@query("edges_time_span", "SELECT min(t_us) AS earliest_us, max(t_us) AS latest_us FROM edge", "edge")
def _(spark, sf):
    return E.time_span(V.edge(spark, sf))


@query("edges_statistics", """SELECT count(*) AS total_edges, count(*) FILTER (t_us >= (SELECT max(t_us) FROM edge) - 86400000000) AS active_edges,
    count(DISTINCT t_us) AS distinct_times, min(t_us) AS earliest_us, max(t_us) AS latest_us, max(t_us)-min(t_us) AS span_us FROM edge""", "edge")
def _(spark, sf):
    return E.statistics(V.edge(spark, sf), DAY_US)


# --- node lives -----------------------------------------------------------------------------

_SEEN = "WITH seen AS (SELECT src AS id, t_us FROM edge UNION ALL SELECT dst, t_us FROM edge), life AS (SELECT id, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS activity FROM seen GROUP BY id) "


def _seen(spark, sf):
    return L.sightings(V.edge(spark, sf).select("src", "dst", "t_us"))


def _asked(spark, sf):
    """Known sources plus ids never seen (customers play the unknown nodes)."""
    return V.table(spark, sf, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"))


_ASKED = "(SELECT 's'||c_custkey AS id FROM customer)"


def _now(spark, sf):
    return E.max_time(V.edge(spark, sf))


@query("node_lifecycle", _SEEN + "SELECT * FROM life", "edge")
def _(spark, sf):
    return L.lifecycle(_seen(spark, sf))


@query("nodes_per_bucket", _SEEN + "SELECT t_us // 3600000000 AS bucket, count(DISTINCT id) AS n_nodes FROM seen GROUP BY 1", "edge")
def _(spark, sf):
    return L.nodes_per_bucket(_seen(spark, sf), HOUR_US)


@query("nodes_in_window", _SEEN + """SELECT id, first_us, last_us FROM life WHERE first_us <= 1704704400000000 AND last_us >= 1704672000000000
    AND id IN (SELECT id FROM seen WHERE t_us // 3600000000 BETWEEN 1704672000000000 // 3600000000 AND 1704704400000000 // 3600000000)""", "edge")
def _(spark, sf):
    return L.nodes_in_window(_seen(spark, sf), 1704672000000000, 1704704400000000, HOUR_US)


@query("active_nodes", _SEEN + """, m AS (SELECT max(t_us) AS now FROM seen) SELECT id, first_us, last_us FROM life, m WHERE last_us >= now - 3600000000
    AND id IN (SELECT id FROM seen, m WHERE t_us // 60000000 BETWEEN (now - 3600000000) // 60000000 AND now // 60000000)""", "edge")
def _(spark, sf):
    return L.active_nodes(_seen(spark, sf), _now(spark, sf), HOUR_US, MIN_US)


@query("is_node_active", _SEEN + f"""SELECT a.id, coalesce((SELECT max(t_us) FROM seen) - last_us <= 86400000000, false) AS active FROM {_ASKED} a LEFT JOIN life USING (id)""", "edge")
def _(spark, sf):
    return L.is_active(_asked(spark, sf), L.lifecycle(_seen(spark, sf)), _now(spark, sf), DAY_US)


@query("node_activity_span", _SEEN + f"SELECT a.id, first_us, last_us, activity, last_us - first_us AS span_us FROM {_ASKED} a LEFT JOIN life USING (id)", "edge")
def _(spark, sf):
    return L.activity_span(_asked(spark, sf), L.lifecycle(_seen(spark, sf)))


@query("remove_nodes", _SEEN + f"SELECT * FROM life WHERE id NOT IN {_ASKED}", "edge")
def _(spark, sf):
    return L.remove_nodes(L.lifecycle(_seen(spark, sf)), _asked(spark, sf))


@query("tracked_nodes", _SEEN + "SELECT id FROM life EXCEPT SELECT id FROM life WHERE (SELECT max(t_us) FROM seen) - last_us > 86400000000", "edge")
def _(spark, sf):
    life = L.lifecycle(_seen(spark, sf))
    return L.tracked_nodes(life, life.where(F.lit(_now(spark, sf)) - F.col("last_us") > DAY_US))


@query("time_points", "SELECT DISTINCT t_us FROM edge", "edge")
def _(spark, sf):
    return L.time_points(V.edge(spark, sf)).orderBy("t_us")


@query("rebucket", _SEEN + "SELECT first_us // 86400000000 AS bucket, id FROM life", "edge")
def _(spark, sf):
    return L.rebucket(_seen(spark, sf), HOUR_US, DAY_US)


@query("bucket_cleanup", _SEEN + "SELECT DISTINCT t_us // 3600000000 AS bucket, id FROM seen WHERE t_us // 3600000000 >= ((SELECT max(t_us) FROM seen) - 604800000000) // 3600000000", "edge")
def _(spark, sf):
    return L.bucket_cleanup(_seen(spark, sf), HOUR_US, 7 * DAY_US)


@query("lifecycle_statistics", _SEEN + """SELECT count(*) AS total_nodes, count(*) FILTER (now - last_us <= 86400000000) AS active_nodes,
    count(*) FILTER (now - last_us > 86400000000) AS inactive_nodes, min(first_us) AS earliest_us, max(last_us) AS latest_us,
    (SELECT count(DISTINCT t_us // 3600000000) FROM seen) AS n_buckets FROM life, (SELECT max(t_us) AS now FROM seen)""", "edge")
def _(spark, sf):
    return L.statistics(_seen(spark, sf), _now(spark, sf), DAY_US, HOUR_US)
