"""Queries that run as Structured Streaming jobs over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.catalog.scoring import C2, D1, D2, HEADS, LAYERS, OUT, TDIM, _affine, encode, grid, layer_sql
from flowhelm.functions.scalar import r6
from flowhelm.operators import attention as A
from flowhelm.operators import edges as E
from flowhelm.session import scratch_path, stored
from flowhelm.streaming import jobs as J
from flowhelm.streaming import state as S

HOUR_US, DAY_US = 3_600_000_000, 86_400_000_000


LATE_US = 1_800_000_000


def _sliced(rows, slices: int = 3):
    """Rows with the time slice they arrive in. A third of the rows of a slice's last half hour come late, with the next slice."""
    lo, hi = rows.agg(F.min("t_us"), F.max("t_us")).first()
    step = (hi - lo) // slices + 1
    at = F.floor((F.col("t_us") - lo) / step)
    late = (F.pmod("flow_id", F.lit(3)) == 0) & (F.floor((F.col("t_us") + LATE_US - lo) / step) > at)
    return rows.withColumn("_slice", F.least(at + late.cast("int"), F.lit(slices - 1)))


def _as_stream(spark, placed, slices: int = 3):
    """Rows as a stream of their slices, written one after the other, so that state crosses micro-batches."""
    path = scratch_path(spark, "arriving")
    rows = placed.drop("_slice")
    for i in range(slices):
        placed.where(F.col("_slice") == i).drop("_slice").repartition(4).write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return J.stream_source(spark, path, rows.schema, files_per_batch=max(1, files // slices))


def _slices(spark, rows, slices: int = 3):
    return _as_stream(spark, _sliced(rows, slices), slices)


def _events(spark, sf):
    """The event table as a stream with the flow columns and an event-time column."""
    raw = V.table(spark, sf, "events")
    return _slices(spark, raw.select(
        F.col("event_id").alias("flow_id"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("d"), F.get_json_object("props", "$.k")).alias("dst"), F.col("value").alias("bytes")))


def _arriving(spark, sf, slices: int = 3):
    return _slices(spark, V.edge(spark, sf), slices)


@query("stream_source", "SELECT flow_id, src, dst, t_us, bytes FROM edge", "edge")
def _(spark, sf):
    path = scratch_path(spark, "stream")
    J.run_appended(_arriving(spark, sf), path)
    return spark.read.parquet(path)


_FIRST = "SELECT src, dst, arg_min(t_us, flow_id) AS t_us, min(flow_id) AS flow_id FROM edge GROUP BY src, dst"


_ARRIVING = """b AS (SELECT min(t_us) AS lo, (max(t_us)-min(t_us))//3 + 1 AS step FROM edge),
    arr AS MATERIALIZED (SELECT edge.*, least(2, (t_us-lo)//step + CASE WHEN flow_id % 3 = 0 AND (t_us+1800000000-lo)//step > (t_us-lo)//step THEN 1 ELSE 0 END) AS slice FROM edge, b)"""
_SLICED = f"""WITH {_ARRIVING},
    ends AS (SELECT src AS id, slice FROM arr UNION ALL SELECT dst, slice FROM arr),
    reg AS (SELECT id, min(slice) + CASE WHEN CAST(substr(id, 2) AS BIGINT) % 10 = 3 THEN 1 ELSE 0 END AS since FROM ends WHERE CAST(substr(id, 2) AS BIGINT) % 10 <> 7 GROUP BY id),
    ok AS (SELECT arr.* FROM arr JOIN reg x ON x.id = src AND x.since <= slice JOIN reg y ON y.id = dst AND y.since <= slice),
    life AS (SELECT id, max(t_us) AS last_us FROM (SELECT src AS id, t_us FROM ok UNION ALL SELECT dst, t_us FROM ok) GROUP BY id)
    SELECT f.src, f.dst, f.t_us, f.flow_id, a.last_us AS src_last_us, c.last_us AS dst_last_us
    FROM (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY slice, t_us, flow_id) = 1) f JOIN life a ON a.id = f.src JOIN life c ON c.id = f.dst"""


@query("graph_batch_update", _SLICED, "edge")
def _(spark, sf):
    """Nodes registered with the first of their events, but some a slice late and some never; edges batch by batch between nodes known by
    then; then the temporal graph read from the store."""
    placed = _sliced(V.edge(spark, sf).select("flow_id", "src", "dst", "t_us"))
    number = F.substring("id", 2, 20).cast("long") % 10
    since = placed.select(F.explode(F.array("src", "dst")).alias("id"), "_slice").groupBy("id").agg(F.min("_slice").alias("_slice"))
    news = since.where(number != 7).withColumn("_slice", F.col("_slice") + (number == 3).cast("int")).where("_slice < 3")
    both = placed.withColumn("id", F.lit(None).cast("string")).unionByName(news, allowMissingColumns=True)
    arriving, store = _as_stream(spark, both), scratch_path(spark, "graph")
    J.grow_graph(spark, arriving.where("id IS NOT NULL").select("id"), arriving.where("id IS NULL").select("src", "dst", "t_us", "flow_id"), store)
    return J.temporal_graph(spark, store)


@query("stream_source_csv", "SELECT flow_id, src, dst, t_us, bytes FROM edge", "edge")
def _(spark, sf):
    folder, path = scratch_path(spark, "csv"), scratch_path(spark, "stream")
    edges = V.edge(spark, sf)
    edges.write.option("header", True).csv(folder)
    J.run_appended(J.stream_source(spark, folder, edges.schema, "*.csv", fmt="csv", header=True), path)
    return spark.read.parquet(path)


_REACH_US = 10 * DAY_US
_DETECTED = f"""WITH {_ARRIVING},
    bt AS (SELECT unnest(range(3)) AS b), cut AS (SELECT b, max(t_us) - {_REACH_US} AS low FROM bt JOIN arr ON slice <= b GROUP BY b),
    ed AS (SELECT b, flow_id, src, dst, (t_us % {DAY_US})/1000000.0::DOUBLE AS t FROM cut JOIN arr ON slice <= b AND t_us >= low),
    nd AS (SELECT b, id, feat FROM bt, node),
    touched AS (SELECT DISTINCT slice AS b, id FROM (SELECT slice, src AS id FROM arr UNION ALL SELECT slice, dst FROM arr)),
    {layer_sql(LAYERS[0], 'ed', 'nd', 'l0')},
    fe AS (SELECT l0.b, l0.id, feat FROM l0 JOIN touched USING (b, id)),
    hd AS (SELECT b, [{', '.join(f'greatest({x},0)' for x in _affine(grid(6, HEADS * OUT, 1), D1, 'feat'))}] AS z FROM fe), lg AS (SELECT b, [{', '.join(_affine(C2, D2, 'z'))}] AS l FROM hd),
    pr AS (SELECT b, 1 - ex[1]/list_sum(ex) AS p FROM (SELECT b, [exp(x - list_max(l)) FOR x IN l] AS ex FROM lg))
    SELECT CAST(b AS INT) AS batch, round(max(p),6)+0.0 AS score, bool_or(p > 0.7) AS alert FROM pr GROUP BY b"""


def touched_vectors(found, nodes, window_us: int = _REACH_US, newest: int | None = None):
    """Vectors of the touched nodes of a micro-batch from the edges that reach them (rows of :func:`state.edges_into_touched`)."""
    newest = found.agg(F.max("t_us")).first()[0] if newest is None else newest
    edges = found.where(F.col("src").isNotNull() & (F.col("t_us") >= newest - window_us)).dropDuplicates(["flow_id"])
    edges = edges.select("flow_id", "src", "dst", (F.pmod(F.col("t_us"), F.lit(DAY_US)) / F.lit(1e6)).alias("t"))
    touched = found.where("hop = 0").select(F.col("dst").alias("id")).distinct()
    reached = touched.unionByName(edges.select(F.col("src").alias("id"))).distinct()
    return A.tgat_layer(edges, nodes.join(reached, "id", "left_semi"), LAYERS[0], encode, TDIM).join(touched, "id", "left_semi")


@query("stream_detect", _DETECTED, "edge node")
def _(spark, sf):
    """Per micro-batch: the nodes it touches are scored over the last ten days, from the edges into them and into their sources alone, which
    keyed state holds; then the alert is recorded."""
    newest, alerts = scratch_path(spark, "newest"), scratch_path(spark, "alerts")
    nodes = V.node(spark, sf).select("id", "feat")

    def score(batch, number):
        found = stored(batch, "found")
        found.agg(F.max("t_us").alias("t_us")).write.mode("overwrite").parquet(f"{newest}/_batch={number}")
        top = spark.read.parquet(newest).where(F.col("_batch") <= number).agg(F.max("t_us")).first()[0]
        if top is None:
            return
        vectors = touched_vectors(found, nodes, newest=top)
        probs = A.classify(vectors, grid(6, HEADS * OUT, 1), D1, C2, D2).select(F.lit(number).alias("batch"), A.attack_probability().alias("score"))
        A.batch_alerts(probs, "batch", "score", 0.7).write.mode("overwrite").json(f"{alerts}/_batch={number}")

    with S.on_disk(spark):
        J.run_batches(S.edges_into_touched(_arriving(spark, sf), _REACH_US), score)
    return spark.read.schema("batch int, score double, alert boolean").json(alerts).select("batch", r6("score").alias("score"), "alert")


def _window_sql(size: int, step: int) -> str:
    k = size // step
    return f"SELECT (t_us//{step} - k)*{step} AS start_us, count(*) AS n, max(bytes) AS top FROM flow, (SELECT unnest(range({k})) AS k) GROUP BY ALL"


@query("stream_tumbling", _window_sql(HOUR_US, HOUR_US), "flow")
def _(spark, sf):
    return J.run_updates(J.windowed(_events(spark, sf), "ts", "1 hour", value="bytes"), ["start_us"])


@query("stream_sliding", _window_sql(2 * HOUR_US, HOUR_US), "flow")
def _(spark, sf):
    return J.run_updates(J.windowed(_events(spark, sf), "ts", "2 hours", "1 hour", value="bytes"), ["start_us"])


_IDLE_S = 86_400
_LIVES = f"""WITH s AS (SELECT id, t_us, flow_id, lag(t_us) OVER (PARTITION BY id ORDER BY t_us, flow_id) AS prev FROM (SELECT src AS id, t_us, flow_id FROM edge UNION ALL SELECT dst, t_us, flow_id FROM edge)),
    n AS (SELECT *, sum(CASE WHEN prev IS NULL OR t_us - prev > {_IDLE_S * 1_000_000} THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING) AS g FROM s)
    SELECT id, min(t_us) AS first_us, max(t_us) AS last_us, count(*) AS activity, max(t_us) + {_IDLE_S * 1_000_000} <= (SELECT max(t_us)//1000*1000 FROM edge) - {DAY_US} AS ended FROM n GROUP BY id, g"""


@query("stream_node_state", _LIVES, "edge")
def _(spark, sf):
    """Lives of nodes as keyed state with timers: a node is forgotten a day after its last event, and lives again with the next one."""
    seen = _events(spark, sf).select(F.explode(F.array("src", "dst")).alias("id"), "t_us", "ts")
    path = scratch_path(spark, "lives")
    with S.on_disk(spark):
        J.run_batches(S.node_lives(seen, "ts", _IDLE_S, "24 hours"), J.write_batch(path), "update")
    return S.latest_lives(spark.read.parquet(path))


def _closed(key: str, idle_us: int) -> str:
    """Sessions the watermark (24 h behind the last event, whole milliseconds) has passed."""
    return f"""WITH s AS (SELECT {key}, t_us, flow_id, lag(t_us) OVER (PARTITION BY {key} ORDER BY t_us, flow_id) AS prev FROM edge),
    n AS (SELECT *, sum(CASE WHEN prev IS NULL OR t_us - prev > {idle_us} THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY t_us, flow_id ROWS UNBOUNDED PRECEDING) AS g FROM s)
    SELECT {key}, min(t_us) AS start_us, max(t_us) + {idle_us} AS end_us, count(*) AS n FROM n GROUP BY {key}, g
    HAVING max(t_us) + {idle_us} <= (SELECT max(t_us)//1000*1000 FROM edge) - {DAY_US}"""


@query("stream_sessions", _closed("src", HOUR_US), "edge")
def _(spark, sf):
    path = scratch_path(spark, "sessions")
    J.run_appended(J.activity_sessions(_events(spark, sf), "src", "ts", "1 hour", "24 hours"), path)
    return spark.read.parquet(path)


@query("stream_state_ttl", _closed("dst", 1800 * 1_000_000), "edge")
def _(spark, sf):
    """Node lives that ended by being idle for half an hour; their state is gone."""
    path = scratch_path(spark, "lives")
    J.run_appended(J.activity_sessions(_events(spark, sf), "dst", "ts", "30 minutes", "24 hours"), path)
    return spark.read.parquet(path)


def _kept_store(spark, sf):
    path = scratch_path(spark, "store")
    J.run_batches(_arriving(spark, sf), J.retention_batches(spark, path, DAY_US))
    return spark.read.parquet(path)


@query("stream_retention", "SELECT flow_id, src, dst, t_us, bytes FROM edge WHERE t_us >= (SELECT max(t_us) FROM edge) - 86400000000", "edge")
def _(spark, sf):
    """Edges appended by a stream to a day-partitioned store that forgets old days, read with the retention bound."""
    return E.retention(_kept_store(spark, sf)).select("flow_id", "src", "dst", "t_us", "bytes")


@query("stream_retention_store", "SELECT t_us//86400000000 AS day, count(*) AS n FROM edge WHERE t_us//86400000000 >= ((SELECT max(t_us) FROM edge) - 86400000000)//86400000000 GROUP BY ALL", "edge")
def _(spark, sf):
    """What is still stored: whole days only."""
    return _kept_store(spark, sf).groupBy(F.col("day").cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("stream_edge_dedup", "SELECT src, dst, min(t_us) AS t_us, arg_min(flow_id, [t_us, flow_id]) AS flow_id FROM edge GROUP BY src, dst", "edge")
def _(spark, sf):
    return J.run_updates(J.first_edges(_arriving(spark, sf)), ["src", "dst"])


@query("stream_proximity_join", "SELECT a.flow_id AS src, b.flow_id AS dst, b.t_us FROM flow a JOIN flow b ON a.t_us <= b.t_us AND a.t_us >= b.t_us - 60000000 AND a.flow_id <> b.flow_id", "flow")
def _(spark, sf):
    path, events = scratch_path(spark, "near"), _events(spark, sf)
    J.run_appended(J.proximity_join(events, events, 60), path)
    return spark.read.parquet(path)


@query("stream_sink", "SELECT flow_id, t_us, bytes FROM flow WHERE bytes > 50", "flow")
def _(spark, sf):
    path = scratch_path(spark, "sink")
    J.run_appended(_events(spark, sf).where("bytes > 50").select("flow_id", "t_us", "bytes"), path, "json")
    return spark.read.schema("flow_id long, t_us long, bytes double").json(path)
