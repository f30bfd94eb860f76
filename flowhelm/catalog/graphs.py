"""Queries for building and cutting temporal graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions.scalar import r6
from flowhelm.operators import graph as G
from flowhelm.operators.knn import knn_graph

WEEK_S = 7 * 86_400
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000
NOW, SINCE = 1704844800000000, 1704844800000000 - 21600000000
DIM = V.DIM

_E50 = f"""SELECT flow_id AS src_flow, id2 AS dst_flow, t2 AS t_us, round((t2-t_us)/1000000.0::DOUBLE,6)+0.0 AS gap, round(CASE WHEN bytes > 0 THEN s2/bytes ELSE 0 END,6)+0.0 AS size_ratio FROM (
    SELECT *, lead(t_us) OVER w AS t2, lead(flow_id) OVER w AS id2, lead(bytes) OVER w AS s2 FROM (
        SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY t_us, flow_id) AS rn FROM flow) WHERE rn <= 50 WINDOW w AS (PARTITION BY src, dst ORDER BY t_us, flow_id))
    WHERE (t2-t_us)/1000000.0 <= {WEEK_S}"""


_E1 = _E50.replace("rn <= 50", "true")


def temporal_edges(spark, sf, **options):
    return G.temporal_edges(V.flow(spark, sf), "src", "dst", "t_us", "flow_id", "bytes", WEEK_S, **options)


@query("temporal_edges", _E1, "flow")
def _(spark, sf):
    return temporal_edges(spark, sf).withColumns({"gap": r6("gap"), "size_ratio": r6("size_ratio")})


@query("temporal_edges_capped", _E50.replace("rn <= 50", "rn <= 2").replace("PARTITION BY src, dst", "PARTITION BY src, dst % 10").replace("FROM flow)", "FROM (SELECT * EXCLUDE(dst), dst % 10 AS dst FROM flow))"), "flow")
def _(spark, sf):
    """The first two flows of each pair alone; pairs are made coarse enough to reach the cap."""
    flow = V.flow(spark, sf).withColumn("dst", F.col("dst") % 10)
    capped = G.temporal_edges(flow, "src", "dst", "t_us", "flow_id", "bytes", WEEK_S, per_pair=2)
    return capped.withColumns({"gap": r6("gap"), "size_ratio": r6("size_ratio")})


@query("ip_pair_groups", "SELECT src, dst, count(*) AS n_flows, min(t_us) AS first_us, max(t_us) AS last_us FROM flow GROUP BY ALL", "flow")
def _(spark, sf):
    return G.pair_groups(V.flow(spark, sf), "src", "dst", "t_us")


@query("ip_pair_members", "SELECT src, dst, t_us, flow_id, row_number() OVER (PARTITION BY src, dst ORDER BY t_us, flow_id) AS position FROM flow", "flow")
def _(spark, sf):
    return G.pair_members(V.flow(spark, sf), "src", "dst", "t_us", "flow_id")


# A graph holding the first hour; everything later arrives as updates.
_OLD = """t0 AS (SELECT min(t_us) + 3600000000 AS cut FROM edge), snt AS (SELECT src AS id, flow_id*2 AS seq, t_us, bytes FROM edge UNION ALL SELECT dst, flow_id*2+1, t_us, bytes FROM edge),
    old AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS internal_id, arg_max(t_us, seq) AS ts, arg_max(bytes, seq) AS val FROM snt, t0 WHERE t_us < cut GROUP BY id),
    upd AS (SELECT snt.* FROM snt, t0 WHERE t_us >= cut)"""


def _arrivals(spark, sf):
    e = V.edge(spark, sf)
    cut = e.agg(F.min("t_us")).first()[0] + HOUR_US
    ends = F.array(F.struct(F.col("src").alias("id"), (F.col("flow_id") * 2).alias("seq")), F.struct(F.col("dst").alias("id"), (F.col("flow_id") * 2 + 1).alias("seq")))
    sent = e.select("t_us", "bytes", F.inline(ends)).select("id", "seq", F.col("t_us").alias("ts"), F.col("bytes").alias("val"))
    old = sent.where(F.col("ts") < cut).groupBy("id").agg(F.max_by("ts", "seq").alias("ts"), F.max_by("val", "seq").alias("val"))
    old = G.number(old, ["id"], name="_rn").select("id", (F.col("_rn") - 1).alias("internal_id"), "ts", "val")
    return old, sent.where(F.col("ts") >= cut), cut


@query("upsert_nodes", f"""WITH {_OLD}, nw AS (SELECT id, arg_max(t_us, seq) AS ts, arg_max(bytes, seq) AS val, min(seq) AS arrival FROM upd GROUP BY id)
    SELECT o.id, internal_id, coalesce(n.ts, o.ts) AS ts, coalesce(n.val, o.val) AS val FROM old o LEFT JOIN nw n USING (id)
    UNION ALL SELECT id, (SELECT max(internal_id) FROM old) + row_number() OVER (ORDER BY arrival, id), ts, val FROM nw WHERE id NOT IN (SELECT id FROM old)""", "edge")
def _(spark, sf):
    old, upd, _ = _arrivals(spark, sf)
    return G.upsert_nodes(old, upd)


@query("insert_nodes_once", f"WITH {_OLD} SELECT id, ts, val FROM old UNION ALL SELECT id, arg_min(t_us, seq), arg_min(bytes, seq) FROM upd WHERE id NOT IN (SELECT id FROM old) GROUP BY id", "edge")
def _(spark, sf):
    old, upd, _ = _arrivals(spark, sf)
    return G.insert_nodes_once(old.drop("internal_id"), upd)


# Known nodes: label below 8, so some endpoints are unknown.
@query("insert_edges", """WITH t0 AS (SELECT min(t_us) + 86400000000 AS cut FROM edge), old AS (SELECT src, dst, arg_min(t_us, flow_id) AS t_us, min(flow_id) AS flow_id FROM edge, t0 WHERE t_us < cut GROUP BY src, dst)
    SELECT * FROM old UNION ALL SELECT src, dst, arg_min(t_us, flow_id), min(flow_id) FROM edge, t0 WHERE t_us >= cut AND src IN (SELECT id FROM node WHERE label < 8) AND dst IN (SELECT id FROM node WHERE label < 8)
    AND NOT EXISTS (SELECT 1 FROM old WHERE old.src = edge.src AND old.dst = edge.dst) GROUP BY src, dst""", "edge node")
def _(spark, sf):
    e = V.edge(spark, sf).select("src", "dst", "t_us", "flow_id")
    cut = e.agg(F.min("t_us")).first()[0] + DAY_US
    old = e.where(F.col("t_us") < cut).groupBy("src", "dst").agg(F.min_by("t_us", "flow_id").alias("t_us"), F.min("flow_id").alias("flow_id"))
    return G.insert_edges(old, e.where(F.col("t_us") >= cut), V.node(spark, sf).where("label < 8"))


@query("validate_edges", "SELECT count(*) AS n, 0::BIGINT AS missing_ends, count(*) FILTER (bytes > 90) AS bad_width, 0::BIGINT AS missing_time FROM edge", "edge")
def _(spark, sf):
    e = V.edge(spark, sf).withColumn("feat", F.when(F.col("bytes") > 90, F.array("bytes")).otherwise(F.array("bytes", F.lit(0.0))))
    return G.validate_edges(e, 2)


def _known(spark, sf):
    return V.node(spark, sf).where("label < 8")


_ZERO = f"[0.0::DOUBLE FOR i IN range({DIM})]"
_LONG = f"SELECT id, label, unnest(range({DIM}))::INT AS pos, unnest(feat) AS value FROM"
_WIN = f"cut AS (SELECT * FROM edge WHERE t_us BETWEEN {SINCE} AND {NOW}), ends AS (SELECT src AS id FROM cut UNION SELECT dst FROM cut)"


def _exploded(nodes, *keep):
    return nodes.select("id", *keep, F.posexplode("feat").alias("pos", "value"))


@query("temporal_subgraph", f"WITH {_WIN} SELECT * FROM cut", "edge")
def _(spark, sf):
    return G.temporal_subgraph(V.edge(spark, sf), _known(spark, sf), NOW, NOW - SINCE, DIM)[0]


@query("temporal_subgraph_nodes", f"WITH {_WIN}, j AS (SELECT ends.id, coalesce(feat, {_ZERO}) AS feat, coalesce(label,-1) AS label FROM ends LEFT JOIN (SELECT * FROM node WHERE label < 8) USING (id)) {_LONG} j", "edge node")
def _(spark, sf):
    return _exploded(G.temporal_subgraph(V.edge(spark, sf), _known(spark, sf), NOW, NOW - SINCE, DIM)[1], "label")


@query("temporal_subgraph_all_nodes", f"WITH cut AS (SELECT * FROM edge WHERE t_us >= {SINCE}) SELECT id, (SELECT count(*) FROM cut WHERE src = id) + (SELECT count(*) FROM cut WHERE dst = id) AS degree FROM node", "edge node")
def _(spark, sf):
    e, n = G.temporal_subgraph_all_nodes(V.edge(spark, sf), V.node(spark, sf), NOW, NOW - SINCE)
    return G.degrees(e, n).select("id", "degree")


@query("subgraph_caps", f"WITH picked AS (SELECT id FROM node ORDER BY md5(concat(id,'|cap')) LIMIT 200) SELECT * FROM edge WHERE t_us BETWEEN {NOW - DAY_US} AND {NOW} AND src IN (SELECT id FROM picked) AND dst IN (SELECT id FROM picked) ORDER BY t_us, flow_id LIMIT 150", "edge node")
def _(spark, sf):
    return G.subgraph_caps(V.edge(spark, sf), V.node(spark, sf), NOW, DAY_US, 200, 150, "cap")[0].select("flow_id", "src", "dst", "t_us", "bytes")


@query("add_self_loops", "SELECT src, dst FROM edge UNION ALL SELECT id, id FROM node", "edge node")
def _(spark, sf):
    return G.add_self_loops(V.edge(spark, sf), V.node(spark, sf))


def _lives(spark, sf):
    return V.node(spark, sf).select("id", F.col("ts").alias("last_us"))


_IDLE = "WITH idle AS (SELECT id FROM node WHERE (SELECT max(ts) FROM node) - ts > 86400000000)"


@query("prune_inactive", _IDLE + " SELECT * FROM edge WHERE src NOT IN (SELECT id FROM idle) AND dst NOT IN (SELECT id FROM idle)", "edge node")
def _(spark, sf):
    return G.prune_inactive(_lives(spark, sf), V.edge(spark, sf), DAY_US)[1]


@query("prune_inactive_nodes", _IDLE + " SELECT id, ts AS last_us FROM node WHERE id NOT IN (SELECT id FROM idle)", "edge node")
def _(spark, sf):
    return G.prune_inactive(_lives(spark, sf), V.edge(spark, sf), DAY_US)[0]


@query("prune_inactive_guarded", _IDLE + " SELECT id, ts AS last_us FROM node WHERE id NOT IN (SELECT id FROM idle) OR (SELECT count(*) FROM idle) < 0.1 * (SELECT count(*) FROM node)", "edge node")
def _(spark, sf):
    return G.prune_inactive(_lives(spark, sf), V.edge(spark, sf), DAY_US, least_share=0.1)[0]


@query("relabel_ids", "WITH r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM node) SELECT flow_id, a.new_id AS src_id, b.new_id AS dst_id FROM edge JOIN r a ON a.id = src JOIN r b ON b.id = dst", "edge node")
def _(spark, sf):
    return G.relabel(V.node(spark, sf), V.edge(spark, sf))[1].select("flow_id", "src_id", "dst_id")


_COS = "list_inner_product({a},{b})/(sqrt(list_inner_product({a},{a}))*sqrt(list_inner_product({b},{b}))+1e-8::DOUBLE)"


@query("proximity_edges", f"""WITH nd AS (SELECT flow_id AS id, t_us, [bytes, dst::DOUBLE, src::DOUBLE, 1.0::DOUBLE] AS feat FROM flow)
    SELECT a.id AS src, b.id AS dst, b.t_us, round((b.t_us-a.t_us)/1000000.0::DOUBLE,6)+0.0 AS dt, round({_COS.format(a='a.feat', b='b.feat')},6)+0.0 AS similarity
    FROM nd a JOIN nd b ON a.t_us <= b.t_us AND a.t_us >= b.t_us - 60000000 AND a.id <> b.id""", "flow")
def _(spark, sf):
    n = V.flow(spark, sf).select(F.col("flow_id").alias("id"), "t_us", F.array(F.col("bytes"), F.col("dst").cast("double"), F.col("src").cast("double"), F.lit(1.0)).alias("feat"))
    return G.proximity_edges(n, 60_000_000).withColumns({"dt": r6("dt"), "similarity": r6("similarity")})


@query("edge_similarity", """WITH el AS (SELECT id, unnest(feat) AS x, generate_subscripts(feat, 1) AS k FROM node), nm AS (SELECT id, sqrt(sum(x*x)) AS norm FROM el GROUP BY id),
    pr AS (SELECT DISTINCT src, dst FROM edge), dt AS (SELECT src, dst, sum(a.x*b.x) AS dot FROM pr JOIN el a ON a.id = src JOIN el b ON b.id = dst AND b.k = a.k GROUP BY src, dst),
    sim AS (SELECT src, dst, round(dot/(p.norm*q.norm+1e-8::DOUBLE),6)+0.0 AS similarity FROM dt JOIN nm p ON p.id = src JOIN nm q ON q.id = dst)
    SELECT flow_id, similarity FROM edge JOIN sim USING (src, dst)""", "edge node")
def _(spark, sf):
    return G.edge_similarity(V.edge(spark, sf), V.node(spark, sf)).select("flow_id", r6("similarity").alias("similarity"))


@query("knn_graph", """SELECT vec_id, CAST(rank AS INT) AS rank, neighbour, round(distance,6)+0.0 AS distance FROM (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS rank FROM emb a JOIN emb b ON a.vec_id <> b.vec_id) WHERE rank <= 5""", "emb")
def _(spark, sf):
    vectors = V.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return knn_graph(vectors, "vec_id", "v", 5).withColumn("distance", r6("distance"))


def _asked(spark, sf):
    return V.table(spark, sf, "customer").select(F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("id"))


_ASKED = "(SELECT 's'||c_custkey AS id FROM customer)"


@query("node_features_lookup", f"WITH j AS (SELECT a.id, coalesce(feat, {_ZERO}) AS feat FROM {_ASKED} a LEFT JOIN node USING (id)) SELECT id, unnest(range({DIM}))::INT AS pos, unnest(feat) AS value FROM j", "node")
def _(spark, sf):
    return _exploded(G.node_features(_asked(spark, sf), V.node(spark, sf), DIM))


@query("node_labels_lookup", f"SELECT a.id, coalesce(label,-1) AS label FROM {_ASKED} a LEFT JOIN node USING (id)", "node")
def _(spark, sf):
    return G.node_labels(_asked(spark, sf), V.node(spark, sf))


@query("edge_features_lookup", "SELECT src, dst, coalesce(b, 0.0::DOUBLE) AS value FROM (SELECT DISTINCT src, dst FROM edge) LEFT JOIN (SELECT src, dst, arg_min(bytes, flow_id) AS b FROM edge WHERE t_us >= 1704844800000000 GROUP BY ALL) USING (src, dst)", "edge")
def _(spark, sf):
    e = V.edge(spark, sf)
    late = e.where(F.col("t_us") >= NOW).groupBy("src", "dst").agg(F.min_by(F.array("bytes"), "flow_id").alias("feat"))
    return G.edge_features(e.select("src", "dst").distinct(), late, 1).select("src", "dst", F.get("feat", 0).alias("value"))


@query("adjacency_sets", "SELECT DISTINCT src AS id, 'out' AS direction, dst AS neighbour FROM edge UNION ALL SELECT DISTINCT dst, 'in', src FROM edge", "edge")
def _(spark, sf):
    return G.adjacency(V.edge(spark, sf))


@query("filter_edges_by_nodes", "SELECT * FROM edge WHERE src IN (SELECT id FROM node WHERE label < 5) AND dst IN (SELECT id FROM node WHERE label < 5)", "edge node")
def _(spark, sf):
    return G.with_both_ends(V.edge(spark, sf), V.node(spark, sf).where("label < 5"))


@query("node_time_from_edges", "SELECT id, min(t_us) AS first_us, max(t_us) AS last_us FROM (SELECT src AS id, t_us FROM edge UNION ALL SELECT dst, t_us FROM edge) GROUP BY id", "edge")
def _(spark, sf):
    return G.node_times(V.edge(spark, sf))


@query("graph_density", "SELECT n AS n_nodes, e AS n_edges, round(e/(n*(n-1))::DOUBLE,6)+0.0 AS density FROM (SELECT (SELECT count(*) FROM node) AS n, (SELECT count(*) FROM edge) AS e)", "edge node")
def _(spark, sf):
    return G.density(V.edge(spark, sf)).withColumn("density", r6("density"))


@query("degrees", "SELECT id, count(*) FILTER (d='i') AS in_degree, count(*) FILTER (d='o') AS out_degree, count(*) FILTER (d <> 'z') AS degree FROM (SELECT src AS id, 'o' AS d FROM edge UNION ALL SELECT dst, 'i' FROM edge UNION ALL SELECT 's'||c_custkey, 'z' FROM customer) GROUP BY id", "edge")
def _(spark, sf):
    return G.degrees(V.edge(spark, sf), _asked(spark, sf))
