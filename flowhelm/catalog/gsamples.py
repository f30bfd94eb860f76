"""Queries for graph sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions.scalar import r6
from flowhelm.operators import gsample as S
from flowhelm.operators.graph import degrees

START, END = 1704844800000000, 1704844800000000 + 43_200_000_000
NOW = 1706700000000000


def _e(spark, sf):
    return V.edge(spark, sf)


def _memory(spark, sf):
    """Destination nodes as sampling memory: importance by degree, last time as access time."""
    e = _e(spark, sf)
    return e.groupBy(F.col("dst").alias("id")).agg((F.count(F.lit(1)) / 1000.0).alias("importance"), F.max("t_us").alias("last_access"), F.count(F.lit(1)).alias("access_count"))


_MEM = "mem AS MATERIALIZED (SELECT dst AS id, count(*)/1000.0::DOUBLE AS importance, max(t_us) AS last_access, count(*) AS access_count FROM edge GROUP BY dst)"


def _u(ident: str, seed: str) -> str:
    return f"((CAST('0x'||substr(md5(concat({ident},'|{seed}')),1,8) AS BIGINT)+1)/4294967297.0::DOUBLE)"


def _imp(name: str, where: str = "true") -> str:
    return f"{name} AS MATERIALIZED (SELECT id, count(*) AS degree, count(*)/sum(count(*)) OVER ()::DOUBLE AS importance FROM (SELECT src AS id FROM edge WHERE {where} UNION ALL SELECT dst FROM edge WHERE {where}) GROUP BY id)"


def _pick(name: str, source: str, size: int, seed: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT id FROM {source} ORDER BY ln({_u('id', seed)})/importance DESC, md5(concat(id,'|{seed}')) LIMIT {size})"


def _walk(starts: str, length: int, seed: str) -> str:
    return f"""adj AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos, count(*) OVER (PARTITION BY src) AS deg FROM (SELECT DISTINCT src, dst FROM edge)),
    wk AS (SELECT id AS walk, 0 AS step, id FROM {starts} UNION ALL SELECT walk, CAST(step+1 AS INT), dst FROM wk JOIN adj ON src = wk.id
      AND pos = CAST('0x'||substr(md5(concat(walk,'|{seed}|',step+1)),1,8) AS BIGINT) % deg + 1 WHERE step < {length})"""


_IND = "SELECT * FROM edge WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids)"


@query("edge_time_filter", f"SELECT * FROM edge WHERE t_us BETWEEN {START} AND {END}", "edge")
def _(spark, sf):
    from flowhelm.operators.edges import in_window

    return in_window(_e(spark, sf), START, END)


@query("node_importance", f"WITH {_imp('imp')} SELECT id, degree, round(importance,6)+0.0 AS importance FROM imp", "edge")
def _(spark, sf):
    return S.node_importance(_e(spark, sf)).withColumn("importance", r6("importance"))


@query("sample_nodes_weighted", f"WITH {_imp('imp')}, {_pick('p', 'imp', 60, 'w1')} SELECT id FROM p", "edge")
def _(spark, sf):
    return S.sample_nodes_weighted(S.node_importance(_e(spark, sf)), 60, seed="w1").select("id")


def _starts(spark, sf):
    return V.node(spark, sf).select("id")


@query("random_walks", f"WITH RECURSIVE {_walk('(SELECT id FROM node)', 4, 'rw')} SELECT walk, step, id FROM wk", "edge node")
def _(spark, sf):
    return S.random_walks(_e(spark, sf), _starts(spark, sf), 4, "rw")


@query("graphsaint", f"""WITH RECURSIVE {_imp('imp')}, {_pick('p', 'imp', 40, 'gs')}, st AS (SELECT id FROM p ORDER BY md5(concat(id,'|gsw')) LIMIT 10), {_walk('st', 4, 'gs')}, {_MEM},
    ids AS (SELECT id FROM p UNION SELECT id FROM wk UNION SELECT id FROM mem WHERE importance >= (SELECT quantile_cont(importance, 0.75) FROM mem)) {_IND}""", "edge")
def _(spark, sf):
    return S.graphsaint(_e(spark, sf), 40, 10, 4, _memory(spark, sf), "gs").select("flow_id", "src", "dst", "t_us", "bytes")


@query("induced_subgraph", "WITH ids AS (SELECT id FROM node WHERE label < 3 OR id LIKE 'd%') " + _IND, "edge node")
def _(spark, sf):
    ids = V.node(spark, sf).where("label < 3 or id like 'd%'")
    return S.induced_subgraph(_e(spark, sf), ids).select("flow_id", "src", "dst", "t_us", "bytes")


@query("cluster_nodes_spectral")
def _(spark, sf):
    return S.cluster_nodes_spectral(_e(spark, sf), 5)


@query("cluster_nodes_kmeans")
def _(spark, sf):
    return S.cluster_nodes_kmeans(V.node(spark, sf), k=8)


@query("cluster_nodes_degree")
def _(spark, sf):
    d = degrees(_e(spark, sf)).select("id", F.array(F.col("degree").cast("double")).alias("feat"))
    return S.cluster_nodes_kmeans(d, k=5)


@query("cluster_gcn")
def _(spark, sf):
    clusters = S.cluster_nodes_kmeans(V.node(spark, sf), k=8)
    return S.cluster_gcn(_e(spark, sf), clusters, 100, _memory(spark, sf), seed="cg")


_SIZE, _SEEDS, _MSEEDS = 120, 10, 3


def _frontier_sql() -> str:
    parts = [_imp("imp"), _pick("sd", "imp", _SEEDS, "fr"), _MEM,
             "nb AS MATERIALIZED (SELECT src AS id, dst AS nbr FROM (SELECT DISTINCT src, dst FROM edge) UNION ALL SELECT dst, src FROM (SELECT DISTINCT src, dst FROM edge))",
             f"ms AS MATERIALIZED (SELECT id FROM mem WHERE importance >= (SELECT quantile_cont(importance,0.9) FROM mem) AND id IN (SELECT id FROM nb) ORDER BY md5(concat(id,'|frm')) LIMIT {_MSEEDS})",
             "f0 AS MATERIALIZED (SELECT id FROM sd UNION SELECT id FROM ms)", "v0 AS MATERIALIZED (SELECT * FROM f0)"]
    for k in range(3):
        go = f"(SELECT count(*) FROM v{k}) < {_SIZE}" if k else "true"
        parts += [
            f"a{k} AS MATERIALIZED (SELECT nb.id, nbr, nbr IN (SELECT id FROM v{k}) AS seen, count(*) OVER (PARTITION BY nb.id) AS deg FROM nb JOIN f{k} USING (id) WHERE {go})",
            f"u{k} AS (SELECT id, nbr, deg, row_number() OVER (PARTITION BY id ORDER BY md5(concat(id,'|',nbr,'|fr|{k}'))) AS rk FROM (SELECT *, bool_and(seen) OVER (PARTITION BY id) AS all_seen FROM a{k}) WHERE NOT seen OR all_seen)",
            f"f{k + 1} AS MATERIALIZED (SELECT DISTINCT nbr AS id FROM u{k} WHERE rk <= greatest(1, floor(deg*{0.5 ** (k + 1)!r}::DOUBLE)))",
            f"v{k + 1} AS MATERIALIZED (SELECT id FROM v{k} UNION SELECT id FROM f{k + 1})"]
    return "WITH " + ", ".join(parts) + f" SELECT id FROM v3 ORDER BY md5(concat(id,'|frc')) LIMIT {_SIZE}"


@query("frontier", _frontier_sql(), "edge")
def _(spark, sf):
    return S.frontier_nodes(_e(spark, sf), _SIZE, _SEEDS, _memory(spark, sf), _MSEEDS, seed="fr")


_B = START - (END - START)


@query("historical", f"""WITH {_imp('i1', f't_us BETWEEN {START} AND {END}')}, {_imp('i2', f't_us BETWEEN {_B} AND {START}')}, {_pick('p1', 'i1', 70, 'hi')}, {_pick('p2', 'i2', 30, 'hih')},
    ids AS (SELECT id FROM p1 UNION SELECT id FROM p2) {_IND} AND t_us BETWEEN {_B} AND {END}""", "edge")
def _(spark, sf):
    return S.historical(_e(spark, sf), (START, END), 100, seed="hi").select("flow_id", "src", "dst", "t_us", "bytes")


@query("memory_update", f"""WITH {_imp('imp')}, {_MEM}, nw AS (SELECT id, importance FROM imp WHERE degree >= 60)
    SELECT id, round(importance,6)+0.0 AS importance, last_access, access_count FROM (SELECT coalesce(m.id, n.id) AS id, coalesce(n.importance, m.importance) AS importance,
    CASE WHEN n.id IS NOT NULL THEN greatest(coalesce(m.last_access,0), {NOW}) ELSE m.last_access END AS last_access, coalesce(m.access_count,0) + CASE WHEN n.id IS NOT NULL THEN 1 ELSE 0 END AS access_count
    FROM mem m FULL JOIN nw n ON m.id = n.id) ORDER BY last_access DESC, id LIMIT 150""", "edge")
def _(spark, sf):
    new = S.node_importance(_e(spark, sf)).where("degree >= 60")
    return S.memory_update(_memory(spark, sf), new, NOW, 150).withColumn("importance", r6("importance"))


@query("memory_percentile", f"WITH {_MEM} SELECT id, importance FROM mem WHERE importance >= (SELECT quantile_cont(importance, 0.8) FROM mem)", "edge")
def _(spark, sf):
    return S.memory_percentile(_memory(spark, sf), 80).select("id", "importance")


@query("memory_hit_stats", f"WITH {_imp('imp')}, {_MEM}, {_pick('p', 'imp', 60, 'w1')} SELECT count(*) FILTER (id IN (SELECT id FROM mem)) AS hits, count(*) FILTER (id NOT IN (SELECT id FROM mem)) AS misses FROM p", "edge")
def _(spark, sf):
    return S.memory_hit_stats(_memory(spark, sf), S.sample_nodes_weighted(S.node_importance(_e(spark, sf)), 60, seed="w1"))


@query("recent_edge_nodes", """WITH nw AS (SELECT * FROM edge ORDER BY t_us DESC, flow_id DESC LIMIT 200)
    SELECT id, max(t_us) AS last_us FROM (SELECT src AS id, t_us FROM nw UNION ALL SELECT dst, t_us FROM nw) GROUP BY id ORDER BY last_us DESC, id LIMIT 40""", "edge")
def _(spark, sf):
    return S.recent_edge_nodes(_e(spark, sf), 40)


@query("bfs_sample", """WITH RECURSIVE nb AS MATERIALIZED (SELECT DISTINCT src AS id, dst AS nbr FROM edge UNION SELECT DISTINCT dst, src FROM edge),
    sd AS (SELECT 's'||min(c_custkey) AS id FROM customer), bf AS (SELECT id, 0 AS level FROM sd UNION SELECT nbr, level+1 FROM bf JOIN nb USING (id) WHERE level < 4),
    lv AS (SELECT id, min(level) AS level FROM bf GROUP BY id) SELECT id, level FROM lv ORDER BY level, md5(concat(id,'|bfs')) LIMIT 120""", "edge")
def _(spark, sf):
    seeds = V.table(spark, sf, "customer").agg(F.concat(F.lit("s"), F.min("c_custkey").cast("string")).alias("id"))
    return S.bfs_sample(_e(spark, sf), seeds, 120, "bfs")


def _fan(k: int, front: str, layer: int) -> str:
    rank = f"row_number() OVER (PARTITION BY dst ORDER BY md5(concat(flow_id,'|nf|{layer}')), flow_id)"
    return f"SELECT {layer}::INT AS layer, src, dst, flow_id FROM (SELECT *, {rank} AS rk FROM both_edges WHERE dst IN ({front})) WHERE rk <= {k}"


@query("neighbor_fanout", f"""WITH both_edges AS (SELECT src, dst, flow_id FROM edge UNION ALL SELECT dst, src, flow_id + 1000000000 FROM edge), l0 AS MATERIALIZED ({_fan(5, 'SELECT id FROM node', 0)}),
    l1 AS ({_fan(3, 'SELECT src FROM l0', 1)}) SELECT * FROM l0 UNION ALL SELECT * FROM l1""", "edge node")
def _(spark, sf):
    e = _e(spark, sf).select("src", "dst", "flow_id")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("flow_id") + 1_000_000_000).alias("flow_id")))
    return S.neighbor_fanout(both, _starts(spark, sf), [5, 3], "nf")


@query("seed_batches", "SELECT id, (row_number() OVER (ORDER BY md5(concat(id,'|sb'))) - 1) // 32 AS batch FROM node", "node edge")
def _(spark, sf):
    return S.seed_batches(V.node(spark, sf), 32, "sb")


_ROUNDS, _MEMORY = 3, 60


def _round_sql(r: int) -> str:
    """Views of one call on a third of the time range: importance, picked nodes, walks, important memory nodes, ids, and the next memory."""
    here, seed = f"t_us >= lo + {r}*step AND t_us < lo + {r + 1}*step", f"ls{r}"
    return f"""ed{r} AS MATERIALIZED (SELECT edge.* FROM edge, thirds WHERE {here}),
    im{r} AS MATERIALIZED (SELECT id, count(*)/sum(count(*)) OVER ()::DOUBLE AS importance FROM (SELECT src AS id FROM ed{r} UNION ALL SELECT dst FROM ed{r}) GROUP BY id),
    {_pick(f'p{r}', f'im{r}', 30, seed)}, st{r} AS MATERIALIZED (SELECT id FROM p{r} ORDER BY md5(concat(id,'|{seed}w')) LIMIT 5),
    ad{r} AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos, count(*) OVER (PARTITION BY src) AS deg FROM (SELECT DISTINCT src, dst FROM ed{r})),
    wk{r} AS (SELECT id AS walk, 0 AS step, id FROM st{r} UNION ALL SELECT walk, CAST(wk{r}.step+1 AS INT), dst FROM wk{r} JOIN ad{r} ON src = wk{r}.id
      AND pos = CAST('0x'||substr(md5(concat(walk,'|{seed}|',wk{r}.step+1)),1,8) AS BIGINT) % deg + 1 WHERE wk{r}.step < 3),
    id{r} AS MATERIALIZED (SELECT id FROM p{r} UNION SELECT id FROM wk{r} UNION SELECT id FROM mm{r} WHERE importance >= (SELECT quantile_cont(importance, 0.75) FROM mm{r})),
    nx{r} AS MATERIALIZED (SELECT id, coalesce(n.imp, m.importance) AS importance, CASE WHEN n.imp IS NOT NULL THEN {r} ELSE m.last_access END AS last_access
      FROM mm{r} m FULL JOIN (SELECT id, coalesce(importance, 0) AS imp FROM id{r} LEFT JOIN im{r} USING (id)) n USING (id)),
    mm{r + 1} AS MATERIALIZED (SELECT * FROM nx{r} ORDER BY last_access DESC, id LIMIT {_MEMORY})"""


_LIVING = f"""WITH RECURSIVE thirds AS (SELECT min(t_us) AS lo, (max(t_us)-min(t_us))//{_ROUNDS} + 1 AS step FROM edge),
    mm0 AS (SELECT '' AS id, 0.0::DOUBLE AS importance, 0 AS last_access FROM edge LIMIT 0), {', '.join(_round_sql(r) for r in range(_ROUNDS))} """ + " UNION ALL ".join(
    f"""SELECT {r} AS round, id, id IN (SELECT id FROM mm{r}) AS hit, round(coalesce(feat[1], 0),6)+0.0 AS first_feature, (SELECT count(*) FROM ed{r} WHERE src IN (SELECT id FROM id{r}) AND dst IN (SELECT id FROM id{r})) AS n_edges,
    (SELECT count(*) FROM nx{r}) - (SELECT count(*) FROM mm{r + 1}) AS evicted FROM id{r} LEFT JOIN node USING (id)""" for r in range(_ROUNDS))


@query("memory_sampler", _LIVING, "edge node")
def _(spark, sf):
    """Three calls of a sampler on the thirds of the time range; its memory passes from one to the next and forgets."""
    e, nodes = _e(spark, sf), V.node(spark, sf)
    lo, hi = e.agg(F.min("t_us"), F.max("t_us")).first()
    step = (hi - lo) // _ROUNDS + 1
    sampler = S.MemorySampler(nodes, len(nodes.first()["feat"]), _MEMORY)
    out = None
    for r in range(_ROUNDS):
        got = sampler.sample(e, lambda cut, memory, r=r: S.graphsaint_nodes(cut, 30, 5, 3, memory, f"ls{r}"), (lo + r * step, lo + (r + 1) * step - 1))
        rows = got.nodes.select(F.lit(r).alias("round"), "id", "hit", r6(F.get("feat", 0)).alias("first_feature"), F.lit(got.edges.count()).alias("n_edges"), F.lit(got.evicted).cast("long").alias("evicted"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("cluster_gcn_labels", f"""WITH {_MEM}, cn AS (SELECT label FROM node GROUP BY label ORDER BY md5(concat(label,'|cg')) LIMIT 3),
    ch AS (SELECT id FROM node WHERE label IN (SELECT label FROM cn) ORDER BY md5(concat(id,'|cg')) LIMIT 100),
    tp AS (SELECT id FROM mem WHERE importance >= (SELECT quantile_cont(importance, 0.8) FROM mem) ORDER BY md5(concat(id,'|cgm')) LIMIT 10),
    ids AS (SELECT id FROM ch UNION SELECT id FROM tp) {_IND}""", "edge node")
def _(spark, sf):
    """The same sampler on given clusters: the labels of the nodes."""
    clusters = V.node(spark, sf).select("id", F.col("label").alias("cluster"))
    return S.cluster_gcn(_e(spark, sf), clusters, 100, _memory(spark, sf), seed="cg").select("flow_id", "src", "dst", "t_us", "bytes")
