"""Queries for time encodings and graph-attention scoring, with parameters made by rule."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions import encode as T
from flowhelm.functions.scalar import r6
from flowhelm.operators import attention as A

DIM = V.DIM
HEADS, OUT, TDIM = 2, 2, 4


def grid(rows: int, cols: int, shift: int = 0) -> list[list[float]]:
    return [[((i * 7 + j * 3 + shift) % 11 - 5) / 10.0 for j in range(cols)] for i in range(rows)]


def line(n: int, shift: int = 0) -> list[float]:
    return [((i * 5 + shift) % 7 - 3) / 10.0 for i in range(n)]


W8, B8 = [1.0 / 2**i for i in range(8)], line(8)
FREQS, PHASES = T.fourier_frequencies(3), [0.0] * 3
FALLING = T.fourier_frequencies(3, rising=False)
PERIOD, BINS = 3600.0, 48


def _t(spark, sf):
    day = F.pmod(F.col("t_us"), F.lit(86_400_000_000))
    return V.flow(spark, sf).select("flow_id", (day / F.lit(1e6)).alias("t"))


_T = "(SELECT flow_id, (t_us % 86400000000)/1000000.0::DOUBLE AS t FROM flow)"


def lit(x: float) -> str:
    return f"({float(x)!r}::DOUBLE)"


def _long_sql(elements: list[str], source: str, ident: str = "flow_id") -> str:
    return f"SELECT {ident}, unnest(range({len(elements)}))::INT AS pos, round(unnest([{', '.join(elements)}]),6)+0.0 AS value FROM {source}"


def _long(df, vec: str = "enc", ident: str = "flow_id"):
    return df.select(ident, F.posexplode(vec).alias("pos", "value")).withColumn("value", r6("value"))


def _cos(t: str, w, b) -> list[str]:
    return [f"cos({t}*{lit(x)}+{lit(y)})" for x, y in zip(w, b)]


def _affine(weight, bias, x: str) -> list[str]:
    return ["(" + "+".join(f"{lit(c)}*{x}[{j + 1}]" for j, c in enumerate(row)) + f"+{lit(b)})" for row, b in zip(weight, bias)]


@query("enc_cosine", _long_sql(_cos("t", W8, B8), _T), "flow")
def _(spark, sf):
    return _long(_t(spark, sf).withColumn("enc", T.cosine("t", W8, B8)))


_QW, _QB = grid(4, 8), line(4)
_Q = f"(SELECT flow_id, [{', '.join(f'greatest({c},0)' for c in _cos('q', W8, B8))}] AS z FROM (SELECT flow_id, floor(t/0.1::DOUBLE)*0.1::DOUBLE AS q FROM {_T}))"


@query("enc_quantized", _long_sql(_affine(_QW, _QB, "z"), _Q), "flow")
def _(spark, sf):
    return _long(_t(spark, sf).withColumn("enc", T.quantized("t", W8, B8, _QW, _QB)))


_BIN = f"CAST(least(greatest(floor((t % {lit(PERIOD)})/{lit(PERIOD)}*{BINS}),0),{BINS - 1}) AS INT)"


@query("enc_bucket_index", f"SELECT flow_id, {_BIN} AS bin FROM {_T}", "flow")
def _(spark, sf):
    return _t(spark, sf).select("flow_id", T.bucket_index("t", PERIOD, BINS).alias("bin"))


def _pos_sql(dim: int) -> list[str]:
    turn, out = f"((t % {lit(PERIOD)})/{lit(PERIOD)})", []
    for i in range(dim // 2):
        rate = lit(math.exp(-(i * math.log(10000.0) / (dim // 2))) * 2 * math.pi)
        out += [f"sin({turn}*{rate})", f"cos({turn}*{rate})"]
    return out


@query("enc_learnable", _long_sql([f"(({_BIN}*7+{j}*3) % 11 - 5)/100.0::DOUBLE + {p}*0.1::DOUBLE" for j, p in enumerate(_pos_sql(4))], _T), "flow")
def _(spark, sf):
    table = spark.range(BINS).select(F.col("id").cast("int").alias("bin"), F.array(*[((F.col("id") * 7 + j * 3) % 11 - 5) / F.lit(100.0) for j in range(4)]).alias("emb"))
    return _long(T.learnable(_t(spark, sf), "t", table, PERIOD, BINS, 4))


@query("enc_time2vec", _long_sql([f"t*{lit(W8[0])}+{lit(B8[0])}"] + [f"sin(t*{lit(w)}+{lit(b)})" for w, b in zip(W8[1:6], B8[1:6])], _T), "flow")
def _(spark, sf):
    return _long(_t(spark, sf).withColumn("enc", T.time2vec("t", W8[:6], B8[:6])))


def _fourier_sql(freqs) -> list[str]:
    return [f"{fn}(t*{lit(2 * math.pi * f)}+{lit(p)})" for f, p in zip(freqs, PHASES) for fn in ("sin", "cos")] + [f"t*{lit(1 / 3)}+{lit(0.5)}"]


@query("enc_fourier", _long_sql(_fourier_sql(FREQS), _T), "flow")
def _(spark, sf):
    return _long(_t(spark, sf).withColumn("enc", T.fourier("t", FREQS, PHASES, [(1 / 3, 0.5)])))


@query("enc_fourier_fixed", _long_sql(_fourier_sql(FALLING), _T), "flow")
def _(spark, sf):
    return _long(_t(spark, sf).withColumn("enc", T.fourier("t", FALLING, PHASES, [(1 / 3, 0.5)])))


# --- attention ------------------------------------------------------------------------------

PW, PB = grid(HEADS * OUT, DIM), line(HEADS * OUT)
LAYER = A.Layer(PW, PB, grid(HEADS, OUT, 2), grid(HEADS, OUT, 5), grid(HEADS * OUT, DIM, 4))
LAYERS = [
    A.Layer(grid(HEADS * OUT, width + TDIM, s), line(HEADS * OUT, s), grid(HEADS, OUT, 2 + s), grid(HEADS, OUT, 5 + s), grid(HEADS * OUT, width, 4 + s))
    for s, width in enumerate((DIM, HEADS * OUT))]
TW, TB = W8[:TDIM], B8[:TDIM]


def encode(t):
    return T.cosine(t, TW, TB)


def _nodes(spark, sf):
    return V.node(spark, sf)


def edges_with_time(spark, sf):
    day = F.pmod(F.col("t_us"), F.lit(86_400_000_000))
    return V.edge(spark, sf).select("flow_id", "src", "dst", "t_us", (day / F.lit(1e6)).alias("t"))


_ET = "et AS (SELECT flow_id, src, dst, (t_us % 86400000000)/1000000.0::DOUBLE AS t FROM edge)"
_PROJ = f"pj AS MATERIALIZED (SELECT id, feat, [{', '.join(_affine(PW, PB, 'feat'))}] AS h FROM node)"


def _side(params, h: str, head: int) -> str:
    return "(" + "+".join(f"{lit(c)}*{h}[{head * OUT + j + 1}]" for j, c in enumerate(params[head])) + ")"


def _scores(sparse: bool = False) -> str:
    leaky = "CASE WHEN s >= 0 THEN s ELSE s*0.01::DOUBLE END"
    e = f"CASE WHEN abs({leaky}) > 0.01::DOUBLE THEN {leaky} ELSE 0 END" if sparse else leaky
    parts = " UNION ALL ".join(f"SELECT flow_id, src, dst, {k}::INT AS head, {_side(LAYER.left, 'a.h', k)}+{_side(LAYER.right, 'b.h', k)} AS s FROM edge JOIN pj a ON a.id = src JOIN pj b ON b.id = dst" for k in range(HEADS))
    return f"sc AS (SELECT flow_id, src, dst, head, {e} AS e FROM ({parts}))"


_SOFT = "sm AS (SELECT flow_id, src, dst, head, x/sum(x) OVER (PARTITION BY dst, head) AS a FROM (SELECT *, exp(e - max(e) OVER (PARTITION BY dst, head)) AS x FROM sc))"


def _heads(df, vec: str):
    return df.select("flow_id", F.posexplode(vec).alias("head", "value")).withColumn("value", r6("value"))


def _scored(spark, sf, sparse: bool = False):
    projected = A.project(_nodes(spark, sf), PW, PB).select("id", "h")
    edges = V.edge(spark, sf).select("flow_id", "src", "dst")
    sides = A.plan_sides(edges, projected)
    return A.attention_scores(edges, projected, LAYER, sides, sparse), projected, sides


@query("project_features", f"WITH {_PROJ} SELECT id, unnest(range(4))::INT AS pos, round(unnest(h),6)+0.0 AS value FROM pj", "node")
def _(spark, sf):
    return _long(A.project(_nodes(spark, sf), PW, PB), "h", "id")


@query("aggregate_edge_time", f"""WITH {_ET}, m AS (SELECT dst, {', '.join(f'avg({c}) AS v{i}' for i, c in enumerate(_cos('t', TW, TB)))} FROM et GROUP BY dst)
    SELECT id, unnest(range(4))::INT AS pos, round(unnest([{', '.join(f'coalesce(v{i},0)' for i in range(TDIM))}]),6)+0.0 AS value FROM node LEFT JOIN m ON dst = id""", "edge node")
def _(spark, sf):
    return _long(A.edge_time_mean(edges_with_time(spark, sf), _nodes(spark, sf), encode, TDIM), "time_feat", "id")


@query("attention_scores", f"WITH {_PROJ}, {_scores()} SELECT flow_id, head, round(e,6)+0.0 AS value FROM sc", "edge node")
def _(spark, sf):
    return _heads(_scored(spark, sf)[0], "e")


@query("attention_threshold", f"WITH {_PROJ}, {_scores(True)} SELECT flow_id, head, round(e,6)+0.0 AS value FROM sc", "edge node")
def _(spark, sf):
    return _heads(_scored(spark, sf, True)[0], "e")


@query("edge_softmax", f"WITH {_PROJ}, {_scores()}, {_SOFT} SELECT flow_id, head, round(a,6)+0.0 AS value FROM sm", "edge node")
def _(spark, sf):
    scored, _, sides = _scored(spark, sf)
    return _heads(A.edge_softmax(scored, HEADS, sides), "a")


_AGG_PARTS = " UNION ALL ".join(
    f"SELECT id, {k * OUT + j}::INT AS pos, coalesce((SELECT sum(a*p.h[{k * OUT + j + 1}]) FROM sm JOIN pj p ON p.id = src WHERE sm.dst = n.id AND head = {k}), 0) + {_affine(LAYER.residual, [0.0] * 4, 'feat')[k * OUT + j]} AS r FROM node n"
    for k in range(HEADS) for j in range(OUT))


@query("attention_aggregate", f"WITH {_PROJ}, {_scores()}, {_SOFT} SELECT id, pos, round(CASE WHEN r > 0 THEN r ELSE exp(r)-1 END,6)+0.0 AS value FROM ({_AGG_PARTS})", "edge node")
def _(spark, sf):
    scored, projected, sides = _scored(spark, sf)
    return _long(A.attention_aggregate(scored, projected, _nodes(spark, sf), LAYER, sides), "feat", "id")


@query("mean_message", f"""WITH {_PROJ}, {_ET} SELECT id, unnest(range(8))::INT AS pos, round(unnest(msg),6)+0.0 AS value FROM (SELECT dst AS id, [{', '.join(f'avg(h[{i + 1}])' for i in range(4))}, {', '.join(f'avg({c})' for c in _cos('t', TW, TB))}] AS msg
    FROM et JOIN pj ON pj.id = src GROUP BY dst)""", "edge node")
def _(spark, sf):
    projected = A.project(_nodes(spark, sf), PW, PB).select("id", "h")
    return _long(A.mean_message(edges_with_time(spark, sf), projected, encode, HEADS * OUT, TDIM), "msg", "id")


def layer_sql(layer: A.Layer, edges: str, nodes: str, out: str) -> str:
    """One layer as views: from ``edges`` (b, flow_id, src, dst, t) and ``nodes`` (b, id, feat), graphs of several batches b at once, to ``out``."""
    p, many = out + "_", len(layer.weight)
    head = " UNION ALL ".join(
        f"SELECT e.b, flow_id, src, dst, {k}::INT AS head, {_dots(layer.left[k], 'l.h', k)}+{_dots(layer.right[k], 'r.h', k)} AS s FROM {edges} e JOIN {p}pj l ON l.b = e.b AND l.id = src JOIN {p}pj r ON r.b = e.b AND r.id = dst"
        for k in range(layer.heads))
    sums = ", ".join(f"sum(a*h[{i + 1}]) FILTER (head = {i // layer.out}) AS r{i}" for i in range(many))
    residual = _affine(layer.residual, [0.0] * many, "feat")
    elu = ", ".join(f"CASE WHEN coalesce(r{i},0)+{x} > 0 THEN coalesce(r{i},0)+{x} ELSE exp(coalesce(r{i},0)+{x})-1 END" for i, x in enumerate(residual))
    return f"""{p}tm AS (SELECT b, dst AS id, {', '.join(f'avg({c}) AS v{i}' for i, c in enumerate(_cos('t', TW, TB)))} FROM {edges} GROUP BY b, dst),
    {p}x AS (SELECT n.b, n.id, feat, list_concat(feat, [{', '.join(f'coalesce(v{i},0)' for i in range(TDIM))}]) AS x FROM {nodes} n LEFT JOIN {p}tm t ON t.b = n.b AND t.id = n.id),
    {p}pj AS MATERIALIZED (SELECT b, id, feat, [{', '.join(_affine(layer.weight, layer.bias, 'x'))}] AS h FROM {p}x),
    {p}sc AS (SELECT b, flow_id, src, dst, head, CASE WHEN s >= 0 THEN s ELSE s*0.01::DOUBLE END AS e FROM ({head})),
    {p}sm AS (SELECT b, src, dst, head, x/sum(x) OVER (PARTITION BY b, dst, head) AS a FROM (SELECT *, exp(e - max(e) OVER (PARTITION BY b, dst, head)) AS x FROM {p}sc)),
    {p}ag AS (SELECT m.b, dst AS id, {sums} FROM {p}sm m JOIN {p}pj q ON q.b = m.b AND q.id = src GROUP BY m.b, dst),
    {out} AS MATERIALIZED (SELECT q.b, q.id, [{elu}] AS feat FROM {p}pj q LEFT JOIN {p}ag g ON g.b = q.b AND g.id = q.id)"""


def _dots(params, h: str, head: int) -> str:
    return "(" + "+".join(f"{lit(c)}*{h}[{head * len(params) + j + 1}]" for j, c in enumerate(params)) + ")"


_GRAPH = f"{_ET}, ed AS (SELECT 0 AS b, * FROM et), nd AS (SELECT 0 AS b, id, feat FROM node)"
_FEATS = "SELECT id, unnest(range(4))::INT AS pos, round(unnest(feat),6)+0.0 AS value FROM {}"


@query("tgat_encode", f"WITH {_GRAPH}, {layer_sql(LAYERS[0], 'ed', 'nd', 'l0')}, {layer_sql(LAYERS[1], 'ed', 'l0', 'l1')} {_FEATS.format('l1')}", "edge node")
def tgat_encode(spark, sf):
    """Two attention layers over all nodes and edges (tests compare with a numpy forward pass)."""
    return _long(A.tgat_encode(edges_with_time(spark, sf), _nodes(spark, sf), LAYERS, encode, TDIM), "feat", "id")


@query("tgat_layer", f"WITH {_GRAPH}, {layer_sql(LAYERS[0], 'ed', 'nd', 'l0')} {_FEATS.format('l0')}", "edge node")
def _(spark, sf):
    return _long(A.tgat_layer(edges_with_time(spark, sf), _nodes(spark, sf), LAYERS[0], encode, TDIM), "feat", "id")


C1, D1, C2, D2 = grid(6, DIM, 1), line(6), grid(3, 6, 3), line(3, 2)
_HID = f"hid AS (SELECT id, [{', '.join(f'greatest({x},0)' for x in _affine(C1, D1, 'feat'))}] AS z FROM node), lg AS (SELECT id, [{', '.join(_affine(C2, D2, 'z'))}] AS l FROM hid)"
_PROBS = f"""{_HID}, pr AS (SELECT id, [x/list_sum(ex) FOR x IN ex] AS probs FROM (SELECT id, [exp(x - list_max(l)) FOR x IN l] AS ex FROM lg))"""


def _classified(spark, sf):
    return A.classify(_nodes(spark, sf).select("id", "feat"), C1, D1, C2, D2)


@query("classify", f"WITH {_PROBS} SELECT id, pred, unnest(range(3))::INT AS pos, round(unnest(probs),6)+0.0 AS value FROM (SELECT *, CAST(list_position(probs, list_max(probs)) AS INT)-1 AS pred FROM pr)", "node")
def _(spark, sf):
    c = _classified(spark, sf)
    return c.select("id", "pred", F.posexplode("probs").alias("pos", "value")).withColumn("value", r6("value"))


@query("attack_probability", f"WITH {_PROBS} SELECT id, round(1-probs[1],6)+0.0 AS attack_prob, 1-probs[1] > 0.7 AS attack FROM pr", "node")
def _(spark, sf):
    p = A.attack_probability()
    return _classified(spark, sf).select("id", r6(p).alias("attack_prob"), (p > 0.7).alias("attack"))


@query("batch_alerts", "SELECT t_us // 3600000000 AS batch, max(bytes)/100 AS score, bool_or(bytes/100 > 0.9) AS alert FROM flow GROUP BY 1", "flow")
def _(spark, sf):
    f = V.flow(spark, sf).select(F.floor(F.col("t_us") / 3_600_000_000).alias("batch"), (F.col("bytes") / 100).alias("p"))
    return A.batch_alerts(f, "batch", "p", 0.9)


@query("alert_marking", """SELECT flow_id, bytes/100 AS score, bytes/100 > 0.9 AS alert, y = 1 AS attack,
    CASE WHEN bytes/100 > 0.9 AND y = 1 THEN 'hit' WHEN bytes/100 > 0.9 THEN 'false_alarm' WHEN y = 1 THEN 'missed' ELSE 'quiet' END AS kind FROM flow""", "flow")
def _(spark, sf):
    f = V.flow(spark, sf)
    return A.alert_marking(f.select("flow_id", (F.col("bytes") / 100).alias("score")), f.where("y = 1").select("flow_id"), "flow_id", "score", 0.9)


@query("embedding_projection_2d")
def _(spark, sf):
    """Two principal components per vector (signs are arbitrary, so no SQL twin)."""
    return A.embedding_projection_2d(V.emb(spark, sf), "vec_id", "v")


@query("graph_snapshots", """WITH w AS (SELECT t_us//86400000000 AS "window", src, dst FROM edge), s AS (SELECT DISTINCT "window", id FROM (SELECT "window", src AS id FROM w UNION ALL SELECT "window", dst FROM w))
    SELECT "window", label, count(*) AS n_label_nodes, CAST(sum(count(*)) OVER (PARTITION BY "window") AS BIGINT) AS n_nodes, (SELECT count(*) FROM w WHERE w."window" = s."window") AS n_edges FROM s JOIN node USING (id) GROUP BY "window", label""", "edge node")
def _(spark, sf):
    return A.graph_snapshots(V.edge(spark, sf), _nodes(spark, sf), 86_400_000_000)
