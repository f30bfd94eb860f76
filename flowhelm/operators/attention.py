"""Graph-attention forward pass over node and edge tables.

Reductions per destination are aggregates with map-side partial sums (never a window over a hub), and
node values reach the edges by joins that broadcast small node tables or split hub keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.functions.scalar import affine, let, weighted
from flowhelm.plans.lookup import is_small, lookup_join
from flowhelm.plans.skew import hot_keys
from flowhelm.session import cut_lineage

SLOPE = 0.01
SPAN = 32.0  # scores that share a span are summed as they are
SPARSE_LIMIT = 0.01
WIDE = 1024


@dataclass(frozen=True)
class Layer:
    """Weights of one attention layer; ``weight`` has heads * out rows of in + time columns."""

    weight: Sequence[Sequence[float]]
    bias: Sequence[float]
    left: Sequence[Sequence[float]]
    right: Sequence[Sequence[float]]
    residual: Sequence[Sequence[float]] | None = None

    @property
    def heads(self) -> int:
        return len(self.left)

    @property
    def out(self) -> int:
        return len(self.left[0])


def project(nodes: DataFrame, weight: Sequence[Sequence[float]], bias: Sequence[float], vec: str = "feat", out: str = "h") -> DataFrame:
    """``W x + b`` per node, null for a missing vector; wide layers multiply Arrow batches with numpy instead of array
    functions."""
    if len(weight) * len(weight[0]) <= WIDE:
        return nodes.withColumn(out, affine(weight, bias, vec))
    w, b = np.asarray(weight, dtype=float).T, np.asarray(bias, dtype=float)

    @F.pandas_udf("array<double>")
    def multiply(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        there = x.dropna()
        if len(there):
            out[there.index] = pd.Series(list(np.stack([np.asarray(v, dtype=float) for v in there]) @ w + b), index=there.index)
        return out

    return nodes.withColumn(out, multiply(vec))


def _mean_vector(grouped, vec: str, dim: int, out: str) -> DataFrame:
    return grouped.agg(F.array(*[F.avg(F.get(vec, i)) for i in range(dim)]).alias(out))


def edge_time_mean(edges: DataFrame, nodes: DataFrame, encode: Callable[[Column], Column], dim: int, t: str = "t") -> DataFrame:
    """(id, time_feat): mean encoding of the incoming edges, zeros without any."""
    enc = edges.select(F.col("dst").alias("id"), encode(F.col(t)).alias("_e"))
    mean = _mean_vector(enc.groupBy("id"), "_e", dim, "time_feat")
    return nodes.select("id").join(mean, "id", "left").withColumn("time_feat", F.coalesce("time_feat", F.array_repeat(F.lit(0.0), dim)))


@dataclass(frozen=True)
class Sides:
    """How node values reach the edges: broadcast, or joined with the hubs of either side split."""

    small: bool
    hot_src: list | None = None
    hot_dst: list | None = None


def plan_sides(edges: DataFrame, nodes: DataFrame) -> Sides:
    if is_small(nodes.select("id")):
        return Sides(True)
    return Sides(False, hot_keys(edges, ["src"]), hot_keys(edges, ["dst"]))


def _to_src(edges: DataFrame, values: DataFrame, sides: Sides, spread_on: str) -> DataFrame:
    return lookup_join(edges, values, ["src"], spread_on, "inner", sides.small, sides.hot_src)


def _to_dst(edges: DataFrame, values: DataFrame, sides: Sides, spread_on: str) -> DataFrame:
    return lookup_join(edges, values, ["dst"], spread_on, "inner", sides.small, sides.hot_dst)


def attention_scores(edges: DataFrame, projected: DataFrame, layer: Layer, sides: Sides, sparse: bool = False, spread_on: str = "flow_id") -> DataFrame:
    """Leaky-ReLU score per edge: column ``e`` with one element per head.

    The dot products are taken per node; only heads numbers travel to the edges.
    """
    def side(params: Sequence[Sequence[float]]) -> Column:
        return F.array(*[weighted(params[k], "h", k * layer.out) for k in range(layer.heads)])

    l = projected.select(F.col("id").alias("src"), side(layer.left).alias("_el"))
    r = projected.select(F.col("id").alias("dst"), side(layer.right).alias("_er"))
    joined = _to_dst(_to_src(edges, l, sides, spread_on), r, sides, spread_on)

    def score(k: int) -> Column:
        s = F.get("_el", k) + F.get("_er", k)
        s = F.when(s >= 0, s).otherwise(s * SLOPE)
        return F.when(F.abs(s) > SPARSE_LIMIT, s).otherwise(F.lit(0.0)) if sparse else s

    return joined.withColumn("e", F.array(*[score(k) for k in range(layer.heads)])).drop("_el", "_er")


def _spans(heads: int) -> Column:
    """Per head the span of scores an edge's score lies in; exp of a score less its span's start is neither huge nor zero."""
    return F.array(*[F.floor(F.get("e", k) / SPAN).cast("int") for k in range(heads)])


def _power(k: int) -> Column:
    return F.exp(F.get("e", k) - F.get("_span", k) * SPAN)


def _rescaled(grouped: DataFrame, heads: int, sums: dict[str, int]) -> DataFrame:
    """Sums per destination and spans added up per destination: each is scaled down to the highest span of its head. A destination has as many rows
    as its scores have spans, mostly one. ``sums`` names array columns and says how many elements each head has there."""
    parts = grouped.groupBy("dst").agg(F.collect_list(F.struct("_span", *sums)).alias("_p"))
    top = F.array(*[F.array_max(F.transform("_p", lambda p, k=k: F.get(p["_span"], k))) for k in range(heads)])
    parts = parts.withColumn("_top", top)

    def total(name: str, width: int) -> Column:
        def element(i: int) -> Column:
            k = i // width
            return F.aggregate("_p", F.lit(0.0), lambda t, p: t + F.coalesce(F.get(p[name], i) * F.exp((F.get(p["_span"], k) - F.get("_top", k)) * SPAN), F.lit(0.0)))

        return F.array(*[element(i) for i in range(heads * width)]).alias(name)

    return parts.select("dst", "_top", *[total(n, w) for n, w in sums.items()])


def edge_softmax(scored: DataFrame, heads: int, sides: Sides, spread_on: str = "flow_id") -> DataFrame:
    """Softmax of ``e`` over the incoming edges of each destination: column ``a`` per head. Denominators come from one aggregate in
    spans of scores, so no pass for the maxima comes before it; one table of destinations goes back to the edges."""
    spanned = scored.withColumn("_span", _spans(heads))
    sums = spanned.groupBy("dst", "_span").agg(F.array(*[F.sum(_power(k)) for k in range(heads)]).alias("_s"))
    below = _rescaled(sums, heads, {"_s": 1})
    share = F.array(*[F.try_divide(F.exp(F.get("e", k) - F.get("_top", k) * SPAN), F.get("_s", k)) for k in range(heads)])
    return _to_dst(scored, below, sides, spread_on).withColumn("a", share).drop("_top", "_s")


def elu(x: Column) -> Column:
    return F.when(x > 0, x).otherwise(F.exp(x) - 1.0)


def attention_aggregate(scored: DataFrame, projected: DataFrame, nodes: DataFrame, layer: Layer, sides: Sides, vec: str = "feat", spread_on: str = "flow_id") -> DataFrame:
    """(id, feat): softmax-weighted sum of source vectors, residual, ELU, heads concatenated.

    Numerators and the softmax denominator are summed in one aggregate, in spans of scores; nothing is joined back.
    """
    heads, out = layer.heads, layer.out
    msgs = _to_src(scored.select("src", "dst", "e", spread_on), projected.select(F.col("id").alias("src"), "h"), sides, spread_on).withColumn("_span", _spans(heads))
    weighted_sums = F.array(*[F.sum(_power(k) * F.get("h", k * out + j)) for k in range(heads) for j in range(out)])
    summed = msgs.groupBy("dst", "_span").agg(F.array(*[F.sum(_power(k)) for k in range(heads)]).alias("_s"), weighted_sums.alias("_w"))
    share = F.array(*[F.try_divide(F.get("_w", k * out + j), F.get("_s", k)) for k in range(heads) for j in range(out)])
    got = _rescaled(summed, heads, {"_s": 1, "_w": out}).select(F.col("dst").alias("id"), share.alias("_r"))
    all_nodes = nodes.select("id", F.col(vec).alias("_in")).join(got, "id", "left")
    rst = F.coalesce("_r", F.array_repeat(F.lit(0.0), heads * out))
    if layer.residual is not None:
        res = affine(layer.residual, [0.0] * len(layer.residual), "_in")
        rst = F.zip_with(rst, res, lambda a, b: a + b)
    return all_nodes.select("id", F.transform(rst, elu).alias(vec))


def mean_message(edges: DataFrame, projected: DataFrame, encode: Callable[[Column], Column], width: int, time_dim: int, spread_on: str = "flow_id", t: str = "t") -> DataFrame:
    """Mean of [source vector, time encoding] over incoming edges: (id, msg)."""
    j = lookup_join(edges, projected.select(F.col("id").alias("src"), "h"), ["src"], spread_on, "inner")
    both = j.select(F.col("dst").alias("id"), F.concat("h", encode(F.col(t))).alias("_m"))
    return _mean_vector(both.groupBy("id"), "_m", width + time_dim, "msg")


def tgat_layer(edges: DataFrame, nodes: DataFrame, layer: Layer, encode: Callable[[Column], Column], time_dim: int, sparse: bool = False, sides: Sides | None = None) -> DataFrame:
    """One layer: node vectors joined with incoming-edge time, attention, aggregation."""
    sides = sides or plan_sides(edges, nodes)
    timed = nodes.join(edge_time_mean(edges, nodes, encode, time_dim), "id").select("id", "feat", F.concat("feat", "time_feat").alias("_x"))
    projected = project(timed, layer.weight, layer.bias, "_x").select("id", "h")
    scored = attention_scores(edges.select("src", "dst", "flow_id"), projected, layer, sides, sparse)
    return attention_aggregate(scored, projected, nodes, layer, sides)


def tgat_encode(edges: DataFrame, nodes: DataFrame, layers: Sequence[Layer], encode: Callable[[Column], Column], time_dim: int) -> DataFrame:
    """Node embeddings after all layers; each layer's table is checkpointed before the next reads it twice."""
    current = nodes.select("id", "feat")
    sides = plan_sides(edges, current)
    for i, layer in enumerate(layers):
        current = tgat_layer(edges, current, layer, encode, time_dim, sides=sides)
        if i < len(layers) - 1:
            current = cut_lineage(current)
    return current


def softmax(x: Column) -> Column:
    def shares(ex: Column) -> Column:
        return let(F.aggregate(ex, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(ex, lambda v: v / total))

    return let(x, lambda l: let(let(F.array_max(l), lambda top: F.transform(l, lambda v: F.exp(v - top))), shares))


def classify(df: DataFrame, w1, b1, w2, b2, vec: str = "feat") -> DataFrame:
    """linear, ReLU, linear, softmax: columns ``probs`` and ``pred``."""
    hidden = F.transform(affine(w1, b1, vec), lambda x: F.greatest(x, F.lit(0.0)))
    probs = df.withColumn("probs", softmax(affine(w2, b2, hidden)))
    return probs.withColumn("pred", let(F.col("probs"), lambda p: F.array_position(p, F.array_max(p))).cast("int") - 1)


def attack_probability(probs: str | Column = "probs") -> Column:
    """1 - p[0]; a single column is the probability itself."""
    return let(F.col(probs) if isinstance(probs, str) else probs, lambda p: F.when(F.size(p) == 1, F.get(p, 0)).otherwise(1.0 - F.get(p, 0)))


def batch_alerts(df: DataFrame, batch: str, score: str, threshold: float) -> DataFrame:
    return df.groupBy(batch).agg(F.max(score).alias("score"), F.bool_or(F.col(score) > threshold).alias("alert"))


def alert_marking(scores: DataFrame, known: DataFrame, ident: str, score: str, threshold: float) -> DataFrame:
    """Score series with alert flag, known-attack flag and their agreement."""
    marked = scores.join(known.select(ident, F.lit(True).alias("_k")), ident, "left")
    alert, attack = F.col(score) > threshold, F.coalesce("_k", F.lit(False))
    kind = F.when(alert & attack, "hit").when(alert, "false_alarm").when(attack, "missed").otherwise("quiet")
    return marked.select(ident, score, alert.alias("alert"), attack.alias("attack"), kind.alias("kind"))


def embedding_projection_2d(df: DataFrame, ident: str, vec: str) -> DataFrame:
    """First two principal components per vector."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(ident, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("_p", vector_to_array("_p"))
    return out.select(ident, F.get("_p", 0).alias("x"), F.get("_p", 1).alias("y"))


def graph_snapshots(edges: DataFrame, nodes: DataFrame, size_us: int) -> DataFrame:
    """Per time window: edges, nodes and nodes of each label. (window, node) pairs are made distinct
    first, which spreads a crowded window."""
    window = F.floor(F.col("t_us") / size_us).alias("window")
    n_edges = edges.groupBy(window).agg(F.count(F.lit(1)).alias("n_edges"))
    seen = edges.select(window, F.explode(F.array("src", "dst")).alias("id")).distinct()
    labelled = lookup_join(seen, nodes.select("id", "label"), ["id"], "window")
    mix = labelled.groupBy("window", F.coalesce("label", F.lit(-1)).alias("label")).agg(F.count(F.lit(1)).alias("n_label_nodes"))
    total = Window.partitionBy("window")  # one row per label by now
    return mix.withColumn("n_nodes", F.sum("n_label_nodes").over(total)).join(n_edges, "window")
