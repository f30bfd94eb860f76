"""Temporal graphs as node and edge tables: building, maintaining, cutting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowhelm.functions.scalar import cosine
from flowhelm.plans.lookup import keep_matching, lookup_join, with_both_ends
from flowhelm.plans.ordered import ROWS_PER_BLOCK, neighbours, number, top_rows
from flowhelm.plans.ranks import mark_quota
from flowhelm.plans.reach import near_in_time
from flowhelm.plans.skew import HOT_ROWS, PIECES

MICROS = 1_000_000
SPAN = 16
ROWS_PER_TASK = 500_000


def temporal_edges(
    flows: DataFrame, src: str, dst: str, t_us: str, ident: str, size: str,
    max_gap_s: float = 0.5, per_pair: int | None = None, max_edges: int | None = None, ends: bool = False, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Links between consecutive flows of a pair that follow within ``max_gap_s``; ``ends`` keeps the pair.

    All flows count; a caller may ask for the first ``per_pair`` flows of each pair alone, which Spark
    limits before the shuffle. The flows of a hot pair are ordered in blocks."""
    wanted = flows.select(*dict.fromkeys([src, dst, t_us, ident, size]))
    nexts = {"_t2": t_us, "_id2": ident, "_s2": size}
    if per_pair is None:
        head = neighbours(wanted, [t_us, ident], following=nexts, keys=[src, dst], rows_per_block=rows_per_block)
    else:
        w = Window.partitionBy(src, dst).orderBy(t_us, ident)
        first = wanted.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_pair)
        head = first.withColumns({k: F.lead(c).over(w) for k, c in nexts.items()})
    gap = (F.col("_t2") - F.col(t_us)) / F.lit(float(MICROS))
    linked = head.where(gap <= max_gap_s)
    ratio = F.when(F.col(size) > 0, F.col("_s2") / F.col(size)).otherwise(F.lit(0.0))
    pair = [F.col(src), F.col(dst)] if ends else []
    edges = linked.select(*pair, F.col(ident).alias("src_flow"), F.col("_id2").alias("dst_flow"), F.col("_t2").alias("t_us"), gap.alias("gap"), ratio.alias("size_ratio"))
    return edges if max_edges is None else top_rows(edges, [F.col("t_us"), F.col("dst_flow")], max_edges)


def pair_groups(flows: DataFrame, src: str, dst: str, t_us: str) -> DataFrame:
    return flows.groupBy(src, dst).agg(F.count(F.lit(1)).alias("n_flows"), F.min(t_us).alias("first_us"), F.max(t_us).alias("last_us"))


def pair_members(flows: DataFrame, src: str, dst: str, t_us: str, ident: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The flow list of each pair as rows with their position, so a hot pair stays many rows."""
    return number(flows.select(src, dst, t_us, ident), [t_us, ident], [src, dst], "position", rows_per_block)


def _last_write(updates: DataFrame, seq: str, newest: bool) -> DataFrame:
    payload = F.struct(*[F.col(c) for c in updates.columns if c != "id"])
    pick = F.max_by if newest else F.min_by
    return updates.groupBy("id").agg(pick(payload, F.col(seq)).alias("w"), F.min(seq).alias("_arrival")).select("id", "_arrival", "w.*")


def upsert_nodes(nodes: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """Last write per id wins; unknown ids get the next internal ids in order of arrival."""
    fields = [c for c in nodes.columns if c not in ("id", "internal_id")]
    newest = _last_write(updates, seq, True).withColumnRenamed("_arrival", "_arrival_u")
    top = nodes.agg(F.coalesce(F.max("internal_id"), F.lit(-1))).first()[0]
    fresh = number(newest.join(nodes.select("id"), "id", "left_anti"), ["_arrival_u", "id"], name="_rn").withColumn("internal_id", F.lit(top) + F.col("_rn"))
    changed = newest.select("id", F.struct(*fields).alias("_u"))
    kept = nodes.join(changed, "id", "left").select("id", "internal_id", *[F.when(F.col("_u").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)).alias(c) for c in fields])
    return kept.unionByName(fresh.select("id", "internal_id", *fields))


def insert_nodes_once(nodes: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    """First write per id wins; known ids stay as they are."""
    fields = nodes.columns
    return nodes.unionByName(_last_write(updates, seq, False).join(nodes.select("id"), "id", "left_anti").select(*fields))


def insert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame, seq: Sequence[str] = ("t_us", "flow_id")) -> DataFrame:
    """Add edges with known endpoints and a new (src, dst); the first by ``seq`` wins."""
    payload = F.struct(*[F.col(c) for c in edges.columns if c not in ("src", "dst")])
    known = with_both_ends(new, nodes)
    first = known.groupBy("src", "dst").agg(F.min_by(payload, F.struct(*seq)).alias("w")).select("src", "dst", "w.*")
    return edges.unionByName(first.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select(*edges.columns))


def validate_edges(edges: DataFrame, width: int, feat: str = "feat", t_us: str = "t_us") -> DataFrame:
    """Counts of rows that break the edge contract."""
    return edges.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("missing_ends"),
        F.count_if(F.coalesce(F.size(feat), F.lit(-1)) != width).alias("bad_width"), F.count_if(F.col(t_us).isNull()).alias("missing_time"))


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def node_features(ids: DataFrame, nodes: DataFrame, dim: int) -> DataFrame:
    """Features of the asked ids, zero vector when unknown."""
    return ids.join(nodes.select("id", "feat"), "id", "left").select("id", F.coalesce("feat", zeros(dim)).alias("feat"))


def node_labels(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    return ids.join(nodes.select("id", "label"), "id", "left").select("id", F.coalesce("label", F.lit(-1)).alias("label"))


def edge_features(asked: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """Features per asked (src, dst), zero vector when there is no such edge."""
    return asked.join(edges.select("src", "dst", "feat"), ["src", "dst"], "left").select("src", "dst", F.coalesce("feat", zeros(dim)).alias("feat"))


def temporal_subgraph(edges: DataFrame, nodes: DataFrame, now_us: int, window_us: int, dim: int) -> tuple[DataFrame, DataFrame]:
    """Edges of ``[now - window, now]`` and the nodes they touch, with default features and labels."""
    cut = edges.where(F.col("t_us").between(now_us - window_us, now_us))
    touched = endpoints(cut).join(nodes.select("id", "feat", "label"), "id", "left")
    return cut, touched.select("id", F.coalesce("feat", zeros(dim)).alias("feat"), F.coalesce("label", F.lit(-1)).alias("label"))


def temporal_subgraph_all_nodes(edges: DataFrame, nodes: DataFrame, now_us: int, window_us: int) -> tuple[DataFrame, DataFrame]:
    """Lower time bound only, every node stays."""
    return edges.where(F.col("t_us") >= now_us - window_us), nodes


def subgraph_caps(edges: DataFrame, nodes: DataFrame, now_us: int, window_us: int, max_nodes: int = 5000, max_edges: int = 10_000, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """A sample of at most ``max_nodes`` nodes, then the oldest ``max_edges`` window edges among them."""
    some = mark_quota(nodes, "id", seed, max_nodes).where("_in").drop("_in")
    cut = with_both_ends(edges.where(F.col("t_us").between(now_us - window_us, now_us)), some)
    return top_rows(cut, [F.col("t_us"), F.col("flow_id")], max_edges), some


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))


def prune_inactive(nodes: DataFrame, edges: DataFrame, idle_us: int, now_us: int | None = None, least_share: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Drop nodes idle for more than ``idle_us`` at event time ``now_us`` and their edges; nothing
    happens while fewer than ``least_share`` of the nodes are idle."""
    now = nodes.agg(F.max("last_us")).first()[0] if now_us is None else now_us
    idle = F.lit(now) - F.col("last_us") > idle_us
    if least_share > 0:
        share = nodes.agg(F.avg(idle.cast("double"))).first()[0]
        if share is None or share < least_share:
            return nodes, edges
    gone = nodes.where(idle)
    return nodes.where(~idle), keep_matching(keep_matching(edges, gone, "src", how="left_anti"), gone, "dst", how="left_anti")


def relabel(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contiguous ids in sorted order for nodes and edges."""
    ids = number(nodes.select("id").distinct(), ["id"], name="_rn").select("id", (F.col("_rn") - 1).alias("new_id"))
    a = lookup_join(edges, ids.toDF("src", "src_id"), ["src"], "flow_id", "inner")
    return ids, lookup_join(a, ids.toDF("dst", "dst_id"), ["dst"], "flow_id", "inner")


def proximity_edges(nodes: DataFrame, within_us: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Link all nodes (id, t_us, feat) at most ``within_us`` apart, earlier to later (both ways at equal time).

    Range join by cells of time that are ``SPAN`` times the reach: a node goes to its cell, and as an earlier one to the next when its reach
    ends there, so one row and a sixteenth per node are shuffled. A task reads its cells in the order of time and holds the rows within reach
    alone. The later nodes of a crowded cell are dealt to parts, each of which gets all earlier ones.
    """
    spark, span, most = nodes.sparkSession, SPAN * max(1, within_us), max(1, hot_rows // SPAN)
    rows = nodes.select("id", "t_us", F.col("feat").cast("array<double>").alias("feat")).where("id IS NOT NULL AND t_us IS NOT NULL")
    own, last = F.floor(F.col("t_us") / span), F.floor((F.col("t_us") + within_us) / span)
    crowded = rows.groupBy(own.alias("_b")).agg(F.least(F.lit(PIECES), F.ceil(F.count(F.lit(1)) / most)).cast("int").alias("_parts")).where("_parts > 1")
    placed = rows.withColumns({"_own": own, "_b": F.explode(F.sequence(own, last))}).join(F.broadcast(crowded), "_b", "left")
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    placed = placed.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    late = (F.col("_b") == F.col("_own")) & (F.col("_part") == F.pmod(F.xxhash64("id"), parts))
    placed = placed.select("id", "t_us", "feat", "_b", "_part", late.alias("_late"))
    tasks = -(-rows.count() // ROWS_PER_TASK)
    wide = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.repartition(*([tasks] if wide else []), "_b", "_part").sortWithinPartitions("_b", "_part", "t_us")
    kinds = {"src": nodes.schema["id"].dataType, "dst": nodes.schema["id"].dataType, "t_us": nodes.schema["t_us"].dataType, "dt": T.DoubleType(), "similarity": T.DoubleType()}
    found = dealt.mapInArrow(near_in_time(within_us, list(kinds)), T.StructType([T.StructField(n, kind) for n, kind in kinds.items()]))
    return found.where("src != dst")


def edge_similarity(edges: DataFrame, nodes: DataFrame, spread_on: str = "flow_id") -> DataFrame:
    """Cosine of the endpoint features for every edge."""
    f = nodes.select("id", "feat")
    a = lookup_join(edges, f.toDF("src", "_fa"), ["src"], spread_on, "inner")
    b = lookup_join(a, f.toDF("dst", "_fb"), ["dst"], spread_on, "inner")
    return b.withColumn("similarity", cosine("_fa", "_fb")).drop("_fa", "_fb")


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbour sets as distinct rows (node, direction, neighbour): a hub stays many rows."""
    return edges.select(F.inline(F.array(
        F.struct(F.col("src").alias("id"), F.lit("out").alias("direction"), F.col("dst").alias("neighbour")),
        F.struct(F.col("dst").alias("id"), F.lit("in").alias("direction"), F.col("src").alias("neighbour"))))).distinct()


def node_times(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"), "t_us")
    return ends.groupBy("id").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """in / out / total degree per node; listed nodes without edges get zeros."""
    ends = F.array(
        F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    rows = edges.select(F.inline(ends))
    if nodes is not None:
        rows = rows.unionByName(nodes.select("id", F.lit(0).alias("o"), F.lit(0).alias("i")))
    return rows.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))


def density(edges: DataFrame) -> DataFrame:
    """Node and edge counts and E / (N (N - 1))."""
    n = endpoints(edges).agg(F.count(F.lit(1)).alias("n_nodes"))
    both = n.withColumn("n_edges", edges.agg(F.count(F.lit(1)).alias("e")).scalar())
    full = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return both.withColumn("density", F.when(full > 0, F.col("n_edges") / full).otherwise(F.lit(0.0)))
