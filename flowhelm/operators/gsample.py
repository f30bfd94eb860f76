"""Graph sampling: weighted nodes, walks, layers, history, memory.

Random choices rank by md5 of ids and a seed. Iterative samplers keep their frontier as a table, join
it with the edges level by level and cut the lineage in the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.functions.scalar import seeded_hash, unit
from flowhelm.operators.graph import degrees, node_features
from flowhelm.plans.lookup import keep_matching, sized, with_both_ends
from flowhelm.plans.ordered import ROWS_PER_BLOCK, TOP_K_ROWS, hash_number, number, top_rows
from flowhelm.plans.ranks import interpolated, order_statistics, ranks_around
from flowhelm.session import cut_lineage, stored

def node_importance(edges: DataFrame) -> DataFrame:
    """(id, degree, importance): degree share of each node; importance sums to one."""
    total = 2 * edges.count()
    return degrees(edges).select("id", "degree", (F.col("degree") / F.lit(float(max(total, 1)))).alias("importance"))


def sample_nodes_weighted(nodes: DataFrame, size: int, weight: str = "importance", seed: str = "0") -> DataFrame:
    """``size`` nodes without replacement, probability by weight (Efraimidis-Spirakis keys); zero
    weights come last, in uniform order, which also covers all-zero weights."""
    h = seeded_hash("id", seed)
    key = F.when(F.col(weight) > 0, F.log(unit(h)) / F.col(weight)).otherwise(F.lit(float("-inf")))
    keyed = nodes.withColumns({"_h": h, "_neg": -key})
    return top_rows(keyed, [F.col("_neg"), F.col("_h")], size).drop("_h", "_neg")


def random_walks(edges: DataFrame, starts: DataFrame, length: int, seed: str = "0", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(walk, step, id): up to ``length`` steps along successors; a walk ends at a sink.

    Successors are numbered once and know how many their own are, so a step is one equi-join on (node, position) and a hub
    costs no more than any other node. A walk carries its path; steps become rows at the end.
    """
    pairs = edges.select("src", "dst").distinct()
    numbered = number(pairs, ["dst"], ["src"], "_pos", rows_per_block)
    deg = sized(stored(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("_deg")), "degrees"))
    adj = sized(stored(numbered.join(deg.select(F.col("src").alias("dst"), F.col("_deg").alias("_next")), "dst", "left"), "successors"))
    walks = starts.select(F.col("id").alias("walk"), F.col("id").alias("src")).join(deg, "src", "left").select("walk", "src", "_deg", F.array("src").alias("_path"))
    for step in range(1, length + 1):
        pick = F.conv(F.substring(F.md5(F.concat(F.col("walk"), F.lit(f"|{seed}|{step}"))), 1, 8), 16, 10).cast("long")
        # Ended walks ask for position 0 of their start, which no node has: in a shuffle they spread like the others.
        goes = F.col("_deg").isNotNull()
        asks = walks.withColumns({"src": F.when(goes, F.col("src")).otherwise(F.col("walk")), "_pos": F.when(goes, pick % F.col("_deg") + 1).otherwise(F.lit(0))})
        met = asks.join(adj, ["src", "_pos"], "left")
        path = F.when(F.col("dst").isNotNull(), F.concat("_path", F.array("dst"))).otherwise(F.col("_path"))
        walks = met.select("walk", F.col("dst").alias("src"), F.col("_next").alias("_deg"), path.alias("_path"))
    return walks.select("walk", F.posexplode("_path").alias("step", "id"))


def induced_subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return with_both_ends(edges, ids)


def memory_percentile(memory: DataFrame, p: float) -> DataFrame:
    """Memory nodes whose importance reaches the p-th percentile, found by selection whatever the size of the memory."""
    n = memory.agg(F.count_if(F.col("importance").isNotNull() & ~F.isnan("importance"))).first()[0]
    if not n:
        return memory.limit(0)
    found = order_statistics(memory, {"importance": ranks_around(n, [p / 100.0])}, {"importance": n})["importance"]
    return memory.where(F.col("importance") >= F.lit(interpolated(found, n, p / 100.0)))


def memory_update(memory: DataFrame, sampled: DataFrame, now: int, size: int = 1000) -> DataFrame:
    """Upsert sampled (id, importance): newest importance, access time and count; the oldest leave."""
    old = memory.select("id", F.lit(0).alias("_new"), "importance", "last_access", "access_count")
    new = sampled.select("id", F.lit(1).alias("_new"), "importance", F.lit(now).cast("long").alias("last_access"), F.lit(1).cast("long").alias("access_count"))
    merged = old.unionByName(new).groupBy("id").agg(
        F.max_by("importance", "_new").alias("importance"), F.max("last_access").alias("last_access"), F.sum("access_count").alias("access_count"))
    return top_rows(merged, [F.desc("last_access"), F.col("id")], size) if size <= TOP_K_ROWS else top_rows(merged, [-F.col("last_access"), F.col("id")], size)


def memory_hit_stats(memory: DataFrame, sampled: DataFrame) -> DataFrame:
    m, s = memory.select("id", F.lit(1).alias("_m")).distinct(), sampled.select("id").distinct()
    return s.join(m, "id", "left").agg(F.count_if(F.col("_m").isNotNull()).alias("hits"), F.count_if(F.col("_m").isNull()).alias("misses"))


def graphsaint_nodes(edges: DataFrame, size: int, num_walks: int, walk_length: int, memory: DataFrame | None = None, seed: str = "0") -> DataFrame:
    """Weighted nodes, nodes met by walks from some of them, and important memory nodes."""
    picked = cut_lineage(sample_nodes_weighted(node_importance(edges), size, seed=seed).select("id"))
    starts = top_rows(picked.withColumn("_h", seeded_hash("id", f"{seed}w")), [F.col("_h")], num_walks).drop("_h")
    ids = picked.unionByName(random_walks(edges, starts, walk_length, seed).select("id"))
    if memory is not None:
        ids = ids.unionByName(memory_percentile(memory, 75).select("id"))
    return ids.distinct()


def graphsaint(edges: DataFrame, size: int, num_walks: int, walk_length: int, memory: DataFrame | None = None, seed: str = "0") -> DataFrame:
    return induced_subgraph(edges, graphsaint_nodes(edges, size, num_walks, walk_length, memory, seed))


@dataclass(frozen=True)
class Sample:
    """One call of a sampler: nodes (id, feat, hit), the edges among them, and what happened to the memory."""

    nodes: DataFrame
    edges: DataFrame
    hits: int
    misses: int
    evicted: int


class MemorySampler:
    """Sampling whose memory lives from call to call. Each call samples in a time window, remembers what it met with its importance there, and
    forgets the nodes met longest ago beyond ``memory_size``; later calls draw on the important ones. The memory is a stored table,
    replaced by the next one; nodes come with their features, zeros when unknown."""

    def __init__(self, nodes: DataFrame, dim: int, memory_size: int = 1000):
        self.nodes, self.dim, self.memory_size, self.calls = nodes, dim, memory_size, 0
        ident = nodes.schema["id"].dataType.simpleString()
        self.memory = nodes.sparkSession.createDataFrame([], f"id {ident}, importance double, last_access long, access_count long")
        self.remembered = 0

    def sample(self, edges: DataFrame, choose: Callable[[DataFrame, DataFrame | None], DataFrame], window: tuple[int, int] | None = None) -> Sample:
        """``choose`` gives the ids from the window's edges and the memory (none in the first call), for instance :func:`graphsaint_nodes`."""
        cut = edges if window is None else edges.where(F.col("t_us").between(*window))
        ids = stored(choose(cut, self.memory if self.remembered else None).select("id").distinct(), "ids")
        known = self.memory.select("id", F.lit(True).alias("hit"))
        marked = stored(ids.join(known, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "marked")
        hits, sampled = marked.agg(F.count_if("hit"), F.count(F.lit(1))).first()
        met = ids.join(node_importance(cut).select("id", "importance"), "id", "left").withColumn("importance", F.coalesce("importance", F.lit(0.0)))
        self.memory = stored(memory_update(self.memory, met, self.calls, self.memory_size), "memory")
        self.calls += 1
        before, self.remembered = self.remembered, self.memory.count()
        nodes = node_features(ids, self.nodes, self.dim).join(marked, "id")
        return Sample(nodes, induced_subgraph(cut, ids), hits, sampled - hits, before + sampled - hits - self.remembered)


def both_directions(edges: DataFrame) -> DataFrame:
    """Neighbour rows (id, nbr) of the distinct pairs, predecessors and successors."""
    pairs = edges.select("src", "dst").distinct()
    return pairs.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))))


def frontier_nodes(edges: DataFrame, size: int, seeds: int = 100, memory: DataFrame | None = None, memory_seeds: int = 20, layers: int = 3, seed: str = "0",
                   rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Layered neighbour sampling: each frontier node takes a shrinking share of its neighbours,
    nodes not visited at the layer's start first. A hub's neighbours are ranked in hash blocks."""
    nbrs = cut_lineage(both_directions(edges))
    deg = nbrs.groupBy("id").agg(F.count(F.lit(1)).alias("_deg"))
    front = sample_nodes_weighted(node_importance(edges), seeds, seed=seed).select("id")
    if memory is not None:
        near = keep_matching(memory_percentile(memory, 90).select("id"), deg, "id").withColumn("_h", seeded_hash("id", f"{seed}m"))
        front = front.unionByName(near.orderBy("_h").limit(memory_seeds).drop("_h")).distinct()
    # One stored table a layer: all nodes visited so far, and which of them are the layer's frontier.
    state = stored(front.withColumn("_front", F.lit(True)), "layer")
    for layer in range(layers):
        quota = F.greatest(F.lit(1).cast("long"), F.floor(F.col("_deg") * F.lit(0.5 ** (layer + 1))))
        seen = state.select(F.col("id").alias("nbr"), F.lit(True).alias("_seen"))
        around = nbrs.join(state.where("_front").select("id"), "id").join(seen, "nbr", "left").withColumn("_seen", F.coalesce("_seen", F.lit(False)))
        fresh = around.groupBy("id").agg(F.bool_and("_seen").alias("_all_seen"), F.count(F.lit(1)).alias("_deg"))
        usable = around.join(fresh, "id").where(~F.col("_seen") | F.col("_all_seen")).select("id", "nbr", "_deg")
        ranked = hash_number(usable.withColumn("_h", F.md5(F.concat("id", F.lit("|"), "nbr", F.lit(f"|{seed}|{layer}")))), "_h", ["id"], "_rk", rows_per_block)
        taken = ranked.where(F.col("_rk") <= quota).select(F.col("nbr").alias("id"), F.lit(True).alias("_front"))
        state = stored(state.select("id", F.lit(False).alias("_front")).unionByName(taken).groupBy("id").agg(F.bool_or("_front").alias("_front")), "layer")
        if state.count() >= size:
            break
    return top_rows(state.select("id", seeded_hash("id", f"{seed}c").alias("_h")), [F.col("_h")], size).drop("_h")


def historical_nodes(edges: DataFrame, start_us: int, end_us: int, size: int, seed: str = "0") -> tuple[DataFrame, DataFrame]:
    """Seven tenths of the sample from the current window, the rest from the equally long window before
    it: (nodes, edges of both windows)."""
    before = max(0, start_us - (end_us - start_us))
    current = edges.where(F.col("t_us").between(start_us, end_us))
    past = edges.where((F.col("t_us") >= before) & (F.col("t_us") <= start_us))
    now_size = int(size * 0.7)
    now = sample_nodes_weighted(node_importance(current), now_size, seed=seed).select("id")
    old = sample_nodes_weighted(node_importance(past), size - now_size, seed=f"{seed}h").select("id")
    return now.unionByName(old).distinct(), edges.where(F.col("t_us").between(before, end_us))


def historical(edges: DataFrame, window: tuple[int, int] | None, size: int, num_walks: int = 10, walk_length: int = 4, seed: str = "0") -> DataFrame:
    if window is None:
        return graphsaint(edges, size, num_walks, walk_length, seed=seed)
    ids, both = historical_nodes(edges, *window, size, seed)
    return induced_subgraph(both, ids)


def recent_edge_nodes(edges: DataFrame, size: int) -> DataFrame:
    """Endpoints of the newest 5 * size edges, most recent first, at most ``size``."""
    newest = top_rows(edges.select("src", "dst", "t_us", "flow_id"), [-F.col("t_us"), -F.col("flow_id")], 5 * size)
    ends = newest.select(F.explode(F.array("src", "dst")).alias("id"), "t_us")
    return top_rows(ends.groupBy("id").agg(F.max("t_us").alias("last_us")), [-F.col("last_us"), F.col("id")], size)


def bfs_sample(edges: DataFrame, seeds: DataFrame, size: int, seed: str = "0") -> DataFrame:
    """(id, level): breadth-first from the seeds until ``size`` nodes or no new ones; the last level fills
    by hash order."""
    nbrs = cut_lineage(both_directions(edges))
    found = front = cut_lineage(seeds.select("id").distinct().withColumn("level", F.lit(0)))
    level, reached = 0, found.count()
    while reached < size:
        level += 1
        new = nbrs.join(front.select("id"), "id").select(F.col("nbr").alias("id")).distinct()
        front = cut_lineage(new.join(found.select("id"), "id", "left_anti").withColumn("level", F.lit(level)))
        fresh = front.count()
        if not fresh:
            break
        reached += fresh
        found = found.unionByName(front)
    return top_rows(found.withColumn("_h", seeded_hash("id", seed)), [F.col("level"), F.col("_h")], size).drop("_h")


def neighbor_fanout(edges: DataFrame, seeds: DataFrame, fanouts: Sequence[int], seed: str = "0", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(layer, src, dst, flow_id): per layer up to k sampled in-edges of the layer's nodes (-1: all)."""
    front = seeds.select(F.col("id").alias("dst")).distinct()
    out = None
    for layer, k in enumerate(fanouts):
        near = edges.select("src", "dst", "flow_id").join(front, "dst")
        if k >= 0:
            h = near.withColumn("_h", seeded_hash("flow_id", f"{seed}|{layer}"))
            w = Window.partitionBy("dst").orderBy("_h", "flow_id")  # limited per map task before the shuffle
            near = h.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk", "_h")
        near = cut_lineage(near.select(F.lit(layer).alias("layer"), "src", "dst", "flow_id"))
        out = near if out is None else out.unionByName(near)
        front = near.select(F.col("src").alias("dst")).distinct()
    return out


def seed_batches(nodes: DataFrame, size: int, seed: str = "0", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(id, batch): shuffled nodes cut into batches."""
    ranked = hash_number(nodes.select("id").withColumn("_h", seeded_hash("id", seed)), "_h", name="_rk", rows_per_block=rows_per_block)
    return ranked.select("id", F.floor((F.col("_rk") - 1) / size).alias("batch"))


# --- clusters -------------------------------------------------------------------------------

def cluster_nodes_spectral(edges: DataFrame, k: int = 50, iterations: int = 10) -> DataFrame:
    """(id, cluster) by power iteration over the pair weights (distributed spectral clustering)."""
    from pyspark.ml.clustering import PowerIterationClustering

    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ids = cut_lineage(number(ends, ["id"], name="num"))
    a, b = F.least("a", "b"), F.greatest("a", "b")
    pairs = (
        edges.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .join(ids.select(F.col("id").alias("src"), F.col("num").alias("a")), "src")
        .join(ids.select(F.col("id").alias("dst"), F.col("num").alias("b")), "dst")
        .where("a != b").groupBy(a.alias("src"), b.alias("dst")).agg(F.sum("weight").alias("weight"))
    )
    model = PowerIterationClustering(k=k, maxIter=iterations, srcCol="src", dstCol="dst", weightCol="weight", initMode="degree")
    return model.assignClusters(pairs).withColumnRenamed("id", "num").join(ids, "num").select("id", "cluster")


def cluster_nodes_kmeans(nodes: DataFrame, vec: str = "feat", k: int = 50, seed: int = 7) -> DataFrame:
    """(id, cluster) by k-means on features (or on a one-element degree vector)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = nodes.select("id", array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v).transform(v).select("id", "cluster")


def cluster_gcn(edges: DataFrame, clusters: DataFrame, size: int, memory: DataFrame | None = None, take: int = 3, seed: str = "0") -> DataFrame:
    """Edges induced by up to three randomly chosen clusters (capped) and a few important memory nodes."""
    names = clusters.select("cluster").distinct().withColumn("_h", seeded_hash("cluster", seed)).orderBy("_h").limit(take)
    chosen = clusters.join(F.broadcast(names.select("cluster")), "cluster").select("id")
    ids = top_rows(chosen.withColumn("_h", seeded_hash("id", seed)), [F.col("_h")], size).drop("_h")
    if memory is not None:
        top = memory_percentile(memory, 80).select("id").withColumn("_h", seeded_hash("id", f"{seed}m"))
        ids = ids.unionByName(top.orderBy("_h").limit(max(1, size // 10)).drop("_h"))
    return induced_subgraph(edges, ids.distinct())
