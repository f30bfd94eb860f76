"""Exact k-nearest-neighbour graph without all-pairs rows.

Vectors are placed in a metric tree: a node with more than ``LEAF_ROWS`` of them is split around pivots of its own, round by round, until
every leaf is small or holds one vector many times over (of these the k + 1 smallest ids can be neighbours of anything).
A vector is first compared with its leaf, which bounds how far its k-th neighbour can be. Then the leaves go to the tasks, in parts of at
most ``MEMBER_BYTES`` of vectors, and a query walks down the tree into the nodes that the triangle inequality cannot exclude and asks their
leaves where it is: however many leaves it asks, no query is copied, and what lies on disk grows with the vectors, not with the asks.
While the tree grows, its centres go out in parts of at most ``PART_BYTES``.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.functions.scalar import seeded_hash, unit
from flowhelm.session import discard, stored

# The helpers travel with the tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF_ROWS = 1500
FANOUT = 64
QUERIES_PER_TASK = 4096
MOST_LEVELS = 10
PART_BYTES = 32 << 20
MEMBER_BYTES = 64 << 20
ROWS_OUT_BYTES = 4 << 20
BLOCK_ROWS = 1024
BLOCK_PAIRS = 1 << 15


def _matrix(s: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in s]) if len(s) else np.zeros((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and per row of ``a`` a bound of their rounding error."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    rough = na[:, None] + nb[None, :] - 2.0 * (a @ b.T)
    return np.maximum(rough, 0.0), 1e-9 * (na + (nb.max() if len(nb) else 0.0)) + 1e-12


def _candidates(a: np.ndarray, ids: np.ndarray, bound: np.ndarray, b: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of ``a``, row of ``b`` and exact distance of all that may be among the k nearest others within ``bound``: the product
    finds who may be near enough, differences decide. A bounded number of rows and of pairs at a time."""
    rows, cols, far = [], [], []
    nb = np.einsum("ij,ij->i", b, b)
    right = np.column_stack([b, np.ones(len(b)), nb])
    for begin in range(0, len(a), BLOCK_ROWS):
        some = slice(begin, begin + BLOCK_ROWS)
        na = np.einsum("ij,ij->i", a[some], a[some])
        rough = np.column_stack([-2.0 * a[some], na, np.ones(len(na))]) @ right.T  # squared distances
        slack = 1e-9 * (na + (nb.max() if len(nb) else 0.0)) + 1e-12
        maybe = rough <= ((bound[some] + 1e-9) ** 2 + slack)[:, None]
        many = np.flatnonzero(maybe.sum(axis=1) > 4 * k)
        if len(many) and len(b) > k:
            apart = rough[many]
            apart[ids[some][many][:, None] == others[None, :]] = np.inf
            maybe[many] &= apart <= (np.partition(apart, k - 1, axis=1)[:, k - 1] + 2 * slack[many])[:, None]
        i, j = np.nonzero(maybe)
        unlike = ids[some][i] != others[j]
        i, j = i[unlike] + begin, j[unlike]
        for cut in range(0, len(i), BLOCK_PAIRS):
            x, y = i[cut : cut + BLOCK_PAIRS], j[cut : cut + BLOCK_PAIRS]
            d = np.sqrt(((a[x] - b[y]) ** 2).sum(axis=1))
            near = d <= bound[x]
            rows.append(x[near])
            cols.append(y[near])
            far.append(d[near])
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, dtype=kind)
    return join(rows, int), join(cols, int), join(far, float)


def _first(i: np.ndarray, others: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest of each row ``i``, ties by id, in the order of rows and ranks."""
    order = np.lexsort((others, far, i))
    turn = np.arange(len(i)) - np.searchsorted(i[order], i[order], side="left")
    return order[turn < k]


def _own(k: int):
    """Every vector of a group against the group: its nearest, as lists, and how far the k-th is."""

    def search(group: pd.DataFrame) -> pd.DataFrame:
        ids, v = group["_id"].to_numpy(), _matrix(group["_v"])
        i, j, d = _candidates(v, ids, np.full(len(v), np.inf), v, ids, k)
        best = _first(i, ids[j], d, k)
        ends = np.searchsorted(i[best], np.arange(len(v) + 1))
        near, far = ids[j[best]], d[best]
        bound = np.full(len(v), np.inf)
        whole = np.diff(ends) >= k
        bound[whole] = far[ends[1:][whole] - 1]
        lists = [slice(x, y) for x, y in zip(ends, ends[1:])]
        near = near if near.dtype.kind != "f" else np.array([None if x != x else int(x) for x in near], dtype=object)
        return group[["_id", "_v", "_node", "_piece"]].assign(_bound=bound, _near=[list(near[x]) for x in lists], _far=[far[x] for x in lists])

    return search


class _Tree:
    """Nodes by number: children (numbers, centres, radii) of inner ones, how many vectors each holds and how far they reach."""

    def __init__(self, n: int):
        self.size, self.radius = {0: n}, {0: np.inf}
        self.children: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def open(self, leaf_rows: int) -> list[int]:
        return sorted(n for n, size in self.size.items() if size > leaf_rows and self.radius[n] > 0 and n not in self.children)

    def parts(self, nodes: list[int]) -> list[list[int]]:
        """Inner nodes in groups whose centres fit ``PART_BYTES``."""
        parts, size = [[]], 0
        for n in nodes:
            own = self.children[n][1].nbytes
            if parts[-1] and size + own > PART_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(n)
            size += own
        return parts


def _grown(placed: DataFrame, tree: _Tree, leaf_rows: int, level: int, fanout: int) -> DataFrame:
    """One round: every open node gets pivots among its vectors and deals them out."""
    spark, nodes = placed.sparkSession, tree.open(leaf_rows)
    wanted = {n: max(2, min(fanout, math.ceil(1.5 * tree.size[n] / leaf_rows))) for n in nodes}
    rates = spark.createDataFrame([(n, min(1.0, 8.0 * wanted[n] / tree.size[n]), wanted[n]) for n in nodes], "_node long, _rate double, _wanted int")
    drawn = placed.join(F.broadcast(rates), "_node").withColumn("_h", seeded_hash("_id", f"pivot{level}")).where(unit("_h") <= F.col("_rate"))
    turn = F.row_number().over(Window.partitionBy("_node").orderBy("_h"))
    heads: dict[int, list] = {}
    for r in drawn.withColumn("_turn", turn).where("_turn <= _wanted").select("_node", "_v").toLocalIterator():
        heads.setdefault(r["_node"], []).append(r["_v"])
    for n, centres in heads.items():
        tree.children[n] = (n * FANOUT + 1 + np.arange(len(centres)), np.array(centres, dtype=float), np.zeros(len(centres)))
    done = None
    parts = tree.parts(sorted(heads))
    for part in parts:
        shared = spark.sparkContext.broadcast({n: tree.children[n][:2] for n in part})
        rows = placed.where(F.col("_node").isin(part)) if len(parts) > 1 else placed

        def assign(batches, shared=shared):
            for pdf in batches:
                node, reach = pdf["_node"].to_numpy().copy(), pdf["_r"].to_numpy().copy()
                for n in np.unique(node):
                    if n in shared.value:
                        numbers, centres = shared.value[n]
                        rows = np.flatnonzero(pdf["_node"].to_numpy() == n)
                        a = _matrix(pdf["_v"].iloc[rows])
                        cell = _squares(a, centres)[0].argmin(axis=1)
                        node[rows], reach[rows] = numbers[cell], np.sqrt(((a - centres[cell]) ** 2).sum(axis=1))
                yield pdf.assign(_node=node, _r=reach)

        dealt = rows.mapInPandas(assign, placed.schema)
        done = dealt if done is None else done.unionByName(dealt)
    if len(parts) > 1:
        done = done.unionByName(placed.where(~F.col("_node").isin(sorted(heads))))
    placed = stored(done, "placed")
    found = {r["_node"]: r for r in placed.groupBy("_node").agg(F.max("_r").alias("radius"), F.count(F.lit(1)).alias("n")).collect()}
    for n in heads:
        numbers, centres, radii = tree.children[n]
        there = np.array([c in found for c in numbers])
        tree.children[n] = numbers[there], centres[there], np.array([found[c]["radius"] for c in numbers[there]])
        for c in numbers[there]:
            tree.size[int(c)], tree.radius[int(c)] = found[c]["n"], found[c]["radius"]
    return placed


def _path(node: int) -> tuple[int, ...]:
    """The nodes from the root to ``node``; leaves sorted by it have their neighbours in the tree beside them."""
    return (*reversed(_ancestors(node)), node)


def _ancestors(node: int) -> list[int]:
    above = []
    while node:
        node = (node - 1) // FANOUT
        above.append(node)
    return above


def _member_parts(groups: list[tuple[int, int, int]], width: int) -> list[list[tuple[int, int]]]:
    """Groups (leaf, piece, rows) in the order of the tree, in parts whose vectors of ``width`` bytes fit ``MEMBER_BYTES``."""
    parts, size = [[]], 0
    for node, piece, n in sorted(groups, key=lambda g: (_path(g[0]), g[1])):
        if parts[-1] and size + n * width > MEMBER_BYTES:
            parts.append([])
            size = 0
        parts[-1].append((node, piece))
        size += n * width
    return parts


def _reach_of(tree: _Tree, part: list[tuple[int, int]], homes: dict[int, float]) -> list[int]:
    """The leaves of ``homes`` (with the largest bound of their vectors) from which anything in ``part`` can be in reach: centres may be as far
    apart as both radii and the bound together."""
    place = {int(n): (c, r) for numbers, centres, radii in tree.children.values() for n, c, r in zip(numbers, centres, radii)}
    there = sorted({n for n, _ in part})
    if any(n not in place for n in [*there, *homes]):
        return sorted(homes)
    b, rb = np.array([place[n][0] for n in there]), np.array([place[n][1] for n in there])
    out = []
    for n, bound in homes.items():
        centre, radius = place[n]
        gap = np.sqrt(((b - centre) ** 2).sum(axis=1)) - rb - radius
        if (gap <= bound + 1e-9 * (1.0 + np.abs(gap) + radius + rb)).any():
            out.append(n)
    return out


def _asked(bounded: DataFrame, members: DataFrame, tree: _Tree, part: list[tuple[int, int]], homes: list[int] | None, k: int) -> DataFrame:
    """(_id, neighbour, distance): for every query the k nearest members of ``part``, groups (leaf, piece) other than the query's own, within its bound.

    The members go to the tasks, so no query is copied. A query walks down the tree to the leaves that the triangle inequality cannot
    exclude, asks the nearest first, and what it finds tightens its bound."""
    spark = bounded.sparkSession
    wanted = F.broadcast(spark.createDataFrame(part, "_node long, _piece int"))
    held: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for (node, piece), rows in members.join(wanted, ["_node", "_piece"], "left_semi").select("_node", "_piece", "_id", "_v").toPandas().groupby(["_node", "_piece"]):
        held.setdefault(int(node), {})[int(piece)] = rows["_id"].to_numpy(), np.stack(rows["_v"].to_list())
    above = {a for n in held for a in _ancestors(n)}
    steps = {}
    for n in above:
        numbers, centres, radii = tree.children[n]
        way = np.array([int(c) in above or int(c) in held for c in numbers], dtype=bool)
        steps[n] = numbers[way], centres[way], radii[way]
    shared = spark.sparkContext.broadcast((held, steps))
    if homes is not None:
        bounded = bounded.join(F.broadcast(spark.createDataFrame([(n,) for n in homes], "_node long")), "_node", "left_semi")

    def ask(batches):
        held, steps = shared.value
        for pdf in batches:
            v, ids, home, piece = _matrix(pdf["_v"]), pdf["_id"].to_numpy(), pdf["_node"].to_numpy(), pdf["_piece"].to_numpy()
            bound = pdf["_bound"].to_numpy().copy()
            best = np.full((len(pdf), k), np.inf)
            for row, far in enumerate(pdf["_far"]):
                best[row, : len(far)] = far
            visits, stack = [], [(0, np.arange(len(pdf)), np.zeros(len(pdf)))]
            while stack:
                node, some, least = stack.pop()
                if node in held:
                    visits.append((node, some, least))
                    continue
                numbers, centres, radii = steps[node]
                rough, slack = _squares(v[some], centres)
                least = np.sqrt(rough) - np.sqrt(slack)[:, None] - radii  # no more than the distance to anything inside
                for j, child in enumerate(numbers):
                    there = least[:, j] <= bound[some] + 1e-9
                    if there.any():
                        stack.append((int(child), some[there], least[there, j]))
            at, near, far = [], [], []
            for node, some, least in sorted(visits, key=lambda x: x[2].mean()):
                for own, (others, b) in held[node].items():
                    asks = some[(least <= bound[some] + 1e-9) & ((home[some] != node) | (piece[some] != own))]
                    if not len(asks):
                        continue
                    i, j, d = _candidates(v[asks], ids[asks], bound[asks], b.astype(float), others, k)
                    first = _first(i, others[j], d, k)
                    i, j, d = i[first], j[first], d[first]
                    at.append(asks[i])
                    near.append(others[j])
                    far.append(d)
                    found, begin = np.unique(i, return_index=True)
                    news = np.full((len(found), k), np.inf)
                    news[np.searchsorted(found, i), np.arange(len(i)) - np.repeat(begin, np.diff([*begin, len(i)]))] = d
                    rows = asks[found]
                    best[rows] = np.sort(np.hstack([best[rows], news]), axis=1)[:, :k]
                    bound[rows] = np.minimum(bound[rows], best[rows, k - 1])
            if at:
                at, near, far = np.concatenate(at), np.concatenate(near), np.concatenate(far)
                still = far <= bound[at]
                at, near, far = at[still], near[still], far[still]
                first = _first(at, near, far, k)
                for cut in range(0, len(first), step := max(1, ROWS_OUT_BYTES // 24)):
                    some = first[cut : cut + step]
                    yield pd.DataFrame({"_id": ids[at[some]], "neighbour": near[some], "distance": far[some]})

    found = stored(bounded.select("_id", "_v", "_node", "_piece", "_bound", "_far").mapInPandas(ask, "_id long, neighbour long, distance double"), "near")
    shared.destroy()
    return found


def knn_graph(df: DataFrame, ident: str, vec: str, k: int = 5, leaf_rows: int = LEAF_ROWS, fanout: int = FANOUT) -> DataFrame:
    """(id, rank, neighbour, distance): the k Euclidean neighbours of every vector, itself excluded;
    ties by id. NaN and infinities count as 0."""
    spark, kind = df.sparkSession, "float" if "FloatType" in str(df.schema[vec].dataType) else "double"
    clean = F.transform(F.col(vec).cast(f"array<{kind}>"), lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0).cast(kind)).otherwise(x))
    placed = stored(df.select(F.col(ident).cast("long").alias("_id"), clean.alias("_v")).withColumns({"_node": F.lit(0).cast("long"), "_r": F.lit(float("inf"))}), "placed")
    n, width = placed.agg(F.count(F.lit(1)), F.max(F.size("_v"))).first()
    tree, level = _Tree(n), 0
    while tree.open(leaf_rows) and level < MOST_LEVELS:
        last, placed = placed, _grown(placed, tree, leaf_rows, level, min(fanout, FANOUT))
        discard(last)
        level += 1
    # Leaves of equal vectors: whoever asks gets the smallest ids, and no more than k + 1 of them.
    leaves = {n: size for n, size in tree.size.items() if n not in tree.children}
    equal = [n for n, size in leaves.items() if size > k + 1 and tree.radius[n] == 0]
    own = placed.drop("_r").withColumn("_piece", F.lit(0))
    # A leaf that can't be split is searched in pieces of a bounded size, which ask one another like other leaves.
    pieces = {n: -(-size // QUERIES_PER_TASK) for n, size in leaves.items() if n not in equal and size > QUERIES_PER_TASK}
    if pieces:
        counts = F.broadcast(spark.createDataFrame(list(pieces.items()), "_node long, _pieces int"))
        own = own.join(counts, "_node", "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64("_id"), F.col("_pieces")).cast("int"), F.lit(0))).drop("_pieces")
    lists = f"_id long, _v array<{kind}>, _node long, _piece int, _bound double, _near array<long>, _far array<double>"
    names = [c.split()[0] for c in lists.split(", ")]
    if equal:
        marks = F.broadcast(spark.createDataFrame([(n,) for n in equal], "_node long"))
        alike, own = own.join(marks, "_node", "left_semi"), own.join(marks, "_node", "left_anti")
    bounded = own.groupBy("_node", "_piece").applyInPandas(_own(k), lists)
    if equal:
        none = {"_bound": F.lit(0.0), "_near": F.array().cast("array<long>"), "_far": F.array().cast("array<double>")}
        bounded = bounded.unionByName(alike.withColumns({"_piece": F.lit(-1), **none}).select(*names))
    bounded = stored(bounded, "bounded")
    discard(placed)
    found = bounded.select("_id", F.explode(F.arrays_zip(F.col("_near").alias("neighbour"), F.col("_far").alias("distance"))).alias("x")).select("_id", "x.*")
    members = bounded.select("_node", "_piece", "_id", "_v")
    sizes = [(r["_node"], r["_piece"], r["n"], r["far"]) for r in bounded.groupBy("_node", "_piece").agg(F.count(F.lit(1)).alias("n"), F.max("_bound").alias("far")).collect()]
    if equal:
        w = Window.partitionBy("_node").orderBy("_id")
        first = members.where("_piece = -1").withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= k + 1)
        members = members.where("_piece >= 0").unionByName(first.select("_node", "_turn", "_id", "_v").select("_node", F.lit(0).alias("_piece"), "_id", "_v"))
    homes: dict[int, float] = {}
    for node, _, _, far in sizes:
        homes[node] = max(far, homes.get(node, 0.0))
    groups = [(node, max(piece, 0), size if piece >= 0 else k + 1) for node, piece, size, _ in sizes]
    for part in _member_parts(groups, (8 if kind == "double" else 4) * max(width or 0, 1)) if len(groups) > 1 or equal else []:
        reach = _reach_of(tree, part, homes)
        found = found.unionByName(_asked(bounded, members, tree, part, reach if len(reach) < len(homes) else None, k))
    w = Window.partitionBy("_id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("_id").alias(ident), "rank", "neighbour", "distance")
