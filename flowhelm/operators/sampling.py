"""Row sampling, train/test splits and cross-validation folds.

Every random choice ranks rows by md5(id|seed), so results repeat exactly. Ranks come from
plans.ordered, which spreads large classes over uniform hash ranges. Class tables stay distributed;
rows without a label form a class.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowhelm.functions.scalar import seeded_hash
from flowhelm.plans.lookup import with_both_ends
from flowhelm.plans.ordered import ROWS_PER_BLOCK, hash_number, number
from flowhelm.plans.ranks import mark_quota
from flowhelm.plans.skew import null_safe_join
from flowhelm.session import cut_lineage


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n): rows per class. A missing label is a class of its own."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def _sums(counts: DataFrame) -> tuple[int, int]:
    """All rows and the size of the smallest class (0 for an empty table)."""
    total, least = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.min("n"), F.lit(0))).first()
    return total, least


def _ranked(df: DataFrame, ident: str, seed: str, keys: Sequence[str] = (), name: str = "_rk", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    return hash_number(df.withColumn("_h", seeded_hash(ident, seed)), "_h", keys, name, rows_per_block).drop("_h")


def _rounded(shares: DataFrame, label: str, total: int, rows_per_block: int) -> DataFrame:
    """Largest-remainder rounding of ``share`` to ``total``; equal remainders favour the larger class, then the name."""
    whole = shares.withColumn("quota", F.floor("share"))
    left = total - (whole.agg(F.sum("quota")).first()[0] or 0)
    order = whole.withColumns({"_r": F.col("quota") - F.col("share"), "_m": -F.col("n"), "_none": F.col(label).isNull(), "_s": F.coalesce(F.col(label).cast("string"), F.lit(""))})
    placed = number(order, ["_r", "_m", "_none", "_s"], name="_place", rows_per_block=rows_per_block)
    return placed.withColumn("quota", F.col("quota") + F.when(F.col("_place") <= left, 1).otherwise(0)).drop("_r", "_m", "_none", "_s", "_place", "share")


def proportional_quotas(counts: DataFrame, label: str, total: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(label, n, quota): shares of ``total`` rows by class size."""
    n = max(1, _sums(counts)[0])
    return _rounded(counts.withColumn("share", F.col("n") * total / F.lit(float(n))), label, total, rows_per_block)


def sample_random(df: DataFrame, ident: str, ratio: float, seed: str = "0") -> DataFrame:
    """Exactly int(n * ratio) rows."""
    return mark_quota(df, ident, seed, int(df.count() * ratio)).where("_in").drop("_in")


def _take(df: DataFrame, ident: str, label: str, quotas: DataFrame, seed: str) -> DataFrame:
    return mark_quota(df, ident, seed, quotas, [label]).where("_in").select(*df.columns)


def sample_stratified(df: DataFrame, ident: str, label: str, ratio: float, seed: str = "0", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Proportional sample per class; plain random when a class has one row or ratio is no fraction."""
    counts = cut_lineage(class_counts(df, label))
    total, least = _sums(counts)
    if not 0 < ratio < 1 or least < 2:
        return sample_random(df, ident, min(ratio, 1.0), seed)
    return _take(df, ident, label, proportional_quotas(counts, label, int(total * ratio), rows_per_block), seed)


def minimum_quotas(counts: DataFrame, label: str, ratio: float, at_least: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(label, n, quota): every class first gets its floor, ``at_least`` rows or ``ratio`` of it, whichever is more, and no
    more than it has. What is left of ``ratio`` of all rows goes by largest remainder to the classes with rows left, in
    proportion to these rows, so no class gets more than it has."""
    floors = cut_lineage(counts.withColumn("_floor", F.least(F.col("n"), F.greatest(F.floor(F.col("n") * F.lit(float(ratio))), F.lit(at_least)))))
    total, granted, open_rows = floors.agg(F.sum("n"), F.sum("_floor"), F.sum(F.col("n") - F.col("_floor"))).first()
    spare = max(0, int((total or 0) * ratio) - (granted or 0))
    share = (F.col("n") - F.col("_floor")) * spare / F.lit(float(max(1, open_rows or 0)))
    extra = _rounded(floors.withColumn("share", share), label, spare, rows_per_block)
    return extra.withColumn("quota", F.col("_floor") + F.col("quota")).drop("_floor")


def sample_stratified_min(df: DataFrame, ident: str, label: str, ratio: float, at_least: int, seed: str = "0") -> DataFrame:
    return _take(df, ident, label, minimum_quotas(class_counts(df, label), label, ratio, at_least), seed)


def sample_systematic(df: DataFrame, order: Sequence[str], ratio: float, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Every int(1/ratio)-th row in ``order``, starting with the first."""
    step = max(1, int(1 / ratio))
    return number(df, order, name="_rn", rows_per_block=rows_per_block).where((F.col("_rn") - 1) % step == 0).drop("_rn")


def split_train_test(df: DataFrame, ident: str, label: str, test_size: float = 0.2, seed: str = "0", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``split``; stratified unless a class has a single row."""
    counts = cut_lineage(class_counts(df, label))
    total, least = _sums(counts)
    n_test = math.ceil(total * test_size)
    quotas, keys = (n_test, []) if least < 2 else (proportional_quotas(counts, label, n_test, rows_per_block), [label])
    marked = mark_quota(df, ident, seed, quotas, keys)
    return marked.withColumn("split", F.when(F.col("_in"), "test").otherwise("train")).select(*df.columns, "split")


def split_reuse(df: DataFrame, stored: DataFrame, ident: str) -> DataFrame:
    """A stored split wins over the new one; an id stored more than once counts as train if it ever was."""
    kept = stored.groupBy(ident).agg(F.max("split").alias("_stored"))
    return null_safe_join(df, kept, [ident], "left").withColumn("split", F.coalesce("_stored", "split")).drop("_stored")


def sample_batch(df: DataFrame, ident: str, size: int, seed: str = "0") -> DataFrame:
    """``size`` random rows, or all if there are fewer."""
    return mark_quota(df, ident, seed, size).where("_in").drop("_in")


# --- folds: (fold, role, id) ----------------------------------------------------------------

def _roles(tested: DataFrame, ident: str, k: int, val_size: float, test_size: float, seed: str, rows_per_block: int) -> DataFrame:
    """Roles from a table (id, _test_fold): test where the fold matches, then the first shuffled train
    rows validate. Train sizes are k numbers."""
    n_by_fold = {r["_test_fold"]: r["n"] for r in tested.groupBy("_test_fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(n_by_fold.values())
    cut = [int((n - n_by_fold.get(f, 0)) * val_size / (1 - test_size)) for f in range(k)]
    spread = tested.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    is_test = F.col("fold") == F.col("_test_fold")
    test = spread.where(is_test).select("fold", F.lit("test").alias("role"), ident)
    train = _ranked(spread.where(~is_test), ident, seed, ["fold"], rows_per_block=rows_per_block)
    role = F.when(F.col("_rk") <= F.get(F.lit(cut), F.col("fold")), "val").otherwise("train")
    return train.select("fold", role.alias("role"), ident).unionByName(test)


def kfold_stratified(df: DataFrame, ident: str, label: str, k: int = 5, val_size: float = 0.1, test_size: float = 0.2,
                     seed: str = "0", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per-class fold sizes differ by at most one."""
    ranked = _ranked(df.select(ident, label), ident, seed, [label], rows_per_block=rows_per_block)
    tested = ranked.select(ident, ((F.col("_rk") - 1) % k).cast("int").alias("_test_fold"))
    return _roles(tested, ident, k, val_size, test_size, f"{seed}v", rows_per_block)


def kfold_plain(df: DataFrame, ident: str, order: Sequence[str], k: int = 5, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Contiguous folds; the first n mod k are one row larger. Returns (id, fold)."""
    n = df.count()
    small, extra = divmod(n, k)
    at = number(df.select(*dict.fromkeys([ident, *order])), order, name="_rn", rows_per_block=rows_per_block)
    i = F.col("_rn") - 1
    head = extra * (small + 1)
    fold = F.when(i < head, F.floor(i / (small + 1))).otherwise(extra + F.floor((i - head) / max(small, 1)))
    return at.select(ident, fold.cast("int").alias("fold"))


def kfold_time(df: DataFrame, ident: str, order: Sequence[str], k: int = 5, val_size: float = 0.1, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Expanding window: fold i tests the (i+1)-th of k+1 slices, validates on the tail of its past."""
    n = df.count()
    size = n // (k + 1)
    starts = [n - (k - f) * size for f in range(k)]
    vals = [s - int(s * val_size) for s in starts]
    at = number(df.select(*dict.fromkeys([ident, *order])), order, name="_rn", rows_per_block=rows_per_block)
    spread = at.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    i, start = F.col("_rn") - 1, F.get(F.lit(starts), F.col("fold"))
    role = F.when((i >= start) & (i < start + size), "test").when((i >= F.get(F.lit(vals), F.col("fold"))) & (i < start), "val").when(i < start, "train")
    return spread.select("fold", role.alias("role"), ident).where("role is not null")


def split_table(df: DataFrame, ident: str, label: str, kind: str = "node", order: Sequence[str] = (), k: int = 5, **options) -> DataFrame:
    """(fold, role, id, label) for split kinds node / time / graph (rows are then graphs)."""
    folds = kfold_time(df, ident, order, k, **options) if kind == "time" else kfold_stratified(df, ident, label, k, **options)
    return folds.join(df.select(ident, label), ident)


def fold_subgraph(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", ident: str = "id") -> DataFrame:
    """Edges with both ends among ``nodes``; self loops of the nodes when there is none."""
    ids = nodes.select(ident).distinct()
    inside = with_both_ends(edges.select(src, dst), ids, src, dst, ident)
    if inside.isEmpty():
        return ids.select(F.col(ident).alias(src), F.col(ident).alias(dst))
    return inside.select(src, dst)


def cv_aggregate(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean and population std of each metric over folds: (metric, mean, std)."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return results.select(F.inline(cells)).groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
