"""Exact ordered operations that keep every task small, whatever the key distribution.

A window partitioned by a hot key (or by nothing) sorts all its rows in one task. The functions
here cut the sorted order into blocks of bounded size instead, work inside each block, and repair
the block edges with a table that has at most one row per block. Inputs that fit into a single
block use the plain window. Results do not depend on where the cuts fall.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowhelm.plans.skew import null_safe_join
from flowhelm.session import cut_lineage

ROWS_PER_BLOCK = 2_000_000
MAX_BLOCKS = 65_536
TOP_K_ROWS = 100_000
_SAMPLES_PER_BLOCK = 8
_STEPS = [1 << b for b in range(16, -1, -1)]


def _block_count(df: DataFrame, rows_per_block: int, rows: int | None = None) -> tuple[int, int]:
    rows = df.count() if rows is None else rows
    return rows, min(MAX_BLOCKS, math.ceil(rows / rows_per_block))


def cut_rows(
    df: DataFrame, order: Sequence[str], payload: Sequence[str] = (), rows_per_block: int = ROWS_PER_BLOCK, rows: int | None = None
) -> list[Row]:
    """Rows that cut the order into blocks, from a row sample of fixed expected size; only they reach
    the driver. ``rows`` saves the count when the caller knows it. Empty when one block is enough."""
    rows, wanted = _block_count(df, rows_per_block, rows)
    if wanted <= 1:
        return []
    fraction = min(1.0, wanted * _SAMPLES_PER_BLOCK / rows)
    step = max(1, round(rows * fraction / wanted))
    columns = list(dict.fromkeys([*order, *payload]))
    return (
        df.select(*columns).sample(fraction, seed=11)
        .limit(2 * MAX_BLOCKS * _SAMPLES_PER_BLOCK)
        .withColumn("_r", F.row_number().over(Window.orderBy(*order)))
        .where(F.col("_r") % step == 0)
        .select(*columns).distinct().orderBy(*order).collect()
    )


def place(df: DataFrame, order: Sequence[str], cuts: list[Row], after_cut: bool = False) -> DataFrame:
    """Add ``_blk``, the number of cuts at or before a row (with ``after_cut``: strictly before it),
    by binary search in an array that a scalar subquery provides once."""
    point = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
    schema = T.StructType([T.StructField("c", T.ArrayType(point))])
    table = df.sparkSession.createDataFrame([([tuple(c[k] for k in order) for c in cuts],)], schema)
    here = F.struct(*[F.col(c) for c in order])

    def descend(low: Column, step_: Column) -> Column:
        cut = F.get(F.col("_cuts"), low + step_ - 1)
        return F.when(F.coalesce(cut < here if after_cut else cut <= here, F.lit(False)), low + step_).otherwise(low)

    search = F.aggregate(F.array(*[F.lit(s) for s in _STEPS if s <= 2 * len(cuts)]), F.lit(0), descend)
    return df.withColumn("_cuts", table.scalar()).withColumn("_blk", search).drop("_cuts")


def blocks(df: DataFrame, order: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK, rows: int | None = None) -> tuple[DataFrame, int]:
    """Add ``_blk``: the range of the total order by ``order`` a row falls into; and their number."""
    cuts = cut_rows(df, order, (), rows_per_block, rows)
    return (place(df, order, cuts) if cuts else df.withColumn("_blk", F.lit(0))), len(cuts) + 1


def running_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, Column],
    keys: Sequence[str] = (),
    rows_per_block: int = ROWS_PER_BLOCK,
    largest: bool = False,
    rows: int | None = None,
) -> DataFrame:
    """Inclusive running sums (or, with ``largest``, running maxima) over rows, per ``keys``, in
    ``order`` (which must be a total order)."""
    fold = F.max if largest else F.sum
    full = [*keys, *order]
    placed, n = blocks(df, full, rows_per_block, rows)
    if n == 1:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return placed.drop("_blk").withColumns({k: fold(c).over(w) for k, c in sums.items()})
    w = Window.partitionBy("_blk", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumns({k: fold(c).over(w) for k, c in sums.items()})
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    # A block continues at most one key of earlier blocks, so this table has <= one row per block.
    carry = (
        placed.groupBy("_blk", *keys).agg(*[fold(c).alias(f"_s_{k}") for k, c in sums.items()])
        .withColumns({f"_c_{k}": fold(f"_s_{k}").over(before) for k in sums} | {"_p": F.count(F.lit(1)).over(before)})
        .where("_p > 0")
        .select("_blk", *[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_c_{k}" for k in sums], F.lit(True).alias("_hit"))
    )
    joined = local.join(F.broadcast(carry), "_blk", "left")
    same = F.coalesce(F.col("_hit"), F.lit(False))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    if largest:
        out = {k: F.greatest(F.col(k), F.when(same, F.col(f"_c_{k}"))) for k in sums}
    else:
        out = {k: F.col(k) + F.when(same, F.coalesce(F.col(f"_c_{k}"), F.lit(0))).otherwise(F.lit(0)) for k in sums}
    drop = ["_blk", "_hit", *[f"_k_{k}" for k in keys], *[f"_c_{k}" for k in sums]]
    return joined.withColumns(out).drop(*drop)


def number(
    df: DataFrame,
    order: Sequence[str],
    keys: Sequence[str] = (),
    name: str = "rn",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """1-based position of every row inside its key (or overall)."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}, keys, rows_per_block)


def top_rows(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows: a top-k while k is small, else exact numbering in blocks."""
    if k <= TOP_K_ROWS:
        return df.orderBy(*order).limit(k)
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order)))
    return number(keyed, names, name="_rn").where(F.col("_rn") <= k).drop("_rn", *names)


def neighbours(
    df: DataFrame,
    order: Sequence[str],
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    keys: Sequence[str] = (),
    rows_per_block: int = ROWS_PER_BLOCK,
    rows: int | None = None,
) -> DataFrame:
    """Value of a column in the previous / following row of the same key: ``{new name: column}``."""
    previous, following = previous or {}, following or {}
    if previous and following:
        first = neighbours(df, order, previous, None, keys, rows_per_block, rows)
        return neighbours(first, order, None, following, keys, rows_per_block, rows)
    wanted, shift = (previous, F.lag) if previous else (following, F.lead)
    full = [*keys, *order]
    cuts = cut_rows(df, full, list(wanted.values()), rows_per_block, rows)
    if not cuts:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({k: shift(c).over(w) for k, c in wanted.items()})
    # Blocks end (for following: begin) with their cut row, so the row across an edge is a known cut.
    placed = place(df, full, cuts, after_cut=bool(previous))
    w = Window.partitionBy("_blk", *keys).orderBy(*order)
    local = placed.withColumns({k: shift(c).over(w) for k, c in wanted.items()} | {"_inside": shift(F.lit(True)).over(w)})
    row = T.StructType([df.schema[c] for c in dict.fromkeys([*full, *wanted.values()])])
    offset = 1 if previous else 0
    edges = df.sparkSession.createDataFrame(
        [(i + offset, tuple(c[f] for f in row.names)) for i, c in enumerate(cuts)],
        T.StructType([T.StructField("_blk", T.IntegerType()), T.StructField("_edge", row)]))
    joined = local.join(F.broadcast(edges), "_blk", "left")
    across = F.col("_inside").isNull() & F.col("_edge").isNotNull()
    for k in keys:
        across = across & F.col("_edge").getField(k).eqNullSafe(F.col(k))
    fixed = {k: F.when(across, F.col("_edge").getField(c)).otherwise(F.col(k)) for k, c in wanted.items()}
    return joined.withColumns(fixed).drop("_blk", "_inside", "_edge")


def row_halo(df: DataFrame, rn: str, before: int, after: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Blocks of consecutive ``rn`` plus copies of the rows a fixed row frame reaches across edges.

    Adds ``_blk`` and ``_own``; run the frame over ``_blk`` ordered by ``rn``, keep ``_own`` rows.
    """
    size = max(rows_per_block, before, after, 1)
    own = F.floor((F.col(rn) - 1) / size)
    pos = F.col(rn) - 1 - own * size
    targets = F.array_compact(F.array(
        own,
        F.when(pos >= size - before, own + 1),
        F.when((pos < after) & (own > 0), own - 1),
    ))
    return df.withColumn("_home", own).withColumn("_blk", F.explode(targets)) \
        .withColumn("_own", F.col("_blk") == F.col("_home")).drop("_home")


def hash_number(
    df: DataFrame,
    hash_col: str,
    keys: Sequence[str] = (),
    name: str = "rn",
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Like :func:`number` for an order by an md5 text: uniform, so the cut points need no sample.
    Null hashes come first and null keys are a key of their own."""
    _, n = _block_count(df, rows_per_block)
    if n <= 1:
        w = Window.partitionBy(*keys).orderBy(hash_col)
        return df.withColumn(name, F.row_number().over(w).cast("long"))
    prefix = F.conv(F.substring(hash_col, 1, 6), 16, 10).cast("long")
    placed = df.withColumn("_blk", F.coalesce(F.floor(prefix * n / (1 << 24)), F.lit(-1)))
    w = Window.partitionBy("_blk", *keys).orderBy(hash_col)
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_blk", *keys).agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = placed.withColumn(name, F.row_number().over(w).cast("long"))
    return null_safe_join(numbered, sizes, ["_blk", *keys]).withColumn(name, F.col(name) + F.col("_off")).drop("_blk", "_off")


def percentiles(
    df: DataFrame,
    value: str,
    ps: Sequence[float],
    keys: Sequence[str] = (),
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Exact linear-interpolated percentiles as ``(keys, p, value)`` rows; nulls are skipped.

    Works on value counts with a blocked running sum; no task sees all distinct values of a key.
    """
    counts = cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")))
    cum = running_sums(counts, [value], {"_cum": F.col("_n")}, keys, rows_per_block)
    if keys:
        cum = null_safe_join(cum, counts.groupBy(*keys).agg(F.sum("_n").alias("_total")), list(keys))
    else:
        cum = cum.withColumn("_total", F.lit(counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]))
    spread = cum.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps])))
    at = F.col("p") * (F.col("_total") - 1)

    def covers(i: Column) -> Column:
        return (F.col("_cum") - F.col("_n") <= i) & (F.col("_cum") > i)

    low, high = F.floor(at), F.ceil(at)
    picked = spread.where(covers(low) | covers(high)).groupBy(*keys, "p").agg(
        F.max(F.when(covers(low), F.col(value))).cast("double").alias("_lo"),
        F.max(F.when(covers(high), F.col(value))).cast("double").alias("_hi"),
        F.max(at - low).alias("_w"),
    )
    return picked.select(*keys, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")).alias("value"))


def percentile_row(df: DataFrame, value: str, ps: dict[str, float], rows_per_block: int = ROWS_PER_BLOCK) -> dict[str, float | None]:
    """Percentiles of one column as driver scalars (one number per requested p)."""
    got = {r["p"]: r["value"] for r in percentiles(df, value, list(ps.values()), (), rows_per_block).collect()}
    return {k: got.get(float(p)) for k, p in ps.items()}
