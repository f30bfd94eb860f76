"""Per-flow features: gaps, forward counts, minute aggregates, rolling views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.plans.ordered import ROWS_PER_BLOCK, neighbours, number, row_halo, running_sums
from flowhelm.plans.skew import HOT_ROWS, hot_keys, null_safe_join, salted_join

FORWARD_SECONDS = (1, 5, 10, 30, 60)
MICROS = 1_000_000

# The default flow feature names of the CIC flow format.
CIC_FEATURES = [
    "Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets",
    "Total Length of Bwd Packets", "Fwd Packet Length Max", "Fwd Packet Length Min", "Fwd Packet Length Mean",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean", "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
]


def time_delta(df: DataFrame, entity: str, t_us: str, ident: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Seconds since the entity's previous flow; -1 for its first."""
    prev = neighbours(df, [t_us, ident], previous={"_prev": t_us}, keys=[entity], rows_per_block=rows_per_block)
    gap = (F.col(t_us) - F.col("_prev")) / F.lit(float(MICROS))
    return prev.withColumn("time_delta", F.coalesce(gap, F.lit(-1.0))).drop("_prev")


def forward_counts(
    df: DataFrame, entity: str, t_us: str, sizes: Sequence[int] = FORWARD_SECONDS, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Flows of the same entity in ``[t, t+w]`` for every w in seconds, the row itself included.

    Beyond one block of rows the counts are differences of running counts: the totals of every
    (entity, t) and a probe at the end of each of its frames are put in one order, which is summed in
    blocks, so a hot entity or a busy second spreads over as many tasks as it needs.
    """
    names = {w: f"count_{w}s" for w in sizes}
    if df.count() <= rows_per_block:
        w0 = Window.partitionBy(entity).orderBy(t_us)
        return df.withColumns({n: F.count(F.lit(1)).over(w0.rangeBetween(0, w * MICROS)) for w, n in names.items()})
    totals = df.groupBy(entity, t_us).agg(F.count(F.lit(1)).alias("_n"))
    ends = F.array(*[F.struct(F.lit(w).alias("_w"), (F.col(t_us) + w * MICROS).alias("_at"), F.lit(0).cast("long").alias("_add")) for w in sizes])
    event = F.array(F.struct(F.lit(-1).alias("_w"), F.col(t_us).alias("_at"), F.col("_n").alias("_add")))
    points = totals.select(entity, t_us, F.inline(F.concat(event, ends)))  # events come before the probes of their time
    summed = running_sums(points, ["_at", "_w", t_us], {"_c": F.col("_add")}, [entity], rows_per_block)
    before = F.max(F.when(F.col("_w") == -1, F.col("_c") - F.col("_add")))
    counted = summed.groupBy(entity, t_us).agg(*[(F.max(F.when(F.col("_w") == w, F.col("_c"))) - before).alias(n) for w, n in names.items()])
    return null_safe_join(df, counted, [entity, t_us])


def time_delta_features(
    df: DataFrame, entity: str, t_us: str, ident: str, sizes: Sequence[int] = FORWARD_SECONDS, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """Gap to the previous flow and forward counts; both windows share one shuffle on the entity."""
    return forward_counts(time_delta(df, entity, t_us, ident, rows_per_block), entity, t_us, sizes, rows_per_block)


def minute(t_us: str) -> Column:
    return F.col(t_us) - F.pmod(F.col(t_us), F.lit(60 * MICROS))


def minute_agg(df: DataFrame, keys: Sequence[str], t_us: str, features: Sequence[str], prefix: str) -> DataFrame:
    """mean / max / min / sample std / count per keys and minute; partial aggregates absorb hot keys."""
    aggs = []
    for c in features:
        aggs += [
            F.avg(c).alias(f"{prefix}_{c}_mean"), F.max(c).alias(f"{prefix}_{c}_max"), F.min(c).alias(f"{prefix}_{c}_min"),
            F.stddev_samp(c).alias(f"{prefix}_{c}_std"), F.count(c).alias(f"{prefix}_{c}_count"),
        ]
    return df.withColumn("minute_us", minute(t_us)).groupBy(*keys, "minute_us").agg(*aggs)


def packet_features(df: DataFrame, src: str, dst: str, t_us: str, ident: str, features: Sequence[str] | None = None) -> DataFrame:
    """Flow rows with the minute aggregates of their source, destination and pair. Keys are counted on the flows alone, before any join, and
    only in tables where a key can be hot."""
    wanted = [c for c in (features or CIC_FEATURES) if c in df.columns]
    out = base = df.withColumn("minute_us", minute(t_us))
    many = base.count() > HOT_ROWS
    for prefix, keys in (("src", [src]), ("dst", [dst]), ("pair", [src, dst])):
        on = [*keys, "minute_us"]
        out = salted_join(out, minute_agg(df, keys, t_us, wanted, prefix), on, ident, "left", hot=hot_keys(base, on) if many else [])
    return out


def rolling(df: DataFrame, order: Sequence[str], before: int, aggs: dict[str, Column], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Aggregates over each row and its ``before`` predecessors in a global order."""
    if df.count() <= rows_per_block:
        w = Window.orderBy(*order).rowsBetween(-before, 0)
        return df.withColumns({k: c.over(w) for k, c in aggs.items()})
    cut = row_halo(number(df, order, name="_rn", rows_per_block=rows_per_block), "_rn", before, 0, rows_per_block)
    w = Window.partitionBy("_blk").orderBy("_rn").rowsBetween(-before, 0)
    return cut.withColumns({k: c.over(w) for k, c in aggs.items()}).where("_own").drop("_rn", "_blk", "_own")


def recent_view(df: DataFrame, order: Sequence[str], score: str, window_size: int, threshold: float, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Highest score and number of alerts among the last ``window_size`` scores up to each row."""
    alerts = F.sum((F.col(score) > threshold).cast("long"))
    return rolling(df, order, window_size, {"recent_max": F.max(score), "recent_alerts": alerts}, rows_per_block)
