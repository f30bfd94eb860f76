"""When nodes appear, act and go idle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sightings(edges: DataFrame, src: str = "src", dst: str = "dst", t_us: str = "t_us") -> DataFrame:
    """One row per edge endpoint."""
    return edges.select(F.explode(F.array(src, dst)).alias("id"), F.col(t_us).alias("t_us"))


def lifecycle(seen: DataFrame, *more: Column) -> DataFrame:
    """First and last sighting and their number per node; ``more`` aggregates come from the same pass."""
    return seen.groupBy("id").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.count(F.lit(1)).alias("activity"), *more)


def bucket_members(seen: DataFrame, size_us: int) -> DataFrame:
    """Distinct (bucket, node); the pair key spreads both hot nodes and hot buckets."""
    return seen.select(F.floor(F.col("t_us") / size_us).alias("bucket"), "id").distinct()


def nodes_per_bucket(seen: DataFrame, size_us: int) -> DataFrame:
    return bucket_members(seen, size_us).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_nodes"))


def nodes_in_window(seen: DataFrame, start_us: int, end_us: int, size_us: int) -> DataFrame:
    """Nodes seen in a bucket touching the window whose life overlaps it; one pass over sightings."""
    bucket = F.floor(F.col("t_us") / size_us)
    touched = bucket.between(start_us // size_us, end_us // size_us)
    per_node = seen.groupBy("id").agg(
        F.min("t_us").alias("first_us"), F.max("t_us").alias("last_us"), F.bool_or(touched).alias("_touched")
    )
    return per_node.where(F.col("_touched") & (F.col("first_us") <= end_us) & (F.col("last_us") >= start_us)).drop("_touched")


def active_nodes(seen: DataFrame, now_us: int, lookback_us: int, size_us: int) -> DataFrame:
    return nodes_in_window(seen, now_us - lookback_us, now_us, size_us)


def is_active(ids: DataFrame, life: DataFrame, now_us: int, lookback_us: int) -> DataFrame:
    """Flag per asked id; unknown ids are inactive."""
    flag = F.coalesce(F.lit(now_us) - F.col("last_us") <= lookback_us, F.lit(False))
    return ids.join(life, "id", "left").select("id", flag.alias("active"))


def activity_span(ids: DataFrame, life: DataFrame) -> DataFrame:
    return ids.join(life, "id", "left").select("id", "first_us", "last_us", "activity", (F.col("last_us") - F.col("first_us")).alias("span_us"))


def remove_nodes(life: DataFrame, gone: DataFrame) -> DataFrame:
    return life.join(gone.select("id").distinct(), "id", "left_anti")


def tracked_nodes(all_ids: DataFrame, inactive: DataFrame) -> DataFrame:
    return all_ids.select("id").subtract(inactive.select("id"))


def time_points(seen: DataFrame) -> DataFrame:
    return seen.select("t_us").distinct()


def rebucket(seen: DataFrame, old_size_us: int, new_size_us: int) -> DataFrame:
    """Bucket sizes that change by more than half rebuild the buckets from first sightings."""
    if new_size_us <= 0:
        raise ValueError("bucket size must be positive")
    if abs(new_size_us - old_size_us) / old_size_us <= 0.5:
        return bucket_members(seen, old_size_us)
    first = lifecycle(seen).select("id", F.col("first_us").alias("t_us"))
    return bucket_members(first, new_size_us)


def bucket_cleanup(seen: DataFrame, size_us: int, max_window_us: int) -> DataFrame:
    """Bucket membership without buckets that ended before the longest window."""
    last = seen.agg(F.max("t_us")).first()[0]
    members = bucket_members(seen, size_us)
    return members if last is None else members.where(F.col("bucket") >= (last - max_window_us) // size_us)


def statistics(seen: DataFrame, now_us: int, lookback_us: int, size_us: int) -> DataFrame:
    """One row of totals from per-node lives plus the bucket count."""
    life = lifecycle(seen)
    idle = F.lit(now_us) - F.col("last_us") > lookback_us
    totals = life.agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if(~idle).alias("active_nodes"), F.count_if(idle).alias("inactive_nodes"),
        F.min("first_us").alias("earliest_us"), F.max("last_us").alias("latest_us"),
    )
    n_buckets = seen.select(F.floor(F.col("t_us") / size_us).alias("b")).distinct().agg(F.count(F.lit(1)).alias("n_buckets"))
    return totals.withColumn("n_buckets", n_buckets.scalar())
