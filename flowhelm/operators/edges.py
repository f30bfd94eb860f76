"""Temporal edge store: a multigraph table partitioned by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400 * 1_000_000


def append(edges: DataFrame, path: str, t_us: str = "t_us") -> None:
    """Append edges, duplicates kept. Clustered by day so a day is written by few tasks, split by
    time inside a busy day because AQE cuts skewed rebalance partitions."""
    days = edges.withColumn("day", F.floor(F.col(t_us) / DAY_US))
    days.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def group_by_time(edges: DataFrame, t_us: str = "t_us") -> DataFrame:
    """Number of edges per exact timestamp; the members stay rows (keyed by the timestamp)."""
    return edges.groupBy(t_us).agg(F.count(F.lit(1)).alias("n_edges"))


def in_window(edges: DataFrame, start_us: int, end_us: int, t_us: str = "t_us") -> DataFrame:
    """Edges with ``start <= t <= end``; on a stored table also prunes the day partitions."""
    out = edges.where(F.col(t_us).between(start_us, end_us))
    if "day" in edges.columns:
        out = out.where(F.col("day").between(start_us // DAY_US, end_us // DAY_US))
    return out


def max_time(edges: DataFrame, t_us: str = "t_us") -> int | None:
    """Newest time; on a stored table from its newest day alone."""
    if "day" in edges.columns:
        edges = edges.where(F.col("day") == edges.agg(F.max("day")).first()[0])
    return edges.agg(F.max(t_us)).first()[0]


def recent(edges: DataFrame, window_us: int, t_us: str = "t_us") -> DataFrame:
    """Edges of the last ``window_us`` microseconds; the bound is a literal the scan can push down."""
    last = max_time(edges, t_us)
    return edges.limit(0) if last is None else in_window(edges, last - window_us, last, t_us)


def expire(edges: DataFrame, threshold_us: int, t_us: str = "t_us") -> DataFrame:
    """Edges not older than a time; on a stored table older days are not read."""
    kept = edges.where(F.col(t_us) >= threshold_us)
    return kept.where(F.col("day") >= threshold_us // DAY_US) if "day" in edges.columns else kept


def expire_report(edges: DataFrame, threshold_us: int, t_us: str = "t_us") -> DataFrame:
    old = F.col(t_us) < threshold_us
    return edges.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept"))


def retention(edges: DataFrame, keep_us: int = DAY_US, t_us: str = "t_us") -> DataFrame:
    """Forget what is older than ``keep_us`` before the newest edge."""
    last = max_time(edges, t_us)
    return edges if last is None else expire(edges, last - keep_us, t_us)


def time_span(edges: DataFrame, t_us: str = "t_us") -> DataFrame:
    return edges.agg(F.min(t_us).alias("earliest_us"), F.max(t_us).alias("latest_us"))


def statistics(edges: DataFrame, keep_us: int, t_us: str = "t_us") -> DataFrame:
    """Totals over all edges, with those of the retention window counted as active."""
    last = max_time(edges, t_us)
    bound = F.lit(last).cast("long") - keep_us
    return edges.agg(
        F.count(F.lit(1)).alias("total_edges"),
        F.count_if(F.col(t_us) >= bound).alias("active_edges"),
        F.count_distinct(t_us).alias("distinct_times"),
        F.min(t_us).alias("earliest_us"),
        F.max(t_us).alias("latest_us"),
        (F.max(t_us) - F.min(t_us)).alias("span_us"),
    )
