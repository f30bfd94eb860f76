"""Structured Streaming jobs: windows, keyed state, retention, joins, incremental graphs.

Each job runs what is available and stops; a service would keep the same query with a processing-time
trigger. Micro-batch results are written below ``_batch=<id>`` and overwrite themselves on a retry.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowhelm.plans.reach import near_in_packs, packed
from flowhelm.session import scratch_path
from flowhelm.streaming.state import admitted, on_disk

TIMEOUT_S = 1800
CELLS = 64


def stream_source(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Parquet (or with ``fmt`` CSV, JSON) files as they arrive; oldest first, optionally a few per micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**options).format(fmt).load(path)


def _finish(query) -> None:
    if not query.awaitTermination(TIMEOUT_S):
        query.stop()
        raise TimeoutError("streaming job did not finish")


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    where = checkpoint or scratch_path(stream.sparkSession, "checkpoint")
    _finish(stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", where).trigger(availableNow=True).start())


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return write


def run_appended(stream: DataFrame, path: str, fmt: str = "parquet", checkpoint: str | None = None) -> None:
    """Append-only file sink with exactly-once bookkeeping."""
    where = checkpoint or scratch_path(stream.sparkSession, "checkpoint")
    _finish(stream.writeStream.outputMode("append").format(fmt).option("path", path).option("checkpointLocation", where).trigger(availableNow=True).start())


def run_updates(stream: DataFrame, keys: Sequence[str], path: str | None = None) -> DataFrame:
    """Run an updating aggregate; returns the newest row per key."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "updates")
    run_batches(stream, write_batch(path), "update")
    return newest_rows(spark.read.parquet(path), keys)


def windowed(stream: DataFrame, ts: str, size: str, step: str | None = None, delay: str = "24 hours", value: str = "value") -> DataFrame:
    """Count and highest score per tumbling (or, with ``step``, sliding) window."""
    w = F.window(ts, size, step) if step else F.window(ts, size)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max(value).alias("top")).select(F.unix_micros("w.start").alias("start_us"), "n", "top")


def activity_sessions(stream: DataFrame, key: str, ts: str, idle: str, delay: str) -> DataFrame:
    """Lives of a key that end after ``idle`` without events. The state of a life is dropped, and the
    life emitted, once the watermark passes its end; a later event starts a new life."""
    alive = stream.withWatermark(ts, delay).groupBy(key, F.session_window(ts, idle).alias("w"))
    return alive.agg(F.count(F.lit(1)).alias("n")).select(key, F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def first_edges(stream: DataFrame) -> DataFrame:
    """The winning edge of each (src, dst): the earliest by time, then id, whatever the order of arrival. Its state is
    one row per pair; partial minima precede it, so a hot pair sends one row per task."""
    first = F.min(F.struct("t_us", "flow_id"))
    return stream.groupBy("src", "dst").agg(first.alias("w")).select("src", "dst", "w.t_us", "w.flow_id")


def proximity_join(stream: DataFrame, other: DataFrame, within_s: int, delay: str = "1 hour", sub_cells: int = 4, salts: int = 1) -> DataFrame:
    """Pairs of events at most ``within_s`` apart, earlier first. The equi key is a cell of time, ``CELLS / sub_cells`` times the reach wide; an event
    goes to its cell, and as an earlier one to the next when its reach ends there. The events of a cell that come in one micro-batch travel as one row
    of lists sorted by time, which is one row of join state; rows of lists that can hold pairs meet, and the pairs are found by binary search.

    The time bounds let Spark drop join state behind the watermark; a row of lists is as late as its last event, so events up to a cell older
    than the watermark may still be taken. As nothing splits a crowded cell of a stream at run time, cells can be made narrower (``sub_cells``), and the
    events of the later side dealt to ``salts`` parts; the lists of the earlier side then go to all of them."""
    reach = within_s * 1_000_000
    width = max(1, CELLS * reach // sub_cells)
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cell, salt = F.floor(at / width), F.pmod(F.xxhash64("flow_id"), F.lit(salts)).cast("int")

    def packs(rows: DataFrame) -> DataFrame:
        lists = "".join(f", {n} array<{kind}>" for n, kind in rows.dtypes[2:])
        return rows.repartition("cell", "salt").mapInArrow(packed(), f"cell long, salt int, lo long, hi long{lists}").withColumn("ts", F.timestamp_micros("hi"))

    timed = "ts IS NOT NULL"
    a = packs(stream.where(timed).select(F.explode(F.sequence(cell, F.floor((at + reach) / width))).alias("cell"), F.lit(0).alias("salt"), at.alias("at_us"), F.col("flow_id").alias("id")))
    if salts > 1:
        a = a.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    b = packs(other.where(timed).select(cell.alias("cell"), salt.alias("salt"), at.alias("at_us"), F.col("flow_id").alias("id"), F.col("t_us").alias("us")))
    a = a.withWatermark("ts", delay).select("cell", "salt", *(F.col(n).alias(f"a_{n}") for n in ("lo", "hi", "ts")), F.col("at_us").alias("a_at"), F.col("id").alias("a_id"))
    b = b.withWatermark("ts", delay).select(
        "cell", "salt", *(F.col(n).alias(f"b_{n}") for n in ("lo", "hi", "ts")), F.col("at_us").alias("b_at"), F.col("id").alias("b_id"), F.col("us").alias("b_us"))
    apart = f"INTERVAL {width + reach} MICROSECONDS"  # of the ends of two rows with a pair, at most: one spans a cell, an earlier one its reach as well
    near = f"b_ts >= a_ts - {apart} AND b_ts <= a_ts + {apart} AND b_hi >= a_lo AND b_lo <= a_hi + {reach}L"
    kinds = {"src": stream.schema["flow_id"].dataType, "dst": other.schema["flow_id"].dataType, "t_us": other.schema["t_us"].dataType}
    met = a.join(b, ["cell", "salt"]).where(F.expr(near)).select("a_at", "a_id", "b_at", "b_id", "b_us")
    return met.mapInArrow(near_in_packs(reach, list(kinds)), T.StructType([T.StructField(n, kind) for n, kind in kinds.items()])).where("src != dst")


def grow_graph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, store: str) -> None:
    """Grow a stored graph by what has arrived: nodes (id) are registered, edges (src, dst, t_us, flow_id) between registered nodes
    are kept (``<store>/admitted``), others refused; then the winning edge of each pair, the first to arrive (``<store>/edges``), and the totals of each
    node (``<store>/nodes``) follow from what is new. All three are streaming queries with keyed state of their own, so a
    micro-batch reads what it touches and no stored table; called again, they go on where they stopped."""
    with on_disk(spark):
        run_appended(admitted(nodes, edges), f"{store}/admitted", checkpoint=f"{store}/checkpoint/admitted")
        news = stream_source(spark, f"{store}/admitted", "src string, dst string, t_us long, flow_id long, arrival_us long")
        won = news.groupBy("src", "dst").agg(F.min(F.struct("arrival_us", "t_us", "flow_id")).alias("w")).select("src", "dst", "w.t_us", "w.flow_id")
        run_batches(won, write_batch(f"{store}/edges"), "update", f"{store}/checkpoint/edges")
        ends = news.select(F.explode(F.array("src", "dst")).alias("id"), "t_us").groupBy("id").agg(F.max("t_us").alias("last_us"), F.count(F.lit(1)).alias("activity"))
        run_batches(ends, write_batch(f"{store}/nodes"), "update", f"{store}/checkpoint/nodes")


def newest_rows(saved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the last micro-batch (``_batch``) per key."""
    value = [c for c in saved.columns if c not in keys and c != "_batch"]
    return saved.groupBy(*keys).agg(F.max_by(F.struct(*value), "_batch").alias("v")).select(*keys, "v.*")


def temporal_graph(spark: SparkSession, store: str) -> DataFrame:
    """The stored edges with the last activity of both ends."""
    lives = newest_rows(spark.read.parquet(f"{store}/nodes"), ["id"]).select("id", "last_us")
    edges = newest_rows(spark.read.parquet(f"{store}/edges"), ["src", "dst"])
    return edges.join(lives.toDF("src", "src_last_us"), "src").join(lives.toDF("dst", "dst_last_us"), "dst")


def retention_batches(spark: SparkSession, store: str, keep_us: int, day_us: int = 86_400_000_000) -> Callable[[DataFrame, int], None]:
    """A step that stores edges by day (and below it by micro-batch, so that a retry overwrites its own rows) and forgets: days that lie wholly
    behind ``keep_us`` before the newest edge are removed from the store. Only the names of the stored days are listed."""

    def step(batch: DataFrame, number: int) -> None:
        placed = batch.withColumns({"day": F.floor(F.col("t_us") / day_us), "_batch": F.lit(number)})
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "_batch").parquet(store)
        saved = spark.read.parquet(store)
        top = saved.where(F.col("day") == saved.agg(F.max("day")).first()[0]).agg(F.max("t_us")).first()[0]
        if top is None:
            return
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(store).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in fs.globStatus(path(f"{store}/day=*")) or []:
            if part.getPath().getName().split("=")[1].lstrip("-").isdigit() and int(part.getPath().getName().split("=")[1]) < (top - keep_us) // day_us:
                fs.delete(part.getPath(), True)

    return step
