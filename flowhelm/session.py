"""Session helpers: settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


ARROW_BYTES = 12 << 20


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowhelm")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings results depend on (time zone) or plans need (AQE skew handling, batches for
    Python bounded in bytes, as rows may be long texts)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only in local mode."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="flowhelm-"))
        current = sc._jsc.sc().getCheckpointDir()
    return current.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_STORED: list[str] = []


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cut lineage that keeps columns apart and survives
    lost executors. :func:`release` removes these tables."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _STORED.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def _remove(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in paths:
        path = hadoop(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        _STORED.remove(name)


def discard(table: DataFrame) -> None:
    """Remove a table that :func:`stored` returned, when nothing reads it any more."""
    _remove(table.sparkSession, [p for p in _STORED if p == table._stored_at])


def release(spark: SparkSession) -> None:
    """Remove what :func:`stored` has written so far; call it when the results built on it are written."""
    _remove(spark, list(_STORED))


def store_result(result: Callable[[], DataFrame], name: str, spark: SparkSession, done: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """Work out ``result`` and store it; the tables that were stored on the way go, and those at the paths ``done``. The table and its path."""
    before = set(_STORED)
    table = stored(result(), name)
    kept = _STORED[-1]
    _remove(spark, [p for p in _STORED if (p not in before and p != kept) or p in done])
    return table, kept


def cut_lineage(df: DataFrame) -> DataFrame:
    """The table behind reliable storage: later steps restart from there, also after executor loss, and read only the columns they need."""
    return stored(df, "cut")
