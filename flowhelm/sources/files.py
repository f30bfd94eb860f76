"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowhelm.plans.ordered import ROWS_PER_BLOCK, number

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"


def scan_csv_dir(spark: SparkSession, path: str) -> DataFrame:
    """All visible ``*.csv`` below a folder, header row, inferred types."""
    return spark.read.option("header", True).option("inferSchema", True).option("pathGlobFilter", "*.csv*").csv(path)


def scan_csv_typed(spark: SparkSession, path: str | Sequence[str], schema: str) -> DataFrame:
    """CSV with given types; compressed files are recognised by suffix, large plain ones are split."""
    return spark.read.option("header", True).option("timestampFormat", TIMESTAMP_FORMAT).option("timestampNTZFormat", TIMESTAMP_FORMAT).schema(schema).csv(path)


def scan_csv_permissive(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cells that do not parse become null."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("timestampFormat", TIMESTAMP_FORMAT).option("timestampNTZFormat", TIMESTAMP_FORMAT).schema(schema).csv(path)


def scan_parquet(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*paths)


def union_files(frames: Sequence[DataFrame], strict: bool = False) -> DataFrame:
    """Rows of all frames; unless strict, columns missing in one become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=not strict)
    return out


def with_row_index(df: DataFrame, order: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """A fresh 0-based index in the order of e.g. (file, position)."""
    return number(df, order, name="row_id", rows_per_block=rows_per_block).withColumn("row_id", F.col("row_id") - 1)


def scan_parquet_indexed(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Parquet rows with an index by (file name, position in the file)."""
    df = spark.read.parquet(*paths).withColumns({"_file": F.col("_metadata.file_name"), "_at": F.col("_metadata.row_index")})
    return with_row_index(df, ["_file", "_at"]).drop("_file", "_at")


def scan_skip_bad_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Unreadable Parquet files are skipped; it is an error when nothing could be read."""
    df = spark.read.option("ignoreCorruptFiles", True).schema(schema).parquet(path)
    if df.isEmpty():
        raise ValueError(f"no readable file below {path}")
    return df


def csv_to_parquet_cache(spark: SparkSession, csv_path: str, cache_path: str, schema: str) -> DataFrame:
    """Parquet copy of a CSV source, written once and reused."""
    scan_csv_typed(spark, csv_path, schema).write.mode("ignore").option("compression", "snappy").parquet(cache_path)
    return spark.read.parquet(cache_path)


def row_count(spark: SparkSession, paths: Sequence[str]) -> int:
    """Rows of Parquet files; no column is read, only file footers."""
    return spark.read.parquet(*paths).count()


def sink_csv_chunked(df: DataFrame, path: str, rows_per_file: int = 10_000, compression: str = "none") -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("compression", compression).option("timestampNTZFormat", TIMESTAMP_FORMAT).csv(path, header=True)


def save_prepared(path: str, data: DataFrame, **parts: DataFrame) -> None:
    """Prepared rows (row_id, features, target, split) and their side tables."""
    data.write.mode("overwrite").parquet(f"{path}/data")
    for name, table in parts.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_prepared(spark: SparkSession, path: str, parts: Sequence[str] = ("names",)) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Read back with one validation pass: widths match the names, splits are known, ids are unique
    and complete. A missing part fails on reading."""
    tables = {p: spark.read.parquet(f"{path}/{p}") for p in parts}
    data = spark.read.parquet(f"{path}/data")
    width = tables["names"].count() if "names" in tables else None
    ok = F.lit(True) if width is None else F.size("features") == width
    bad = data.agg(
        F.count_if(~ok).alias("width"), F.count_if(~F.col("split").isin("train", "val", "test")).alias("split"),
        F.count_if(F.col("row_id").isNull() | F.col("target").isNull()).alias("missing"),
        (F.count("row_id") - (F.max("row_id") - F.min("row_id") + 1)).alias("ids")).first().asDict()
    if any(v for v in bad.values()):
        raise ValueError(f"prepared data at {path} is inconsistent: {bad}")
    return data, tables


def sink_json(df: DataFrame, path: str, single: bool = True) -> None:
    """JSON lines; metric tables have a few rows and go to one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def sink_predictions_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def sink_detections_json(df: DataFrame, path: str, alert: str = "alert") -> bool:
    """Write detections only when there is an attack; tells whether anything was written."""
    found = df.where(F.col(alert))
    if found.isEmpty():
        return False
    found.write.mode("overwrite").json(path)
    return True
