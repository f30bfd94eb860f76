"""Queries for file sources and sinks: each writes given rows to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions.scalar import r6
from flowhelm.operators import attention as A
from flowhelm.operators import clean as C
from flowhelm.operators import sampling as P
from flowhelm.session import scratch_path
from flowhelm.sources import files as S

FLOW_DDL = "flow_id long, t_us long, src long, dst long, bytes double, label string"
_FLOW = "SELECT flow_id, t_us, src, dst, bytes, label FROM flow"


def _flow(spark, sf):
    return V.flow(spark, sf).drop("y")


def _csv(spark, sf, **options):
    path = scratch_path(spark, "csv")
    S.sink_csv_chunked(_flow(spark, sf), path, **options)
    return path


@query("scan_csv_dir", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT c_nationkey, c_mktsegment, CAST(c_custkey AS INT) FROM customer")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    V.table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path, header=True)
    V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("n_name"), F.col("c_custkey").cast("int").alias("n_regionkey")).write.mode("append").csv(path, header=True)
    return S.scan_csv_dir(spark, path)


@query("scan_csv_typed", _FLOW, "flow")
def _(spark, sf):
    return S.scan_csv_typed(spark, _csv(spark, sf), FLOW_DDL)


@query("scan_csv_permissive", "SELECT flow_id, CASE WHEN label = 'error' THEN NULL ELSE bytes END AS bytes, epoch_us(ts) AS ts_us FROM flow JOIN events ON event_id = flow_id", "flow")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    f = V.table(spark, sf, "events").select(F.col("event_id").alias("flow_id"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("bytes"),
                                            F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    f.write.csv(path, header=True)
    return S.scan_csv_permissive(spark, path, "flow_id long, bytes double, ts timestamp").select("flow_id", "bytes", F.unix_micros("ts").alias("ts_us"))


@query("scan_parquet", "SELECT o_orderkey, o_totalprice FROM orders")
def _(spark, sf):
    return S.scan_parquet(spark, [f"{sf}/orders.parquet"]).select("o_orderkey", "o_totalprice")


@query("union_files", "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("segment"))
    s = V.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("bal"), F.col("s_suppkey").alias("id"))
    return S.union_files([c, s])


@query("union_files_indexed", "SELECT row_number() OVER (ORDER BY src, pos) - 1 AS row_id, k AS key FROM (SELECT 1 AS src, row_number() OVER () AS pos, c_custkey AS k FROM customer UNION ALL SELECT 2, row_number() OVER (), s_suppkey FROM supplier)")
def _(spark, sf):
    """A fresh index by (file name, position in the file) over two files."""
    parts = [S.scan_parquet(spark, [f"{sf}/{t}.parquet"]).select(F.col(k).alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("pos"))
             for t, k in (("customer", "c_custkey"), ("supplier", "s_suppkey"))]
    return S.with_row_index(S.union_files(parts), ["file", "pos"]).select("row_id", "key")


@query("scan_skip_bad_files", "SELECT o_orderkey, o_custkey FROM orders")
def _(spark, sf):
    """One of the files is no Parquet file."""
    path = scratch_path(spark, "mixed")
    V.table(spark, sf, "orders").select("o_orderkey", "o_custkey").write.parquet(path)
    V.table(spark, sf, "region").select("r_name").coalesce(1).write.mode("append").text(path)
    return S.scan_skip_bad_files(spark, path, "o_orderkey long, o_custkey long")


@query("csv_to_parquet_cache", _FLOW, "flow")
def _(spark, sf):
    csv, cache = _csv(spark, sf), scratch_path(spark, "cache")
    S.csv_to_parquet_cache(spark, csv, cache, FLOW_DDL)
    return S.csv_to_parquet_cache(spark, csv, cache, FLOW_DDL)


@query("row_count_metadata", "SELECT (SELECT count(*) FROM lineitem) AS n_rows")
def _(spark, sf):
    return spark.createDataFrame([(S.row_count(spark, [f"{sf}/lineitem.parquet"]),)], "n_rows long")


@query("sink_csv_chunked", _FLOW, "flow")
def _(spark, sf):
    return S.scan_csv_typed(spark, _csv(spark, sf, rows_per_file=3000, compression="gzip"), FLOW_DDL)


@query("scan_csv_chunked", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    S.sink_csv_chunked(V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"), path, 10_000, "bzip2")
    return S.scan_csv_typed(spark, path, "l_orderkey long, l_linenumber int, l_extendedprice double, l_returnflag string")


def _saved(spark, sf):
    """Prepared flows with side tables: names, scaler, labels."""
    path = scratch_path(spark, "prepared")
    f = C.label_encode(_flow(spark, sf), "label", "flow_id")
    split = P.split_train_test(f, "flow_id", "label", 0.2, "t1")
    rows = C.assemble_features(split.select("flow_id", "src", "dst", "bytes", "split", "label_code"), "label_code", ["flow_id", "split"])
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["src", "dst", "bytes"])], "pos int, name string")
    S.save_prepared(path, rows.withColumnRenamed("flow_id", "row_id"), names=names, scaler=C.scaler_stats(f, ["src", "dst", "bytes"]), labels=C.label_map(f, "label_code", "label"))
    return path


_PREP = "SELECT flow_id AS row_id, dense_rank() OVER (ORDER BY label) - 1 AS target, CAST(src AS DOUBLE) AS src, CAST(dst AS DOUBLE) AS dst, CAST(CAST(bytes AS FLOAT) AS DOUBLE) AS bytes FROM flow"


def _flat(data):
    return data.select("row_id", "target", *[F.get("features", i).cast("double").alias(n) for i, n in enumerate(["src", "dst", "bytes"])])


@query("save_prepared", _PREP, "flow")
def _(spark, sf):
    return _flat(spark.read.parquet(f"{_saved(spark, sf)}/data"))


@query("load_prepared", _PREP, "flow")
def _(spark, sf):
    return _flat(S.load_prepared(spark, _saved(spark, sf), ("names", "scaler", "labels"))[0])


@query("sink_metrics_json", "SELECT round(avg(CAST(y=pred AS INT)),6)+0.0 AS accuracy, count(*) AS n FROM multi", "multi")
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    S.sink_json(V.multi(spark, sf).agg(r6(F.avg((F.col("y") == F.col("pred")).cast("double"))).alias("accuracy"), F.count(F.lit(1)).alias("n")), path)
    return spark.read.schema("accuracy double, n long").json(path)


@query("sink_history_json", "SELECT t_us//86400000000 AS epoch, round(avg(bytes),6)+0.0 AS loss, round(avg(y),6)+0.0 AS error_share FROM flow GROUP BY 1", "flow")
def _(spark, sf):
    path = scratch_path(spark, "history")
    h = V.flow(spark, sf).groupBy(F.floor(F.col("t_us") / 86_400_000_000).alias("epoch")).agg(r6(F.avg("bytes")).alias("loss"), F.struct(r6(F.avg("y")).alias("error_share")).alias("metrics"))
    S.sink_json(h, path)
    return spark.read.schema("epoch long, loss double, metrics struct<error_share: double>").json(path).select("epoch", "loss", "metrics.error_share")


@query("sink_predictions_csv", "SELECT flow_id AS row_id, pred AS prediction FROM multi", "multi")
def _(spark, sf):
    path = scratch_path(spark, "predictions")
    S.sink_predictions_csv(V.multi(spark, sf).select(F.col("flow_id").alias("row_id"), F.col("pred").alias("prediction")), path)
    return S.scan_csv_typed(spark, path, "row_id long, prediction int")


@query("sink_detections_json", "SELECT batch, score FROM (SELECT t_us // 600000000 AS batch, max(bytes)/100 AS score FROM flow GROUP BY 1) WHERE score > 0.95", "flow")
def _(spark, sf):
    path = scratch_path(spark, "detections")
    f = V.flow(spark, sf).select(F.floor(F.col("t_us") / 600_000_000).alias("batch"), (F.col("bytes") / 100).alias("p"))
    S.sink_detections_json(A.batch_alerts(f, "batch", "p", 0.95), path)
    return spark.read.schema("batch long, score double").json(path)
