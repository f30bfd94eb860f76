"""Queries for cleaning, encoding and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions import ip as IP
from flowhelm.functions.scalar import r6
from flowhelm.operators import clean as C
from flowhelm.operators import select as S
from flowhelm.session import scratch_path

NUM = V.NUM_COLUMNS


@query("clean_column_names", 'SELECT l_orderkey AS l_orderkey, l_linenumber AS l_line_number, l_quantity AS l_quantity, l_tax AS l_quantity_2, l_discount AS l_quantity_3 FROM dirty', "dirty")
def _(spark, sf):
    d = V.dirty(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    return C.clean_column_names(d.toDF(" l_orderkey ", "l line number", "l-quantity", "l quantity", "l/quantity "))


@query("strip_column_names", 'SELECT l_orderkey, l_linenumber AS "line number", l_quantity FROM dirty', "dirty")
def _(spark, sf):
    return C.strip_column_names(V.dirty(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity").toDF(" l_orderkey", "line number ", " l_quantity "))


_DIRTY_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "konst", "empty_text", "l_returnflag", "l_linestatus"]
_DIRTY_FLOATS = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
_REPORT = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS n_null, {f'count(*) FILTER (isinf({c}))' if c in _DIRTY_FLOATS else '0'} AS n_inf FROM dirty""" for c in _DIRTY_COLS)


@query("null_inf_report", f"""WITH r AS ({_REPORT}) SELECT "column", n_null, CAST(n_inf AS BIGINT) AS n_inf FROM r UNION ALL SELECT 'total', CAST(sum(n_null) AS BIGINT), CAST(sum(n_inf) AS BIGINT) FROM r""", "dirty")
def _(spark, sf):
    return C.null_inf_report(V.dirty(spark, sf))


_FINITE_TAX = "CASE WHEN isinf(l_tax) THEN 0.0::DOUBLE ELSE l_tax END"


@query("impute_median", f"SELECT l_orderkey, l_linenumber, l_quantity, coalesce(l_discount, (SELECT median(l_discount) FROM dirty)) AS l_discount, coalesce(l_tax, (SELECT median(l_tax) FROM dirty)) AS l_tax FROM dirty", "dirty")
def _(spark, sf):
    return C.impute_median(V.dirty(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"))


@query("fill_missing_text", "SELECT l_orderkey, l_linenumber, l_quantity, coalesce(empty_text,'missing') AS empty_text, coalesce(l_returnflag,'missing') AS l_returnflag FROM dirty", "dirty")
def _(spark, sf):
    return C.fill_missing_text(V.dirty(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "empty_text", "l_returnflag"))


@query("replace_inf", f"SELECT l_orderkey, l_linenumber, l_discount, {_FINITE_TAX} AS l_tax FROM dirty", "dirty")
def _(spark, sf):
    return C.replace_inf(V.dirty(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax"))


@query("replace_inf_with_null", "SELECT l_orderkey, l_linenumber, l_discount, CASE WHEN NOT isinf(l_tax) THEN l_tax END AS l_tax FROM dirty", "dirty")
def _(spark, sf):
    return C.replace_inf(V.dirty(spark, sf).select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), None)


@query("impute_mode", """SELECT l_orderkey, l_linenumber, l_linestatus, coalesce(l_returnflag, (SELECT l_returnflag FROM dirty WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS l_returnflag FROM dirty""", "dirty")
def _(spark, sf):
    return C.impute_mode(V.dirty(spark, sf).select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag"), ["l_returnflag", "l_linestatus"])


@query("drop_constant_columns", "SELECT l_orderkey, l_linenumber, l_tax, l_returnflag, l_linestatus FROM dirty", "dirty")
def _(spark, sf):
    return C.drop_constant_columns(V.dirty(spark, sf).drop("l_quantity", "l_extendedprice", "l_discount"))


_PLAN = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CASE WHEN lo >= 0 THEN CASE WHEN hi < 255 THEN 'uint8' WHEN hi < 65535 THEN 'uint16' WHEN hi < 4294967295 THEN 'uint32' ELSE 'uint64' END "
    f"ELSE CASE WHEN lo >= -128 AND hi <= 127 THEN 'int8' WHEN lo >= -32768 AND hi <= 32767 THEN 'int16' WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 'int32' ELSE 'int64' END END AS narrow "
    f"FROM (SELECT min({e}) AS lo, max({e}) AS hi FROM dirty)"
    for c, e in (("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber"), ("konst", "konst"), ("balance", "l_linenumber - l_orderkey")))
_SPARK_TYPES = "CASE narrow WHEN 'uint8' THEN 'smallint' WHEN 'uint16' THEN 'int' WHEN 'uint32' THEN 'bigint' WHEN 'uint64' THEN 'decimal(20,0)' WHEN 'int8' THEN 'tinyint' WHEN 'int16' THEN 'smallint' WHEN 'int32' THEN 'int' WHEN 'int64' THEN 'bigint' ELSE 'float' END AS spark_type"


@query("downcast_plan", f"""SELECT "column", narrow, {_SPARK_TYPES} FROM ({_PLAN} UNION ALL SELECT 'l_tax', 'float32')""", "dirty")
def _(spark, sf):
    d = V.dirty(spark, sf).select("l_orderkey", "l_linenumber", "konst", (F.col("l_linenumber") - F.col("l_orderkey")).alias("balance"), "l_tax")
    return spark.createDataFrame(C.downcast_plan(d), "column string, narrow string, spark_type string")


@query("category_ratio", """SELECT "column", round(ratio,6)+0.0 AS ratio, ratio < 0.5 AS category FROM (SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus)/count(*) AS ratio FROM orders
    UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority)/count(*) FROM orders UNION ALL SELECT 'key_text', count(DISTINCT o_orderkey)/count(*) FROM orders)""")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string").alias("key_text"))
    return C.category_ratio(o).withColumn("ratio", r6("ratio"))


@query("identify_target", """WITH s AS (SELECT count(*) AS n, count(DISTINCT c_name) AS d1, count(DISTINCT c_nationkey) AS d2, max(c_nationkey)-min(c_nationkey) AS r2, count(DISTINCT c_mktsegment) AS d3 FROM customer),
    c AS (SELECT 'c_name' AS "column", d1 AS d, n, 5 AS score FROM s UNION ALL SELECT 'c_nationkey', d2, n, CASE WHEN r2 < 50 THEN 3 WHEN r2 < 200 THEN 1 ELSE 0 END FROM s UNION ALL SELECT 'c_mktsegment', d3, n, 5 FROM s)
    SELECT "column", score, row_number() OVER (ORDER BY score DESC) = 1 AS chosen FROM c WHERE d > 1 AND d < least(1000, n*0.1)""")
def _(spark, sf):
    c = V.table(spark, sf, "customer")
    best = C.identify_target(c)
    return C.target_candidates(c).withColumn("chosen", F.col("column") == best)


# --- IP columns -----------------------------------------------------------------------------

_V4 = IP.V4_PATTERN.replace("'", "''")
_OK = f"regexp_matches(src_ip, '{_V4}')"


def _oct(i: int) -> str:
    return f"CASE WHEN {_OK} THEN CAST(split_part(src_ip,'.',{i}) AS INT) ELSE -1 END"


_NUMBER = "(" + " + ".join(f"CAST(TRY_CAST(split_part(src_ip,'.',{i + 1}) AS INT) AS BIGINT)*{1 << (24 - 8 * i)}" for i in range(4)) + ")"


def _sub(bits: int) -> str:
    return f"CASE WHEN {_OK} THEN {_NUMBER} - {_NUMBER} % {1 << (32 - bits)} ELSE -1 END"


def _between(nets: list[str]) -> str:
    import ipaddress

    return "(" + " OR ".join(f"{_NUMBER} BETWEEN {int(n[0])} AND {int(n[-1])}" for n in map(ipaddress.ip_network, nets)) + ")"


_PRIV = f"({_OK} AND {_between(IP.PRIVATE_V4)} AND NOT {_between(IP.PRIVATE_V4_EXCEPT)})"
_GLOB = f"({_OK} AND NOT {_PRIV} AND NOT {_between(IP.SHARED_V4)})"
_OCTETS = ", ".join(f"{_oct(i)} AS src_ip_octet_{i}" for i in (1, 2, 3, 4))
_SUBNETS = ", ".join(f"CAST({_sub(b)} AS BIGINT) AS src_ip_subnet_{b}" for b in (8, 16, 24))
_FLAGS = f"CAST(coalesce({_PRIV},false) AS INT) AS src_ip_is_private, CAST(coalesce({_GLOB},false) AS INT) AS src_ip_is_global"


@query("detect_ip_columns", f"SELECT 'src_ip' AS \"column\", round(avg(CAST({_OK} AS INT)),6)+0.0 AS share FROM ip", "ip")
def _(spark, sf):
    d = V.ip(spark, sf).withColumn("script", F.lit("tcp"))
    return spark.createDataFrame(C.detect_ip_columns(d), "column string, share double").withColumn("share", r6("share"))


@query("ip_valid", f"SELECT flow_id, {_OK} AS valid FROM ip", "ip")
def _(spark, sf):
    return V.ip(spark, sf).select("flow_id", IP.ip_valid(F.col("src_ip")).alias("valid"))


def _ip_part(*parts):
    def run(spark, sf):
        return C.ip_features(V.ip(spark, sf).drop("bytes"), ["src_ip"], parts)
    return run


query("ip_octets", f"SELECT flow_id, {_OCTETS} FROM ip", "ip")(_ip_part("octet"))
query("ip_subnets", f"SELECT flow_id, {_SUBNETS} FROM ip", "ip")(_ip_part("subnet"))
query("ip_scope_flags", f"SELECT flow_id, {_FLAGS} FROM ip", "ip")(_ip_part("private", "global"))


@query("ip_features", f"SELECT flow_id, bytes, {_OCTETS}, {_SUBNETS}, {_FLAGS} FROM ip", "ip")
def _(spark, sf):
    return C.ip_features(V.ip(spark, sf), ["src_ip"])


@query("ip_feature_report", f"SELECT 'src_ip' AS \"column\", count(*) FILTER ({_OK}) AS valid, count(*) FILTER (NOT {_OK}) AS errors FROM ip", "ip")
def _(spark, sf):
    return C.ip_report(V.ip(spark, sf), ["src_ip"])


# --- codes and scaling ----------------------------------------------------------------------

@query("timestamp_to_epoch", "SELECT o_orderkey, epoch_us(o_orderdate)/1000000.0::DOUBLE AS epoch, epoch_us(o_orderdate)/1000000.0::DOUBLE AS from_ts FROM orders")
def _(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("txt"))
    return C.timestamp_to_epoch(C.timestamp_to_epoch(o, "txt", "o_orderkey"), "o_orderdate", "o_orderkey", "from_ts").select("o_orderkey", "epoch", "from_ts")


@query("timestamp_category_codes", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS epoch FROM orders")
def _(spark, sf):
    return C.timestamp_to_epoch(V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").select("o_orderkey", "epoch")


@query("category_codes", "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY l_returnflag NULLS LAST) - 1 END AS code FROM dirty", "dirty")
def _(spark, sf):
    return C.category_codes(V.dirty(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), "l_returnflag", "l_orderkey").drop("l_returnflag")


@query("factorize", "SELECT o_orderkey, code FROM orders JOIN (SELECT o_orderpriority, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS code FROM orders GROUP BY 1) USING (o_orderpriority)")
def _(spark, sf):
    return C.factorize(V.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey").drop("o_orderpriority")


@query("label_encode", "SELECT flow_id, dense_rank() OVER (ORDER BY label) - 1 AS label_code, CAST(y AS BIGINT) AS y_code FROM flow", "flow")
def _(spark, sf):
    f = V.flow(spark, sf).select("flow_id", "label", "y")
    return C.label_encode(C.label_encode(f, "label", "flow_id"), "y", "flow_id", "y_code").select("flow_id", "label_code", "y_code")


@query("label_map", "SELECT DISTINCT dense_rank() OVER (ORDER BY label) - 1 AS code, label FROM flow", "flow")
def _(spark, sf):
    return C.label_map(C.label_encode(V.flow(spark, sf).select("flow_id", "label"), "label", "flow_id"), "label_code", "label")


_FIN = {"l_discount": "coalesce(l_discount, 0.0::DOUBLE)", "l_tax": _FINITE_TAX, "l_quantity": "l_quantity", "konst": "konst::DOUBLE"}
_SCALED = ", ".join(f"round(({e} - avg({e}) OVER ()) / CASE WHEN stddev_pop({e}) OVER () = 0 THEN 1 ELSE stddev_pop({e}) OVER () END, 6)+0.0 AS {c}" for c, e in _FIN.items())


def _scale_input(spark, sf):
    return V.dirty(spark, sf).select("l_orderkey", "l_linenumber", *_FIN)


@query("standard_scale", f"SELECT l_orderkey, l_linenumber, {_SCALED} FROM dirty", "dirty")
def _(spark, sf):
    return C.standard_scale(_scale_input(spark, sf), list(_FIN)).withColumns({c: r6(c) for c in _FIN})


@query("scaler_stats", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({e}),6)+0.0 AS mean, round(CASE WHEN stddev_pop({e})=0 THEN 1 ELSE stddev_pop({e}) END,6)+0.0 AS std FROM dirty" for c, e in _FIN.items()), "dirty")
def _(spark, sf):
    return C.scaler_stats(_scale_input(spark, sf), list(_FIN)).withColumns({"mean": r6("mean"), "std": r6("std")})


@query("apply_saved_scaler", f"SELECT l_orderkey, l_linenumber, {_SCALED} FROM dirty", "dirty")
def _(spark, sf):
    path = scratch_path(spark, "scaler")
    d = _scale_input(spark, sf)
    C.scaler_stats(d, list(_FIN)).write.parquet(path)
    return C.apply_scaler(d, spark.read.parquet(path)).withColumns({c: r6(c) for c in _FIN})


@query("assemble_features", """SELECT flow_id, target, pos, CAST(value AS DOUBLE) AS value FROM (SELECT flow_id, y AS target, unnest([0,1,2]) AS pos, unnest([CAST(src AS FLOAT), CAST(dst AS FLOAT), CAST(bytes AS FLOAT)]) AS value FROM flow)""", "flow")
def _(spark, sf):
    f = V.flow(spark, sf).withColumnsRenamed({"t_us": "Timestamp"})
    return C.assemble_features(f, "y", ["flow_id"]).select("flow_id", "target", F.posexplode("features").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


@query("check_row_alignment", "SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS features_only, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS target_only")
def _(spark, sf):
    return C.row_alignment(V.table(spark, sf, "documents").select("doc_id"), V.table(spark, sf, "labels").select("doc_id"), "doc_id")


@query("class_distribution", "SELECT label, count(*) AS n FROM flow GROUP BY label", "flow")
def _(spark, sf):
    return C.class_distribution(V.flow(spark, sf), "label")


def _raw_flows(spark, sf):
    """Flow rows with an address column, gaps, an infinity, a constant and messy names."""
    f = V.flow(spark, sf).drop("y").join(V.ip(spark, sf).select("flow_id", "src_ip"), "flow_id")
    return f.select(
        "flow_id", "src_ip", F.col("dst").alias("dst port "), F.when(F.col("flow_id") % 13 != 0, F.col("bytes")).alias("flow bytes"),
        F.when(F.col("flow_id") % 17 == 0, F.lit(float("inf"))).otherwise(F.col("bytes") * 2).alias("rate"), F.lit(1).alias("konst"),
        F.when(F.col("dst") % 3 == 0, "tcp").when(F.col("dst") % 3 == 1, "udp").alias("proto"), "label")


def _z(e: str, c: str) -> str:
    return f"round(({e} - avg({e}) OVER ()) / CASE WHEN stddev_pop({e}) OVER () = 0 THEN 1 ELSE stddev_pop({e}) OVER () END, 6)+0.0 AS {c}"


_PIPE_COLS = {"dst_port": "dst::DOUBLE", "flow_bytes": "coalesce(fb, med)", "rate": "rate"}
_PIPE_IP = {f"src_ip_octet_{i}": _oct(i) for i in (1, 2, 3, 4)} | {f"src_ip_subnet_{b}": _sub(b) for b in (8, 16, 24)} | {
    "src_ip_is_private": f"CAST(coalesce({_PRIV},false) AS INT)", "src_ip_is_global": f"CAST(coalesce({_GLOB},false) AS INT)"}
_PIPE_SQL = f"""WITH raw AS (SELECT f.*, ip.src_ip, CASE WHEN flow_id % 13 <> 0 THEN f.bytes END AS fb, CASE WHEN flow_id % 17 = 0 THEN 0.0 ELSE f.bytes*2 END AS rate,
    CASE WHEN dst % 3 = 0 THEN 'tcp' WHEN dst % 3 = 1 THEN 'udp' ELSE 'missing' END AS proto FROM flow f JOIN ip USING (flow_id)),
    pc AS (SELECT proto, row_number() OVER (ORDER BY min(flow_id)) - 1 AS code FROM raw GROUP BY proto), med AS (SELECT median(fb) AS med FROM raw)
    SELECT flow_id, dense_rank() OVER (ORDER BY label) - 1 AS label, {', '.join(_z(e, c) for c, e in _PIPE_COLS.items())}, {', '.join(_z(f'({e})::DOUBLE', c) for c, e in _PIPE_IP.items())},
    {_z('code::DOUBLE', 'proto')} FROM raw JOIN pc USING (proto), med"""


@query("preprocess", _PIPE_SQL, "flow ip")
def _(spark, sf):
    out = C.preprocess(_raw_flows(spark, sf), "flow_id", "label", select_features=False)
    return out.withColumns({c: r6(c) for c in out.columns if c not in ("flow_id", "label")})


@query("preprocess_selected")
def _(spark, sf):
    """The same preparation with feature selection (its parts have their own SQL twins)."""
    return C.preprocess(_raw_flows(spark, sf), "flow_id", "label")


# --- feature selection ----------------------------------------------------------------------

_PAIRS = [(NUM[i], NUM[j]) for i in range(len(NUM)) for j in range(i + 1, len(NUM))]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({a},{b})) AS corr FROM num" for a, b in _PAIRS)


@query("corr_matrix", f"SELECT a, b, round(corr,6)+0.0 AS corr FROM ({_CORR})", "num")
def _(spark, sf):
    return S.corr_matrix(V.num(spark, sf), NUM).withColumn("corr", r6("corr"))


@query("drop_correlated", f"""WITH c AS ({_CORR}), v AS (SELECT feature, var_samp(value) AS v FROM numlong GROUP BY feature)
    SELECT DISTINCT CASE WHEN x.v <= y.v THEN a ELSE b END AS feature FROM c JOIN v x ON x.feature = a JOIN v y ON y.feature = b WHERE corr > 0.95""", "num numlong")
def _(spark, sf):
    return S.correlated_drops(V.num(spark, sf), NUM)


@query("variance_threshold", "SELECT feature, round(var_pop(value),6)+0.0 AS variance FROM numlong GROUP BY feature HAVING var_pop(value) <= 0.01", "numlong")
def _(spark, sf):
    return S.low_variance(V.num(spark, sf), NUM).withColumn("variance", r6("variance"))


_ANOVA = """g AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM numlong GROUP BY ALL),
    gm AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n*m)/sum(n) AS gm, sum(n*v) AS ssw FROM g GROUP BY feature),
    an AS (SELECT feature, (sum(g.n*(g.m-gm)*(g.m-gm))/(max(k)-1))/(max(ssw)/(max(gm.n)-max(k))) AS f, max(k)-1 AS df_between, CAST(max(gm.n)-max(k) AS BIGINT) AS df_within FROM g JOIN gm USING (feature) GROUP BY feature)"""


@query("anova_f", f"WITH {_ANOVA} SELECT feature, round(f,6)+0.0 AS f, df_between, df_within FROM an", "numlong")
def _(spark, sf):
    return S.anova_f(V.num(spark, sf), NUM, "label").withColumn("f", r6("f"))


@query("anova_p")
def _(spark, sf):
    """Upper F tail probability per feature (no SQL twin; tests compare with tabulated values)."""
    return S.anova_p(V.num(spark, sf), NUM, "label")


_MI = """bn AS (SELECT feature, label, (rank() OVER (PARTITION BY feature ORDER BY value) - 1) * 32 // count(*) OVER (PARTITION BY feature) AS bin FROM numlong),
    ce AS (SELECT feature, bin, label, count(*)/(SELECT count(*) FROM num)::DOUBLE AS p FROM bn GROUP BY ALL),
    mi AS (SELECT feature, sum(p*ln(p/(pb*pl))) AS mi FROM (SELECT *, sum(p) OVER (PARTITION BY feature, bin) AS pb, sum(p) OVER (PARTITION BY feature, label) AS pl FROM ce) GROUP BY feature)"""


@query("mutual_info", f"WITH {_MI} SELECT feature, round(mi,6)+0.0 AS mi FROM mi", "num numlong")
def _(spark, sf):
    return S.mutual_info(V.num(spark, sf), NUM, "label").withColumn("mi", r6("mi"))


@query("drop_insignificant")
def _(spark, sf):
    """Features with p > 0.05 and low mutual information (p has no SQL form)."""
    n = V.num(spark, sf)
    return S.insignificant(S.anova_p(n, NUM, "label"), S.mutual_info(n, NUM, "label"))


@query("feature_ranking", f"WITH {_ANOVA} SELECT feature, round(f,6)+0.0 AS f FROM an ORDER BY an.f DESC, feature LIMIT 3", "numlong")
def _(spark, sf):
    return S.feature_ranking(S.anova_f(V.num(spark, sf), NUM, "label").select("feature", "f"), "f", 3).withColumn("f", r6("f"))


@query("feature_selection")
def _(spark, sf):
    """(step, feature) report of the whole selection."""
    return S.feature_selection(V.num(spark, sf), "label")[1]
