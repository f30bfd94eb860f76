"""The canonical input views, once for Spark and once as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def flow(spark: SparkSession, sf: str) -> DataFrame:
    """One row per network flow."""
    return table(spark, sf, "events").select(
        F.col("event_id").alias("flow_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.col("user_id").alias("src"),
        F.get_json_object("props", "$.k").cast("long").alias("dst"),
        F.col("value").alias("bytes"),
        F.col("event_type").alias("label"),
        (F.col("event_type") == "error").cast("int").alias("y"),
    )


def edge(spark: SparkSession, sf: str) -> DataFrame:
    """Temporal edges: text node ids, one row per flow."""
    return flow(spark, sf).select(
        "flow_id",
        F.concat(F.lit("s"), F.col("src").cast("string")).alias("src"),
        F.concat(F.lit("d"), F.col("dst").cast("string")).alias("dst"),
        "t_us", "bytes",
    )


def node(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes: edge endpoints with an embedding, first/last time and a label."""
    e = edge(spark, sf)
    ends = e.select(F.explode(F.array("src", "dst")).alias("id"), "t_us")
    seen = ends.groupBy("id").agg(F.min("t_us").alias("first_us"), F.max("t_us").alias("ts"))
    emb = table(spark, sf, "embeddings")
    n = emb.count()
    num = F.substring("id", 2, 18).cast("long")
    return (
        seen.withColumn("vec_id", num % F.lit(n))
        .join(emb.select("vec_id", F.col("label"), F.col("embedding").cast("array<double>").alias("feat")), "vec_id")
        .select("id", "feat", "first_us", "ts", F.col("label").cast("int").alias("label"))
    )


def ip(spark: SparkSession, sf: str) -> DataFrame:
    f = flow(spark, sf)
    kind = F.col("src") % 4
    first = F.when(kind == 0, "10").when(kind == 1, "192").when(kind == 2, "172").otherwise("8")
    second = F.when(kind == 1, "168").when(kind == 2, "16").otherwise((F.col("src") % 256).cast("string"))
    text = F.concat_ws(".", first, second, (F.col("src") % 256).cast("string"), (F.col("flow_id") % 256).cast("string"))
    return f.select("flow_id", "bytes", F.when(F.col("flow_id") % 97 == 0, "not-an-ip").otherwise(text).alias("src_ip"))


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with planted nulls, infinities, a constant column and missing text."""
    li = table(spark, sf, "lineitem")
    s = F.col("l_orderkey") + F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.when(s % 13 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(s % 34 == 0, F.lit(float("inf"))).when(s % 17 == 0, F.lit(float("-inf"))).otherwise(F.col("l_tax")).alias("l_tax"),
        F.lit(7).alias("konst"),
        F.lit(None).cast("string").alias("empty_text"),
        F.when(s % 11 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus",
    )


NUM_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "qty_copy"]


def num(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric line item columns, a correlated copy and a three-class label."""
    return table(spark, sf, "lineitem").select(
        F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax"),
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
        (2 * F.col("l_quantity") + 0.01 * F.col("l_linenumber")).alias("qty_copy"),
        F.col("l_returnflag").alias("label"),
    )


def score(spark: SparkSession, sf: str) -> DataFrame:
    """Binary scores with ties: growing in the whole length of a text, rounded."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    l = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y"))
    return l.join(d, "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), F.round(F.col("n_chars") / (F.col("n_chars") + F.lit(5000.0)), 2).alias("p"))


CLASSES = ["click", "error", "purchase", "signup", "view"]


def multi(spark: SparkSession, sf: str, rows_per_block: int | None = None) -> DataFrame:
    """Five-class predictions: the user's previous event type predicts the current one."""
    from flowhelm.plans.ordered import ROWS_PER_BLOCK, neighbours

    f = flow(spark, sf).select("flow_id", "t_us", "src", "label")
    code = F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("label")).cast("int") - 1
    coded = f.withColumn("y", code)
    prev = neighbours(coded, ["t_us", "flow_id"], previous={"prev": "y"}, keys=["src"], rows_per_block=rows_per_block or ROWS_PER_BLOCK)
    pred = F.coalesce(F.col("prev"), F.lit(0))
    hit = F.lit(0.6) + F.lit(0.001) * (F.col("flow_id") % 100)
    rest = (F.lit(1.0) - hit) / F.lit(4.0)
    probs = F.array(*[F.when(pred == i, hit).otherwise(rest) for i in range(len(CLASSES))])
    return prev.select("flow_id", "y", pred.alias("pred"), probs.alias("probs"))


def emb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


# The same views for the oracle; each may use the ones listed before it.
SQL: dict[str, tuple[str, str]] = {
    "flow": ("", """SELECT event_id AS flow_id, epoch_us(ts) AS t_us, user_id AS src,
        CAST(json_extract_string(props,'$.k') AS BIGINT) AS dst, value AS bytes, event_type AS label,
        CAST(event_type='error' AS INT) AS y FROM events"""),
    "edge": ("flow", "SELECT flow_id, 's'||src AS src, 'd'||dst AS dst, t_us, bytes FROM flow"),
    "node": ("flow edge", """SELECT id, CAST(embedding AS DOUBLE[]) AS feat, first_us, s.ts AS ts, CAST(label AS INT) AS label
        FROM (SELECT id, min(t_us) AS first_us, max(t_us) AS ts FROM
            (SELECT src AS id, t_us FROM edge UNION ALL SELECT dst, t_us FROM edge) GROUP BY id) s
        JOIN embeddings m ON m.vec_id = CAST(substr(id,2) AS BIGINT) % (SELECT count(*) FROM embeddings)"""),
    "ip": ("flow", """SELECT flow_id, bytes, CASE WHEN flow_id % 97 = 0 THEN 'not-an-ip' ELSE
        CASE src % 4 WHEN 0 THEN '10' WHEN 1 THEN '192' WHEN 2 THEN '172' ELSE '8' END||'.'||
        CASE src % 4 WHEN 1 THEN '168' WHEN 2 THEN '16' ELSE CAST(src % 256 AS VARCHAR) END||'.'||(src % 256)||'.'||(flow_id % 256) END AS src_ip FROM flow"""),
    "dirty": ("", """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice,
        CASE WHEN (l_orderkey+l_linenumber) % 13 <> 0 THEN l_discount END AS l_discount,
        CASE WHEN (l_orderkey+l_linenumber) % 34 = 0 THEN 'inf'::DOUBLE WHEN (l_orderkey+l_linenumber) % 17 = 0 THEN '-inf'::DOUBLE ELSE l_tax END AS l_tax,
        7 AS konst, CAST(NULL AS VARCHAR) AS empty_text,
        CASE WHEN (l_orderkey+l_linenumber) % 11 <> 0 THEN l_returnflag END AS l_returnflag, l_linestatus FROM lineitem"""),
    "num": ("", """SELECT l_quantity, l_extendedprice, l_discount, l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber,
        2*l_quantity + 0.01*l_linenumber::DOUBLE AS qty_copy, l_returnflag AS label FROM lineitem"""),
    "numlong": ("num", """SELECT label, feature, value FROM num UNPIVOT (value FOR feature IN
        (l_quantity, l_extendedprice, l_discount, l_tax, l_linenumber, qty_copy))"""),
    "score": ("", """SELECT doc_id, CAST(quality AS INT) AS y, round(n_chars/(n_chars+5000.0::DOUBLE),2) AS p FROM labels JOIN documents USING (doc_id)"""),
    "multi": ("flow", """SELECT flow_id, y, pred, [CASE WHEN pred = i THEN hit ELSE (1.0::DOUBLE - hit)/4.0::DOUBLE END FOR i IN [0,1,2,3,4]] AS probs FROM (
        SELECT flow_id, y, CAST(coalesce(lag(y) OVER (PARTITION BY src ORDER BY t_us, flow_id), 0) AS INT) AS pred,
            0.6::DOUBLE + 0.001::DOUBLE * (flow_id % 100) AS hit FROM (
            SELECT *EXCLUDE(y), CAST(list_position(['click','error','purchase','signup','view'], label) AS INT) - 1 AS y FROM flow))"""),
    "emb": ("", "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"),
    "gapn": ("flow", """SELECT t_us, flow_id, g, row_number() OVER (ORDER BY t_us, flow_id) AS rn FROM (
        SELECT t_us, flow_id, (t_us - lag(t_us) OVER (ORDER BY t_us, flow_id))/1000000.0::DOUBLE AS g FROM flow) WHERE g IS NOT NULL"""),
    "gst": ("gapn", """SELECT count(*) AS n, min(g) AS lo, max(g) AS hi, avg(g) AS mean, stddev_pop(g) AS std,
        quantile_cont(g,0.25) AS q1, quantile_cont(g,0.5) AS med, quantile_cont(g,0.75) AS q3 FROM gapn"""),
    "acx": ("gapn gst", "SELECT rn + k AS j, k, g - mean AS x FROM gapn, gst, (SELECT unnest(range(1,101)) AS k) WHERE k <= least(n//3,100)"),
    "acf": ("acx gst", """SELECT CAST(k AS INT) AS lag, sum(x*(b.g-mean))/((max(n)-k)*max(std)*max(std)) AS r FROM acx JOIN gapn b ON b.rn = j, gst GROUP BY k"""),
    "per": ("acf gst", """SELECT coalesce(min(lag) * max(med), 0.0::DOUBLE) AS period FROM (SELECT lag, r, lag(r) OVER (ORDER BY lag) AS r0, lead(r) OVER (ORDER BY lag) AS r1 FROM acf), gst
        WHERE r > r0 AND r > r1 AND r > 0.2"""),
    "dv": ("gapn", "SELECT g AS v, count(*) AS n FROM gapn GROUP BY g"),
    "dcore": ("dv gst", """SELECT a.v, max(a.n) AS n, sum(b.n) >= 5 AS core FROM dv a JOIN gst ON true JOIN dv b ON b.v BETWEEN a.v - (med/2 + 1) AND a.v + (med/2 + 1) AND abs(b.v - a.v) <= med/2 GROUP BY a.v"""),
    "dcl": ("dcore gst", """SELECT v, CAST(sum(CASE WHEN v - prev <= med/2 THEN 0 ELSE 1 END) OVER (ORDER BY v) - 1 AS BIGINT) AS c FROM (SELECT v, lag(v) OVER (ORDER BY v) AS prev FROM dcore WHERE core), gst"""),
    "burst": ("gst dcl", "SELECT n >= 10 AND (std/mean > 2 OR (n >= 50 AND (SELECT count(DISTINCT c) FROM dcl) >= 2)) AS bursty, n >= 10 AND hi > 10*q3 AS low_slow FROM gst"),
    "scales": ("gst per burst", """SELECT scale, size_s FROM (
        SELECT 'micro' AS scale, greatest(0.5::DOUBLE, lo)*f AS size_s FROM gst, burst, (SELECT unnest([1,2,5]) AS f) WHERE lo < 2 OR bursty
        UNION ALL SELECT 'small', greatest(2.0::DOUBLE, q1)*f FROM gst, burst, (SELECT unnest([1,2,5]) AS f) WHERE q1 < 30 OR bursty
        UNION ALL SELECT 'medium', greatest(10.0::DOUBLE, med) FROM gst UNION ALL SELECT 'medium', period FROM per WHERE period > 0
        UNION ALL SELECT 'large', greatest(60.0::DOUBLE, q3*2)*f FROM gst, burst, (SELECT unnest([1,2]) AS f) WHERE q3 > 60 OR low_slow
        UNION ALL SELECT 'macro', greatest(3600.0::DOUBLE, hi/2) FROM gst, burst WHERE hi > 3600 OR low_slow)"""),
    "rng": ("flow", "SELECT min(t_us) AS t0, max(t_us) AS t1 FROM flow"),
    "win": ("scales rng", """SELECT scale, size_s, t0::DOUBLE + i*(size_s*1000000.0::DOUBLE) AS start_us, CASE WHEN i = n-1 THEN greatest(t0::DOUBLE + i*(size_s*1000000.0::DOUBLE) + size_s*1000000.0::DOUBLE, t1::DOUBLE)
        ELSE t0::DOUBLE + i*(size_s*1000000.0::DOUBLE) + size_s*1000000.0::DOUBLE END AS end_us FROM (
        SELECT *, unnest(range(n)) AS i FROM (SELECT *, CAST(greatest(1, ceil((t1-t0)::DOUBLE/(size_s*1000000.0::DOUBLE))) AS BIGINT) AS n FROM scales, rng WHERE scale IN ('micro','medium','large')))"""),
    "winn": ("scales rng", """SELECT *, size_s*1000000.0::DOUBLE AS step, t0::DOUBLE + (n-1)*(size_s*1000000.0::DOUBLE) AS last_start, greatest(t0::DOUBLE + (n-1)*(size_s*1000000.0::DOUBLE) + size_s*1000000.0::DOUBLE, t1::DOUBLE) AS stop FROM (
        SELECT *, CAST(greatest(1, ceil((t1-t0)::DOUBLE/(size_s*1000000.0::DOUBLE))) AS BIGINT) AS n FROM scales, rng WHERE scale IN ('micro','medium','large'))"""),
    "wincap": ("scales rng", """SELECT scale, size_s, t0::DOUBLE + i*(size_s*1000000.0::DOUBLE) AS start_us, CASE WHEN i = n-1 THEN greatest(t0::DOUBLE + i*(size_s*1000000.0::DOUBLE) + size_s*1000000.0::DOUBLE, t1::DOUBLE)
        ELSE t0::DOUBLE + i*(size_s*1000000.0::DOUBLE) + size_s*1000000.0::DOUBLE END AS end_us FROM (
        SELECT *, unnest(range(n)) AS i FROM (SELECT *, CAST(greatest(1, least(ceil((t1-t0)::DOUBLE/(size_s*1000000.0::DOUBLE)), 100)) AS BIGINT) AS n FROM scales, rng WHERE scale IN ('micro','medium','large')))"""),
}


def with_views(names: list[str], body: str) -> str:
    """Prefix ``body`` with the named views and the ones they need."""
    needed: list[str] = []

    def add(n: str) -> None:
        for d in SQL[n][0].split():
            add(d)
        if n not in needed:
            needed.append(n)

    for n in names:
        add(n)
    body = body.strip()
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS MATERIALIZED ({SQL[n][1]})" for n in needed)
    if body[:15].upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
