"""Queries for sampling, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions.scalar import r6
from flowhelm.operators import sampling as P

_RANK = "row_number() OVER (ORDER BY md5(concat(flow_id,'|','{s}'))) AS rk"
_LRANK = "row_number() OVER (PARTITION BY label ORDER BY md5(concat(flow_id,'|','{s}'))) AS rk"
_COUNTS = "cc AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM flow GROUP BY label)"


def _flows(spark, sf):
    return V.flow(spark, sf).select("flow_id", "t_us", "label")


def _shares(total: str) -> str:
    """Largest-remainder quotas of ``total`` rows in SQL."""
    return f"""{_COUNTS}, sh AS (SELECT label, c, CAST({total} AS BIGINT) AS total, c*CAST({total} AS BIGINT)/n::DOUBLE AS share FROM cc),
    qq AS (SELECT label, floor(share) + CASE WHEN row_number() OVER (ORDER BY share-floor(share) DESC, c DESC, label) <= total - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM sh)"""


@query("sample_random", f"SELECT flow_id, t_us, label FROM (SELECT *, {_RANK.format(s='r1')} FROM flow) WHERE rk <= (SELECT count(*)*3//10 FROM flow)", "flow")
def _(spark, sf):
    return P.sample_random(_flows(spark, sf), "flow_id", 0.3, "r1")


@query("sample_stratified", f"WITH {_shares('floor(n*0.25)')} SELECT flow_id, t_us, f.label FROM (SELECT *, {_LRANK.format(s='s1')} FROM flow) f JOIN qq USING (label) WHERE rk <= quota", "flow")
def _(spark, sf):
    return P.sample_stratified(_flows(spark, sf), "flow_id", "label", 0.25, "s1")


@query("sample_stratified_min", f"""WITH {_COUNTS}, fl AS (SELECT label, c, n, least(c, greatest(floor(c*0.33::DOUBLE), 50)) AS q FROM cc),
    sp AS (SELECT *, greatest(0, floor(n*0.33::DOUBLE) - sum(q) OVER ()) AS spare, greatest(1, sum(c - q) OVER ()) AS open_rows FROM fl),
    sh AS (SELECT *, (c - q)*spare/open_rows::DOUBLE AS share FROM sp),
    qq AS (SELECT label, q + floor(share) + CASE WHEN row_number() OVER (ORDER BY share-floor(share) DESC, c DESC, label) <= spare - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM sh)
    SELECT flow_id, t_us, f.label FROM (SELECT *, {_LRANK.format(s='m1')} FROM flow) f JOIN qq USING (label) WHERE rk <= quota""", "flow")
def _(spark, sf):
    return P.sample_stratified_min(_flows(spark, sf), "flow_id", "label", 0.33, 50, "m1")


@query("sample_systematic", "SELECT flow_id, t_us, label FROM (SELECT *, row_number() OVER (ORDER BY flow_id) AS rn FROM flow) WHERE (rn-1) % 6 = 0", "flow")
def _(spark, sf):
    return P.sample_systematic(_flows(spark, sf), ["flow_id"], 0.15)


_SPLIT = f"{_shares('ceil(n*0.2)')}, sp AS (SELECT flow_id, CASE WHEN rk <= quota THEN 'test' ELSE 'train' END AS split FROM (SELECT *, {_LRANK.format(s='t1')} FROM flow) f JOIN qq USING (label))"


@query("split_train_test", f"WITH {_SPLIT} SELECT flow_id, split FROM sp", "flow")
def _(spark, sf):
    return P.split_train_test(_flows(spark, sf), "flow_id", "label", 0.2, "t1").select("flow_id", "split")


@query("split_train_test_nulls", f"WITH {_SPLIT.replace('FROM flow', 'FROM lab').replace('USING (label)', 'ON f.label IS NOT DISTINCT FROM qq.label').replace('ORDER BY share-floor(share) DESC, c DESC, label)', 'ORDER BY share-floor(share) DESC, c DESC, label NULLS LAST)').replace('cc AS', 'lab AS (SELECT flow_id, CASE WHEN flow_id % 5 > 0 THEN label END AS label FROM flow), cc AS')} SELECT flow_id, split FROM sp", "flow")
def _(spark, sf):
    """Rows without a label are split like a class of their own."""
    lab = _flows(spark, sf).withColumn("label", F.when(F.col("flow_id") % 5 > 0, F.col("label")))
    return P.split_train_test(lab, "flow_id", "label", 0.2, "t1").select("flow_id", "split")


@query("split_reuse", f"WITH {_SPLIT} SELECT flow_id, coalesce(CASE WHEN y = 1 THEN 'test' END, split) AS split FROM sp JOIN flow USING (flow_id)", "flow")
def _(spark, sf):
    new = P.split_train_test(_flows(spark, sf), "flow_id", "label", 0.2, "t1").select("flow_id", "split")
    stored = V.flow(spark, sf).where("y = 1").select("flow_id", F.lit("test").alias("split"))
    return P.split_reuse(new, stored, "flow_id")


@query("sample_batch", f"WITH {_SPLIT} SELECT flow_id FROM sp WHERE split = 'test' ORDER BY md5(concat(flow_id,'|b1')) LIMIT 500", "flow")
def _(spark, sf):
    test = P.split_train_test(_flows(spark, sf), "flow_id", "label", 0.2, "t1").where("split = 'test'").select("flow_id")
    return P.sample_batch(test, "flow_id", 500, "b1")


def _roles(source: str, ident: str, label: str, seed: str, k: int = 5) -> str:
    return f"""tf AS (SELECT {ident}, CAST((row_number() OVER (PARTITION BY {label} ORDER BY md5(concat({ident},'|{seed}'))) - 1) % {k} AS INT) AS tfold FROM {source}),
    ex AS (SELECT {ident}, tfold, CAST(fold AS INT) AS fold FROM tf, (SELECT unnest(range({k})) AS fold)),
    nt AS (SELECT fold, floor(count(*)*0.1::DOUBLE/(1-0.2::DOUBLE)) AS nval FROM ex WHERE fold <> tfold GROUP BY fold),
    roles AS (SELECT fold, 'test' AS role, {ident} FROM ex WHERE fold = tfold UNION ALL
      SELECT fold, CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY md5(concat({ident},'|{seed}v'))) <= nval THEN 'val' ELSE 'train' END, {ident} FROM ex JOIN nt USING (fold) WHERE fold <> tfold)"""


@query("kfold_stratified", f"WITH {_roles('flow', 'flow_id', 'label', 'k1')} SELECT * FROM roles", "flow")
def _(spark, sf):
    return P.kfold_stratified(_flows(spark, sf), "flow_id", "label", 5, seed="k1")


@query("kfold_plain", "SELECT flow_id, CAST(CASE WHEN i < (n%7)*(n//7+1) THEN i//(n//7+1) ELSE n%7 + (i-(n%7)*(n//7+1))//(n//7) END AS INT) AS fold FROM (SELECT flow_id, row_number() OVER (ORDER BY flow_id)-1 AS i, count(*) OVER () AS n FROM flow)", "flow")
def _(spark, sf):
    return P.kfold_plain(_flows(spark, sf), "flow_id", ["flow_id"], 7)


_TIME = """SELECT fold, CASE WHEN i >= st THEN 'test' WHEN i >= st - floor(st*0.1::DOUBLE) THEN 'val' ELSE 'train' END AS role, flow_id FROM (
    SELECT flow_id, CAST(fold AS INT) AS fold, i, n//6 AS size, n-(5-fold)*(n//6) AS st FROM (SELECT flow_id, row_number() OVER (ORDER BY t_us, flow_id)-1 AS i, count(*) OVER () AS n FROM flow), (SELECT unnest(range(5)) AS fold)) WHERE i < st+size"""


@query("kfold_time", _TIME, "flow")
def _(spark, sf):
    return P.kfold_time(_flows(spark, sf), "flow_id", ["t_us", "flow_id"], 5)


def _days(spark, sf):
    """One graph per day, labelled by whether a fifth of its flows are errors."""
    day = F.floor(F.col("t_us") / 86_400_000_000).alias("graph_id")
    return V.flow(spark, sf).groupBy(day).agg((F.sum("y") * 5 >= F.count(F.lit(1))).cast("int").alias("label"))


@query("kfold_graph", f"WITH days AS (SELECT t_us//86400000000 AS graph_id, CAST(sum(y)*5 >= count(*) AS INT) AS label FROM flow GROUP BY 1), {_roles('days', 'graph_id', 'label', 'g1', 3)} SELECT * FROM roles", "flow")
def _(spark, sf):
    return P.kfold_stratified(_days(spark, sf), "graph_id", "label", 3, seed="g1")


_TRAIN0 = f"WITH {_roles('node', 'id', 'label', 'f1')}, keep AS (SELECT id FROM roles WHERE fold = 0 AND role = 'train')"


@query("fold_subgraph", _TRAIN0 + " SELECT src, dst FROM edge WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)", "edge node")
def _(spark, sf):
    folds = P.kfold_stratified(V.node(spark, sf).select("id", "label"), "id", "label", 5, seed="f1")
    return P.fold_subgraph(V.edge(spark, sf), folds.where("fold = 0 and role = 'train'"))


@query("fold_subgraph_loops", _TRAIN0 + " SELECT id AS src, id AS dst FROM keep", "edge node")
def _(spark, sf):
    """No edge links two destinations to each other: the self-loop branch."""
    folds = P.kfold_stratified(V.node(spark, sf).select("id", "label"), "id", "label", 5, seed="f1")
    return P.fold_subgraph(V.edge(spark, sf).where("src = dst"), folds.where("fold = 0 and role = 'train'"))


for _kind, _sql in (("node", f"WITH {_roles('flow', 'flow_id', 'label', 'k1')} SELECT roles.*, label FROM roles JOIN flow USING (flow_id)"), ("time", f"SELECT r.*, label FROM ({_TIME}) r JOIN flow USING (flow_id)")):
    def _table(spark, sf, kind=_kind):
        opts = {} if kind == "time" else {"seed": "k1"}
        return P.split_table(_flows(spark, sf), "flow_id", "label", kind, ["t_us", "flow_id"], **opts)
    query(f"split_table_{_kind}", _sql, "flow")(_table)


@query("cv_aggregate", f"""WITH {_roles('(SELECT flow_id, y AS label FROM multi)', 'flow_id', 'label', 'c1')}, r AS (SELECT fold, avg(CAST(y=pred AS INT)) AS accuracy, count(*)::DOUBLE AS tested FROM roles JOIN multi USING (flow_id) WHERE role='test' GROUP BY fold)
    SELECT 'accuracy' AS metric, round(avg(accuracy),6)+0.0 AS mean, round(stddev_pop(accuracy),6)+0.0 AS std FROM r UNION ALL SELECT 'tested', round(avg(tested),6)+0.0, round(stddev_pop(tested),6)+0.0 FROM r""", "multi")
def _(spark, sf):
    m = V.multi(spark, sf)
    folds = P.kfold_stratified(m, "flow_id", "y", 5, seed="c1").where("role = 'test'")
    per = folds.join(m, "flow_id").groupBy("fold").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"), F.count(F.lit(1)).cast("double").alias("tested"))
    return P.cv_aggregate(per, ["accuracy", "tested"]).withColumns({"mean": r6("mean"), "std": r6("std")})
