"""Queries over detection scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.functions.scalar import r6
from flowhelm.operators import metrics as M

TARGETS = (0.9, 0.95, 0.99)


def _r(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


def _binary(spark, sf):
    return M.points(V.score(spark, sf))


def _classes(spark, sf):
    return M.points(M.one_vs_rest(V.multi(spark, sf)), cls="cls")


_CELLS = "cells AS (SELECT y, pred, count(*) AS n FROM multi GROUP BY ALL)"
_PER = """per AS (SELECT cls, CASE WHEN tp+fp=0 THEN 0.0::DOUBLE ELSE tp/(tp+fp)::DOUBLE END AS precision, CASE WHEN tp+fn=0 THEN 0.0::DOUBLE ELSE tp/(tp+fn)::DOUBLE END AS recall,
    CASE WHEN 2*tp+fp+fn=0 THEN 0.0::DOUBLE ELSE 2*tp/(2*tp+fp+fn)::DOUBLE END AS f1, tp+fn AS support FROM (
    SELECT cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM (
    SELECT y AS cls, CASE WHEN y=pred THEN n ELSE 0 END AS tp, 0 AS fp, CASE WHEN y<>pred THEN n ELSE 0 END AS fn FROM cells
    UNION ALL SELECT pred, 0, CASE WHEN y<>pred THEN n ELSE 0 END, 0 FROM cells) GROUP BY cls))"""
_AVG = ", ".join(f"avg({m}) AS {m}_macro, sum({m}*support)/sum(support) AS {m}_weighted" for m in ("precision", "recall", "f1"))
_AVG_R = ", ".join(f"round(avg({m}),6)+0.0 AS {m}_macro, round(sum({m}*support)/sum(support),6)+0.0 AS {m}_weighted" for m in ("precision", "recall", "f1"))
_REPORT = f"""SELECT CAST(cls AS VARCHAR) AS cls, metric, value FROM (SELECT cls, precision, recall, f1, support::DOUBLE AS support FROM per)
    UNPIVOT (value FOR metric IN (precision, recall, f1, support))
    UNION ALL SELECT 'all', metric, value FROM (SELECT {_AVG} FROM per) UNPIVOT (value FOR metric IN (precision_macro, precision_weighted, recall_macro, recall_weighted, f1_macro, f1_weighted))
    UNION ALL SELECT 'all', 'accuracy', sum(CASE WHEN y=pred THEN n ELSE 0 END)/sum(n)::DOUBLE FROM cells"""


def _cells(spark, sf):
    return M.counts(V.multi(spark, sf))


@query("accuracy", "SELECT round(avg(CAST(y=pred AS INT)),6)+0.0 AS accuracy FROM multi", "multi")
def _(spark, sf):
    return _r(M.accuracy(V.multi(spark, sf)), "accuracy")


@query("confusion_matrix", "SELECT a.c AS y, b.c AS pred, (SELECT count(*) FROM multi m WHERE m.y=a.c AND m.pred=b.c) AS n FROM (SELECT DISTINCT y AS c FROM multi UNION SELECT pred FROM multi) a, (SELECT DISTINCT y AS c FROM multi UNION SELECT pred FROM multi) b", "multi")
def _(spark, sf):
    return M.confusion_matrix(V.multi(spark, sf))


@query("precision_recall_f1", f"WITH {_CELLS}, {_PER} SELECT cls, round(precision,6)+0.0 AS precision, round(recall,6)+0.0 AS recall, round(f1,6)+0.0 AS f1, support FROM per", "multi")
def _(spark, sf):
    return _r(M.per_class(_cells(spark, sf)), "precision", "recall", "f1")


@query("macro_weighted_averages", f"WITH {_CELLS}, {_PER} SELECT {_AVG_R} FROM per", "multi")
def _(spark, sf):
    out = M.averages(_cells(spark, sf))
    return _r(out, *out.columns)


@query("classification_report", f"WITH {_CELLS}, {_PER} SELECT cls, metric, round(value,6)+0.0 AS value FROM ({_REPORT})", "multi")
def _(spark, sf):
    return _r(M.classification_report(_cells(spark, sf)), "value")


# Curve points in SQL, keyed by class; binary scores use class 0.
_SCORED = {"score": "scored AS (SELECT 0 AS cls, y, p FROM score)",
           "multi": "scored AS (SELECT CAST(i AS INT) AS cls, CAST(y = i AS INT) AS y, probs[i+1] AS p FROM multi, (SELECT unnest([0,1,2,3,4]) AS i))"}


def _pts(kind: str) -> str:
    return f"""WITH {_SCORED[kind]},
    raw AS (SELECT cls, p, CAST(sum(y) AS BIGINT) AS dp, count(*) - CAST(sum(y) AS BIGINT) AS dn FROM scored GROUP BY cls, p),
    cum AS (SELECT *, sum(dp) OVER w AS tps, sum(dn) OVER w AS fps, lead(dp) OVER w2 AS ndp, lead(dn) OVER w2 AS ndn, row_number() OVER w2 AS rn,
        sum(dp) OVER (PARTITION BY cls) AS pos, sum(dn) OVER (PARTITION BY cls) AS neg FROM raw
        WINDOW w AS (PARTITION BY cls ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY cls ORDER BY p DESC)),
    pt AS (SELECT cls, p, dp, dn, tps::DOUBLE AS tps, fps::DOUBLE AS fps, pos::DOUBLE AS pos, neg::DOUBLE AS neg, rn = 1 OR ndp IS NULL OR ndp <> dp OR ndn <> dn AS kept FROM cum),
    kp AS (SELECT cls, p, tps, fps, pos, neg FROM pt WHERE kept UNION ALL SELECT DISTINCT cls, 'inf'::DOUBLE, 0.0, 0.0, pos, neg FROM pt),
    prc AS (SELECT *, tps/(tps+fps) AS prec, CASE WHEN tps-dp+fps-dn > 0 THEN (tps-dp)/(tps-dp+fps-dn) ELSE 1.0::DOUBLE END AS prec0 FROM pt),
    area AS (SELECT cls, sum(dn*(2*tps-dp))/2/max(pos)/max(neg) AS roc_auc, sum(dp/pos*(prec+prec0)/2) AS pr_auc, sum(dp/pos*prec) AS average_precision FROM prc GROUP BY cls),
    lv AS (SELECT unnest([0.9::DOUBLE,0.95::DOUBLE,0.99::DOUBLE]) AS target_tpr),
    fat AS (SELECT cls, target_tpr, fps/neg AS fpr, p AS threshold, tps/pos AS actual_tpr, pos FROM kp, lv WHERE tps/pos >= target_tpr QUALIFY row_number() OVER (PARTITION BY cls, target_tpr ORDER BY p DESC) = 1),
    opt AS (SELECT cls, method, threshold, value FROM (SELECT cls, p AS threshold,
        2*tps/(tps+fps+pos) AS f1, CASE WHEN tps+fps=0 THEN 0.0::DOUBLE ELSE tps/(tps+fps) END AS precision, tps/pos AS recall, (tps+neg-fps)/(pos+neg) AS accuracy,
        (tps/pos + (neg-fps)/neg)/2 AS balanced_accuracy, sqrt(tps/pos*((neg-fps)/neg)) AS g_mean FROM kp)
        UNPIVOT (value FOR method IN (f1, precision, recall, accuracy, balanced_accuracy, g_mean))
        QUALIFY row_number() OVER (PARTITION BY cls, method ORDER BY value DESC, threshold DESC) = 1)
    """


_ROC = "SELECT cls, p AS threshold, round(fps/neg,6)+0.0 AS fpr, round(tps/pos,6)+0.0 AS tpr FROM kp"
_PRC = "SELECT cls, p AS threshold, round(prec,6)+0.0 AS precision, round(tps/pos,6)+0.0 AS recall FROM prc UNION ALL SELECT DISTINCT cls, 'inf'::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM prc"


@query("roc_curve", _pts("score") + _ROC, "score")
def _(spark, sf):
    return _r(M.roc_curve(_binary(spark, sf)), "fpr", "tpr")


@query("pr_curve", _pts("score") + _PRC, "score")
def _(spark, sf):
    return _r(M.pr_curve(_binary(spark, sf)), "precision", "recall")


for _name in ("roc_auc", "pr_auc", "average_precision"):
    def _area(spark, sf, name=_name):
        return _r(M.areas(_binary(spark, sf)).select(name), name)
    query(_name, _pts("score") + f"SELECT round({_name},6)+0.0 AS {_name} FROM area", "score")(_area)


@query("fpr_at_tpr", _pts("score") + "SELECT target_tpr, round(fpr,6)+0.0 AS fpr, threshold, round(actual_tpr,6)+0.0 AS actual_tpr FROM fat", "score")
def _(spark, sf):
    return _r(M.fpr_at_tpr(_binary(spark, sf), TARGETS).drop("cls"), "fpr", "actual_tpr")


_FPR_MC = """SELECT target_tpr, CAST(cls AS VARCHAR) AS cls, fpr FROM fat UNION ALL SELECT target_tpr, 'macro', avg(fpr) FROM fat GROUP BY target_tpr
    UNION ALL SELECT target_tpr, 'weighted', sum(fpr*pos)/sum(pos) FROM fat GROUP BY target_tpr"""


@query("fpr_at_tpr_multiclass", _pts("multi") + f"SELECT target_tpr, cls, round(fpr,6)+0.0 AS fpr FROM ({_FPR_MC})", "multi")
def _(spark, sf):
    return _r(M.fpr_at_tpr_multiclass(_classes(spark, sf), TARGETS), "fpr")


_RATES = """round((tp+tn)/(tp+tn+fp+fn)::DOUBLE,6)+0.0 AS accuracy, round(tp/(tp+fp)::DOUBLE,6)+0.0 AS precision, round(tp/(tp+fn)::DOUBLE,6)+0.0 AS recall, round(2*tp/(2*tp+fp+fn)::DOUBLE,6)+0.0 AS f1,
    round(fp/(fp+tn)::DOUBLE,6)+0.0 AS fpr, round(tp/(tp+fn)::DOUBLE,6)+0.0 AS tpr, round(tn/(tn+fp)::DOUBLE,6)+0.0 AS tnr, round(fn/(fn+tp)::DOUBLE,6)+0.0 AS fnr"""


@query("metrics_at_threshold", f"""SELECT tn, fp, fn, tp, {_RATES} FROM (SELECT count(*) FILTER (p < 0.25 AND y=0) AS tn, count(*) FILTER (p >= 0.25 AND y=0) AS fp,
    count(*) FILTER (p < 0.25 AND y=1) AS fn, count(*) FILTER (p >= 0.25 AND y=1) AS tp FROM score)""", "score")
def _(spark, sf):
    return _r(M.metrics_at_threshold(V.score(spark, sf), 0.25), "accuracy", "precision", "recall", "f1", "fpr", "tpr", "tnr", "fnr")


@query("optimal_threshold", _pts("score") + "SELECT method, threshold, round(value,6)+0.0 AS value FROM opt", "score")
def _(spark, sf):
    return _r(M.optimal_thresholds(_binary(spark, sf)).drop("cls"), "value")


def _block(name: str, tp: str, fp: str) -> str:
    parts = {"accuracy": f"({tp}+neg-{fp})/(pos+neg)", "precision": f"CASE WHEN {tp}+{fp}=0 THEN 0.0::DOUBLE ELSE {tp}/({tp}+{fp}) END", "recall": f"{tp}/pos",
             "f1": f"2*{tp}/({tp}+{fp}+pos)", "tn": f"neg-{fp}", "fp": fp, "fn": f"pos-{tp}", "tp": tp}
    return " UNION ALL ".join(f"SELECT '{name}_{k}' AS metric, ({v})::DOUBLE AS value FROM {name}" for k, v in parts.items())


_BINARY = f""", half AS (SELECT max(CASE WHEN p>=0.5 THEN tps ELSE 0 END) AS tp, max(CASE WHEN p>=0.5 THEN fps ELSE 0 END) AS fp, max(pos) AS pos, max(neg) AS neg FROM pt),
    best AS (SELECT tps AS tp, fps AS fp, pos, neg, threshold, value FROM opt JOIN kp ON kp.p = threshold AND kp.cls = opt.cls WHERE method='f1')
    SELECT metric, round(value,6)+0.0 AS value FROM (
    SELECT metric, value FROM area UNPIVOT (value FOR metric IN (roc_auc, pr_auc, average_precision))
    UNION ALL {_block('half', 'tp', 'fp')} UNION ALL {_block('best', 'tp', 'fp')}
    UNION ALL SELECT 'best_threshold', threshold FROM best UNION ALL SELECT 'best_value', value FROM best
    UNION ALL SELECT 'fpr_at_'||target_tpr||'_tpr', fpr FROM fat UNION ALL SELECT 'threshold_at_'||target_tpr||'_tpr', threshold FROM fat
    UNION ALL SELECT 'actual_at_'||target_tpr||'_tpr', actual_tpr FROM fat)"""


@query("nids_report_binary", _pts("score") + _BINARY, "score")
def _(spark, sf):
    return _r(M.nids_report_binary(_binary(spark, sf), TARGETS).drop("cls"), "value")


@query("nids_report_multiclass", _pts("multi") + f""", {_CELLS.replace('pred', 'list_position(probs, list_max(probs))-1 AS pred', 1)}, {_PER} SELECT cls, metric, round(value,6)+0.0 AS value FROM (
    {_REPORT} UNION ALL SELECT cls, 'fpr_at_tpr_'||target_tpr, fpr FROM ({_FPR_MC})
    UNION ALL SELECT CAST(cls AS VARCHAR), metric, value FROM area UNPIVOT (value FOR metric IN (roc_auc, pr_auc, average_precision)))""", "multi")
def _(spark, sf):
    m = V.multi(spark, sf)
    return _r(M.nids_report_multiclass(m, M.points(M.one_vs_rest(m), cls="cls"), TARGETS), "value")


@query("per_class_roc_curves", _pts("multi") + _ROC, "multi")
def _(spark, sf):
    return _r(M.roc_curve(_classes(spark, sf)), "fpr", "tpr")


@query("per_class_pr_curves", _pts("multi") + _PRC, "multi")
def _(spark, sf):
    return _r(M.pr_curve(_classes(spark, sf)), "precision", "recall")


@query("roc_auc_multiclass", _pts("multi") + "SELECT round(avg(roc_auc),6)+0.0 AS macro, round(sum(roc_auc*pos)/sum(pos),6)+0.0 AS weighted FROM area JOIN (SELECT DISTINCT cls, pos FROM pt) USING (cls)", "multi")
def _(spark, sf):
    return _r(M.roc_auc_multiclass(_classes(spark, sf)), "macro", "weighted")


# Three models: length score, its complement, and one named in the list but never run.
@query("compare_models_fpr", _pts("score").replace(_SCORED["score"], "scored AS (SELECT 'length' AS cls, y, p FROM score UNION ALL SELECT 'inverse', y, 1.0-p FROM score)")
       + "SELECT n AS cls, round(coalesce((SELECT fpr FROM fat WHERE fat.cls = n AND target_tpr = 0.95),0),6)+0.0 AS fpr FROM (SELECT unnest(['length','inverse','missing']) AS n)", "score")
def _(spark, sf):
    s = V.score(spark, sf)
    both = s.select(F.inline(F.array(F.struct(F.lit("length").alias("cls"), "y", "p"), F.struct(F.lit("inverse").alias("cls"), F.col("y"), (1.0 - F.col("p")).alias("p")))))
    models = spark.createDataFrame([("length",), ("inverse",), ("missing",)], "cls string")
    return _r(M.compare_models_fpr(M.points(both, cls="cls"), models, 0.95), "fpr")


@query("cross_entropy", "SELECT round(avg(-ln(probs[y+1])),6)+0.0 AS cross_entropy FROM multi", "multi")
def _(spark, sf):
    return _r(M.cross_entropy(V.multi(spark, sf)), "cross_entropy")
