"""Queries for training, search and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowhelm.catalog import views as V
from flowhelm.catalog.registry import query
from flowhelm.catalog.scoring import FREQS, PHASES, TB, TDIM, TW, edges_with_time
from flowhelm.functions import encode as T
from flowhelm.functions.scalar import r6
from flowhelm.operators import history as H
from flowhelm.operators import ml as M
from flowhelm.operators import sampling as P
from flowhelm.session import cut_lineage, scratch_path


def _encode(t):
    return T.cosine(t, TW, TB)


ENCODINGS = {"cosine": (_encode, TDIM), "time2vec": (lambda t: T.time2vec(t, TW, TB), TDIM), "fourier": (lambda t: T.fourier(t, FREQS, PHASES), 2 * len(FREQS))}


def _rows(spark, sf, encoding="cosine", hops=1):
    """Features of all nodes, stored: every pass of a fit reads them."""
    return cut_lineage(M.graph_features(edges_with_time(spark, sf), cut_lineage(V.node(spark, sf)), V.DIM, *ENCODINGS[encoding], hops))


def _split(spark, sf):
    return P.split_train_test(cut_lineage(V.node(spark, sf).select("id", "label")), "id", "label", 0.2, "ml").select("id", "split")


def _out(predicted):
    return predicted.select("id", "y", "pred")


@query("train_node_classifier")
def _(spark, sf):
    rows = _rows(spark, sf).join(_split(spark, sf), "id")
    return _out(M.predict(M.train_node_classifier(rows.where("split = 'train'")), rows.where("split = 'test'")))


@query("train_node_classifier_mlp")
def _(spark, sf):
    rows = _rows(spark, sf).join(_split(spark, sf), "id")
    model = M.train_node_classifier(rows.where("split = 'train'"), kind="mlp", classes=10, width=2 * V.DIM + TDIM)
    return _out(M.predict(model, rows.where("split = 'test'")))


@query("predict_node_classifier")
def _(spark, sf):
    path = scratch_path(spark, "model")
    rows = _rows(spark, sf)
    M.fit_final(rows).save(path)
    return _out(M.predict(M.PipelineModel.load(path), rows))


@query("cv_run")
def _(spark, sf):
    folds = P.kfold_stratified(V.node(spark, sf).select("id", "label"), "id", "label", 3, seed="cv")
    return M.cv_run(_rows(spark, sf), folds, 3)


@query("fit_final")
def _(spark, sf):
    rows = _rows(spark, sf)
    return _out(M.predict(M.fit_final(rows), rows))


@query("hyperparameter_search")
def _(spark, sf):
    return M.hyperparameter_search(_rows(spark, sf), [0.01, 0.1], [0.0, 0.5])


TRIALS = [{"encoding": e, "hops": h} | model for e in ("cosine", "fourier") for h in (1, 2) for model in ({"reg": 0.01}, {"kind": "mlp", "hidden": 12})]


_TEST = """WITH cc AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n FROM node GROUP BY label), sh AS (SELECT label, c, CAST(ceil(n*0.2) AS BIGINT) AS total, c*CAST(ceil(n*0.2) AS BIGINT)/n::DOUBLE AS share FROM cc),
    qq AS (SELECT label, floor(share) + CASE WHEN row_number() OVER (ORDER BY share-floor(share) DESC, c DESC, label::VARCHAR) <= total - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS quota FROM sh),
    ts AS (SELECT id, f.label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(id,'|','ml'))) AS rk FROM node) f JOIN qq USING (label) WHERE rk <= quota)"""


@query("model_search", _TEST + """, tr AS (SELECT unnest(range(8))::INT AS trial, unnest(['cosine','cosine','cosine','cosine','fourier','fourier','fourier','fourier']) AS encoding, unnest([1,1,2,2,1,1,2,2])::INT AS hops, unnest(['logistic','mlp','logistic','mlp','logistic','mlp','logistic','mlp']) AS kind)
    SELECT tr.*, (SELECT count(*) FROM ts) AS tested, true AS whole FROM tr""", "node")
def _(spark, sf):
    """Model kind, hidden width, time encoding and hops of the features tried on one split: each value is a share of all its test rows."""
    edges, nodes, split = edges_with_time(spark, sf), cut_lineage(V.node(spark, sf)), cut_lineage(_split(spark, sf))
    means = M.neighbour_means(edges, nodes, V.DIM, max(t["hops"] for t in TRIALS))
    tested = split.where("split = 'test'").count()
    found = M.model_search(lambda e, h: M.graph_features(edges, nodes, V.DIM, *ENCODINGS[e], h, means), split, TRIALS, 10)
    hits = F.col("value") * tested
    return found.select("trial", "encoding", "hops", "kind", F.lit(tested).cast("long").alias("tested"), ((F.abs(hits - F.round(hits)) < 1e-6) & hits.between(0, tested)).alias("whole"))


def _checked(predicted):
    """Probabilities that add up to 1 and a prediction that has the largest."""
    total = F.aggregate("probs", F.lit(0.0), lambda a, p: a + p)
    return predicted.select("id", "y", ((F.abs(total - 1) < 1e-6) & (F.get("probs", F.col("pred")) == F.array_max("probs"))).alias("valid"))


@query("train_early_stop", _TEST + " SELECT id, label AS y, true AS valid FROM ts", "node")
def _(spark, sf):
    """Trained while a validation part of the training rows improves; every test row is predicted properly."""
    rows = cut_lineage(_rows(spark, sf, hops=2).join(_split(spark, sf), "id"))
    train = rows.where("split = 'train'").withColumn("_val", F.pmod(F.crc32("id"), F.lit(5)) == 0)
    model, _history = M.train_early_stop(train.where("NOT _val"), train.where("_val"))
    return _checked(M.predict(model, rows.where("split = 'test'")))


@query("predictions_valid", "SELECT id, label AS y, true AS valid FROM node", "node")
def _(spark, sf):
    rows = _rows(spark, sf)
    return _checked(M.predict(M.fit_final(rows), rows))


@query("encoding_comparison")
def _(spark, sf):
    return M.encoding_comparison(edges_with_time(spark, sf), V.node(spark, sf), V.DIM, ENCODINGS, _split(spark, sf))


# Histories: a user is a run, its events in order are the epochs.
_HIST = "h AS (SELECT src AS run, row_number() OVER (PARTITION BY src ORDER BY t_us, flow_id) AS epoch, bytes AS f1, dst AS loss FROM flow)"


def _history(spark, sf):
    from flowhelm.plans.ordered import number

    f = V.flow(spark, sf).select("flow_id", "t_us", F.col("src").alias("run"), F.col("bytes").alias("f1"), F.col("dst").alias("loss"))
    return number(f, ["t_us", "flow_id"], ["run"], "epoch").drop("flow_id", "t_us")


@query("best_epoch", f"WITH {_HIST} SELECT run, epoch AS best_epoch, round(f1,6)+0.0 AS metric, loss FROM h QUALIFY row_number() OVER (PARTITION BY run ORDER BY round(f1,6) DESC, loss, epoch) = 1", "flow")
def _(spark, sf):
    return H.best_epoch(_history(spark, sf), "run", "epoch", "f1", "loss").withColumn("metric", r6("metric"))


@query("early_stop_epoch", f"""WITH {_HIST}, b AS (SELECT *, max([round(f1,6), -loss::DOUBLE]) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM h),
    i AS (SELECT run, epoch, max(CASE WHEN was IS NULL OR [round(f1,6), -loss::DOUBLE] > was THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING) AS lst FROM b)
    SELECT run, min(CASE WHEN epoch - lst >= 10 THEN epoch END) AS stop_epoch FROM i GROUP BY run""", "flow")
def _(spark, sf):
    return H.early_stop_epoch(_history(spark, sf), "run", "epoch", "f1", "loss", 10)


@query("search_report", "SELECT flow_id AS trial, bytes AS value, max(bytes) OVER (ORDER BY flow_id ROWS UNBOUNDED PRECEDING) AS best_so_far FROM flow", "flow")
def _(spark, sf):
    return H.search_report(V.flow(spark, sf).select(F.col("flow_id").alias("trial"), F.col("bytes").alias("value")), "trial", "value")


@query("search_best", "SELECT flow_id AS trial, bytes AS value, src, dst, (SELECT count(*) FROM flow) AS n_trials FROM flow ORDER BY bytes DESC, flow_id LIMIT 1", "flow")
def _(spark, sf):
    t = V.flow(spark, sf).select(F.col("flow_id").alias("trial"), F.col("bytes").alias("value"), "src", "dst")
    return H.search_best(t, "trial", "value", ["src", "dst"])
