"""Node classification on pyspark.ml: features from the graph, training, search, cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowhelm.operators.attention import edge_time_mean
from flowhelm.plans.lookup import lookup_join
from flowhelm.session import cut_lineage


def neighbour_means(edges: DataFrame, nodes: DataFrame, dim: int, hops: int = 1) -> list[DataFrame]:
    """(id, _f) per step: means of the neighbours' vectors at one to ``hops`` steps, stored, as several feature sets may read them."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))
    links = edges.select("flow_id", F.inline(ends))
    around, means = nodes.select("id", F.col("feat").alias("_f")), []
    for _ in range(hops):
        near = lookup_join(links, around.withColumnRenamed("id", "nbr"), ["nbr"], "flow_id", "inner")
        around = cut_lineage(near.groupBy("id").agg(F.array(*[F.avg(F.get("_f", i)) for i in range(dim)]).alias("_f")))
        means.append(around)
    return means


def graph_features(
    edges: DataFrame, nodes: DataFrame, dim: int, encode: Callable[[Column], Column], time_dim: int, hops: int = 1, means: Sequence[DataFrame] | None = None
) -> DataFrame:
    """(id, label, features): own vector, means of the neighbours' vectors at one to ``hops`` steps, mean time encoding. ``means``
    (see :func:`neighbour_means`) saves their computation when feature sets differ in the encoding alone."""
    means = neighbour_means(edges, nodes, dim, hops) if means is None else means[:hops]
    flat = edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    timed = edge_time_mean(flat, nodes, encode, time_dim)
    joined = nodes.select("id", "label", "feat")
    for i, mean in enumerate(means):
        joined = joined.join(mean.withColumnRenamed("_f", f"_n{i}"), "id", "left")
    near_vecs = [F.coalesce(f"_n{i}", F.array_repeat(F.lit(0.0), dim)) for i in range(hops)]
    joined = joined.join(timed, "id")
    return joined.select("id", F.col("label").cast("double").alias("label"), array_to_vector(F.concat("feat", *near_vecs, "time_feat")).alias("features"))


def pipeline(kind: str = "logistic", classes: int = 2, width: int = 0, max_iter: int = 100, reg: float = 0.01, hidden: int = 8) -> Pipeline:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    if kind == "mlp":
        model = MultilayerPerceptronClassifier(featuresCol="scaled", layers=[width, hidden, classes], maxIter=max_iter, seed=7)
    else:
        model = LogisticRegression(featuresCol="scaled", family="multinomial", maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[scaler, model])


def train_node_classifier(train: DataFrame, **options) -> PipelineModel:
    return pipeline(**options).fit(train)


def train_early_stop(train: DataFrame, val: DataFrame, steps: Sequence[int] = (5, 10, 20, 40, 80), patience: int = 1, **options) -> tuple[PipelineModel, list[tuple[int, float]]]:
    """Training that goes on while the accuracy on ``val`` improves: the best model and (iterations, accuracy) tried."""
    train, val = cut_lineage(train), cut_lineage(val)  # read by every step
    best, history, waited = None, [], 0
    for n in steps:
        model = train_node_classifier(train, max_iter=n, **options)
        got = predict(model, val).agg(accuracy()).first()[0] or 0.0
        history.append((n, got))
        if best is None or got > best[0] + 1e-6:
            best, waited = (got, model), 0
        else:
            waited += 1
            if waited > patience:
                break
    return best[1], history


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select("id", F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("pred"), vector_to_array("probability").alias("probs"))


def accuracy() -> Column:
    return F.avg((F.col("y") == F.col("pred")).cast("double"))


def cv_run(rows: DataFrame, folds: DataFrame, k: int, **options) -> DataFrame:
    """Fit and evaluate once per fold (fold, role, id table): (fold, accuracy, tested)."""
    tagged = cut_lineage(rows.join(folds, "id"))  # read by every fold
    out = None
    for fold in range(k):
        part = tagged.where(F.col("fold") == fold)
        model = train_node_classifier(part.where("role = 'train'"), **options)
        got = predict(model, part.where("role = 'test'")).agg(accuracy().alias("accuracy"), F.count(F.lit(1)).alias("tested")).withColumn("fold", F.lit(fold))
        out = got if out is None else out.unionByName(got)
    return out.select("fold", "accuracy", "tested")


def fit_final(rows: DataFrame, **options) -> PipelineModel:
    return train_node_classifier(rows, **options)


def model_search(features: Callable[[str, int], DataFrame], split: DataFrame, trials: Sequence[dict], classes: int) -> DataFrame:
    """One fit per trial on a fixed split (id, split): (trial, encoding, hops, kind, hidden, reg, value), value being the
    accuracy on the test rows. ``features(encoding, hops)`` is made once per combination, whatever models try it."""
    made: dict[tuple[str, int], DataFrame] = {}
    out = None
    split = cut_lineage(split)
    for i, t in enumerate(trials):
        key = (t.get("encoding", "cosine"), t.get("hops", 1))
        if key not in made:
            made[key] = cut_lineage(features(*key).join(split, "id"))
        rows, kind = made[key], t.get("kind", "logistic")
        options = {"kind": kind, "classes": classes, "hidden": t.get("hidden", 8), "reg": t.get("reg", 0.01)}
        if kind == "mlp":
            options["width"] = rows.select("features").first()[0].size
        model = train_node_classifier(rows.where("split = 'train'"), **options)
        got = predict(model, rows.where("split = 'test'")).agg(accuracy().alias("value")).select(
            F.lit(i).alias("trial"), F.lit(key[0]).alias("encoding"), F.lit(key[1]).alias("hops"), F.lit(kind).alias("kind"),
            F.lit(options["hidden"]).alias("hidden"), F.lit(options["reg"]).alias("reg"), "value")
        out = got if out is None else out.unionByName(got)
    return out


def hyperparameter_search(rows: DataFrame, regs: Sequence[float], nets: Sequence[float], folds: int = 0, metric: str = "f1", parallelism: int = 4) -> DataFrame:
    """Grid search by cross-validation (``folds`` > 1) or one split: (trial, reg, net, value)."""
    rows = cut_lineage(rows)  # read by every trial
    base = pipeline()
    lr = base.getStages()[1]
    grid = ParamGridBuilder().addGrid(lr.regParam, list(regs)).addGrid(lr.elasticNetParam, list(nets)).build()
    judge = MulticlassClassificationEvaluator(metricName=metric)
    if folds > 1:
        values = CrossValidator(estimator=base, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=7, parallelism=parallelism).fit(rows).avgMetrics
    else:
        values = TrainValidationSplit(estimator=base, estimatorParamMaps=grid, evaluator=judge, seed=7, parallelism=parallelism).fit(rows).validationMetrics
    trials = [(i, float(g[lr.regParam]), float(g[lr.elasticNetParam]), float(v)) for i, (g, v) in enumerate(zip(grid, values))]
    return rows.sparkSession.createDataFrame(trials, "trial int, reg double, net double, value double")


def encoding_comparison(edges: DataFrame, nodes: DataFrame, dim: int, encodings: dict[str, tuple[Callable[[Column], Column], int]], split: DataFrame, **options) -> DataFrame:
    """(encoding, accuracy, best) for one pipeline per time encoding on the same split (id, split)."""
    nodes, split, out = cut_lineage(nodes), cut_lineage(split), None
    means = neighbour_means(edges, nodes, dim)
    for name, (encode, time_dim) in encodings.items():
        rows = cut_lineage(graph_features(edges, nodes, dim, encode, time_dim, means=means).join(split, "id"))  # read by every pass of a fit
        model = train_node_classifier(rows.where("split = 'train'"), **options)
        got = predict(model, rows.where("split = 'test'")).agg(accuracy().alias("accuracy")).withColumn("encoding", F.lit(name))
        out = got if out is None else out.unionByName(got)
    top = out.agg(F.max("accuracy")).first()[0]
    return out.select("encoding", "accuracy", (F.col("accuracy") == F.lit(top)).alias("best"))
