"""Detection metrics: confusion counts, averages, ROC / PR curves, FPR at a target TPR.

Scores are reduced to one row per distinct threshold before anything is ordered, and the ordered
passes run in blocks (plans.ordered), so neither a popular score nor a popular class is a hot task.
Curve tables are keyed by ``cls`` (a class, a model, or 0).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowhelm.plans.lookup import is_small
from flowhelm.plans.ordered import ROWS_PER_BLOCK, neighbours, running_sums
from flowhelm.plans.skew import null_safe_join
from flowhelm.session import cut_lineage


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def counts(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred", truth_only: bool = False) -> DataFrame:
    """All (truth, prediction) cells over the labels present, zero cells kept; a missing label is a label of its own."""
    cells = counts(df, y, pred)
    seen = cells.select(F.explode(F.array("y") if truth_only else F.array("y", "pred")).alias("c")).distinct()
    grid = seen.select(F.col("c").alias("y")).join(seen.select(F.col("c").alias("pred")))  # a row per cell of the matrix
    return null_safe_join(grid, cells, ["y", "pred"], "left").select("y", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(cells: DataFrame) -> DataFrame:
    """precision / recall / f1 / support per class from (y, pred, n) counts; division by zero gives 0."""
    hit = F.col("y") == F.col("pred")
    n = F.col("n")
    parts = F.array(
        F.struct(F.col("y").alias("cls"), F.when(hit, n).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(n).alias("fn")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(n).alias("fp"), F.lit(0).cast("long").alias("fn")),
    )
    sums = cells.select(F.inline(parts)).groupBy("cls").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "cls", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"),
    )


def averages(cells: DataFrame) -> DataFrame:
    """Macro and support-weighted precision / recall / f1."""
    out = []
    for m in ("precision", "recall", "f1"):
        out += [F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"{m}_weighted")]
    return per_class(cells).agg(*out)


def _long(row: DataFrame, columns: Sequence[str], cls: Column) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
    return row.select(cls.alias("cls"), F.inline(pairs))


def classification_report(cells: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """Long table (cls, metric, value): per class, averages and accuracy."""
    cls = F.col("cls").cast("string")
    if names:
        cls = F.coalesce(F.get(F.lit(list(names)), F.col("cls").cast("int")), cls)
    classes = _long(per_class(cells), ["precision", "recall", "f1", "support"], cls)
    avg = averages(cells)
    acc = cells.agg((F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return classes.unionByName(_long(avg, avg.columns, F.lit("all"))).unionByName(_long(acc, ["accuracy"], F.lit("all")))


# --- curves ---------------------------------------------------------------------------------

def points(df: DataFrame, y: str = "y", p: str = "p", cls: str | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """One row per (cls, threshold): own and cumulated positives / negatives, class totals, and
    whether the ROC curve keeps the point (neither end point nor bend: dropped)."""
    at = cut_lineage(df.groupBy((F.col(cls) if cls else F.lit(0)).alias("cls"), F.col(p).alias("p")).agg(
        F.sum(F.col(y).cast("long")).alias("dp"), F.sum(1 - F.col(y).cast("long")).alias("dn")
    ).withColumn("_down", -F.col("p")))
    n = at.count()
    cum = running_sums(at, ["_down"], {"tps": F.col("dp"), "fps": F.col("dn")}, ["cls"], rows_per_block, rows=n)
    bent = neighbours(cum, ["_down"], following={"_ndp": "dp", "_ndn": "dn"}, keys=["cls"], rows_per_block=rows_per_block, rows=n)
    first = (F.col("tps") == F.col("dp")) & (F.col("fps") == F.col("dn"))
    keep = first | F.col("_ndp").isNull() | (F.col("_ndp") != F.col("dp")) | (F.col("_ndn") != F.col("dn"))
    # One row per class, so always small enough to send to every task.
    total = at.groupBy("cls").agg(F.sum("dp").alias("pos"), F.sum("dn").alias("neg"))
    return bent.withColumn("kept", keep).drop("_down", "_ndp", "_ndn").join(F.broadcast(total) if is_small(total) else total, "cls")


def _tpr() -> Column:
    return F.try_divide("tps", "pos")


def _fpr() -> Column:
    return F.try_divide("fps", "neg")


def _precision() -> Column:
    return ratio(F.col("tps"), F.col("tps") + F.col("fps"))


def _precision_before() -> Column:
    tp, fp = F.col("tps") - F.col("dp"), F.col("fps") - F.col("dn")
    return F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(1.0))


def kept_points(pts: DataFrame) -> DataFrame:
    """ROC thresholds: the kept points and the one above all scores."""
    top = pts.select("cls", "pos", "neg").distinct().select(
        "cls", F.lit(float("inf")).alias("p"), F.lit(0).cast("long").alias("dp"), F.lit(0).cast("long").alias("dn"),
        F.lit(0).cast("long").alias("tps"), F.lit(0).cast("long").alias("fps"), F.lit(True).alias("kept"), "pos", "neg")
    return pts.where("kept").unionByName(top)


def roc_curve(pts: DataFrame) -> DataFrame:
    return kept_points(pts).select("cls", F.col("p").alias("threshold"), _fpr().alias("fpr"), _tpr().alias("tpr"))


def pr_curve(pts: DataFrame) -> DataFrame:
    end = pts.select("cls").distinct().select("cls", F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.select("cls", F.col("p").alias("threshold"), _precision().alias("precision"), _tpr().alias("recall")).unionByName(end)


def _area_columns() -> list[Column]:
    pos, neg = F.first("pos"), F.first("neg")
    area = F.sum(F.col("dn") * (2 * F.col("tps") - F.col("dp")))
    return [
        F.try_divide(area / 2, pos.cast("double") * neg).alias("roc_auc"),
        F.sum(F.try_divide("dp", "pos") * (_precision() + _precision_before()) / 2).alias("pr_auc"),
        F.sum(F.try_divide("dp", "pos") * _precision()).alias("average_precision"),
    ]


def areas(pts: DataFrame) -> DataFrame:
    """roc_auc (trapezoid), pr_auc (trapezoid) and average_precision (steps) per class."""
    return pts.groupBy("cls").agg(*_area_columns())


def fpr_at_tpr(pts: DataFrame, targets: Sequence[float]) -> DataFrame:
    """First ROC point that reaches each target."""
    reached = kept_points(pts).withColumn("target_tpr", F.explode(F.array(*[F.lit(float(t)) for t in targets]))).where(_tpr() >= F.col("target_tpr"))
    best = reached.groupBy("cls", "target_tpr").agg(F.min_by(F.struct("tps", "fps", "pos", "neg", "p"), -F.col("p")).alias("b"))
    return best.select("cls", "target_tpr", F.try_divide("b.fps", "b.neg").alias("fpr"), F.col("b.p").alias("threshold"), F.try_divide("b.tps", "b.pos").alias("actual_tpr"))


def fpr_at_tpr_multiclass(pts: DataFrame, targets: Sequence[float]) -> DataFrame:
    """Per class, then macro and support-weighted means: (target_tpr, cls, fpr)."""
    weights = pts.select("cls", "pos").distinct()
    one = fpr_at_tpr(pts, targets).join(weights, "cls")
    avg = one.groupBy("target_tpr").agg(F.avg("fpr").alias("macro"), (F.sum(F.col("fpr") * F.col("pos")) / F.sum("pos")).alias("weighted"))
    means = avg.select("target_tpr", F.inline(F.array(
        F.struct(F.lit("macro").alias("cls"), F.col("macro").alias("fpr")), F.struct(F.lit("weighted").alias("cls"), F.col("weighted").alias("fpr")))))
    return one.select("target_tpr", F.col("cls").cast("string").alias("cls"), "fpr").unionByName(means)


def metrics_at_threshold(df: DataFrame, threshold: float, y: str = "y", p: str = "p") -> DataFrame:
    hit, pos = F.col(p) >= threshold, F.col(y) == 1
    c = df.agg(
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & pos).alias("fn"), F.count_if(hit & pos).alias("tp"))
    return with_rates(c)


def with_rates(c: DataFrame) -> DataFrame:
    tn, fp, fn, tp = F.col("tn"), F.col("fp"), F.col("fn"), F.col("tp")
    return c.select(
        "*", ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fn).alias("tpr"),
        ratio(tn, tn + fp).alias("tnr"), ratio(fn, fn + tp).alias("fnr"))


def threshold_score(method: str) -> Column:
    tp, fp = F.col("tps"), F.col("fps")
    tpr, tnr = ratio(tp, F.col("pos")), ratio(F.col("neg") - fp, F.col("neg"))
    return {
        "precision": ratio(tp, tp + fp),
        "recall": tpr,
        "accuracy": (tp + F.col("neg") - fp) / (F.col("pos") + F.col("neg")),
        "balanced_accuracy": (tpr + tnr) / 2,
        "g_mean": F.sqrt(tpr * tnr),
    }.get(method, ratio(2 * tp, tp + fp + F.col("pos")))


METHODS = ("f1", "precision", "recall", "accuracy", "balanced_accuracy", "g_mean")


def optimal_thresholds(pts: DataFrame, methods: Sequence[str] = METHODS) -> DataFrame:
    """Best ROC threshold per method in one pass; the highest threshold wins ties."""
    best = kept_points(pts).groupBy("cls").agg(*[F.max(F.struct(threshold_score(m).alias("value"), F.col("p").alias("threshold"))).alias(m) for m in methods])
    rows = F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"{m}.threshold").alias("threshold"), F.col(f"{m}.value").alias("value")) for m in methods])
    return best.select("cls", F.inline(rows))


def nids_report_binary(pts: DataFrame, targets: Sequence[float] = (0.9, 0.95, 0.99), method: str = "f1") -> DataFrame:
    """Every scalar of the binary report as (metric, value), all from one pass over the curve table."""
    rows = kept_points(pts).unionByName(pts.where(~F.col("kept")))
    here = F.struct("tps", "fps", "p")
    on_curve = F.col("kept")
    aggs = [
        *_area_columns(),
        F.first("pos").alias("pos"), F.first("neg").alias("neg"),
        F.max(F.when(F.col("p") >= 0.5, here)).alias("half"),
        F.max(F.when(on_curve, F.struct(threshold_score(method).alias("value"), F.col("p").alias("threshold"), F.col("tps"), F.col("fps")))).alias("best"),
    ]
    for t in targets:
        aggs.append(F.max(F.when(on_curve & (_tpr() >= t), F.struct("p", "tps", "fps"))).alias(f"at_{t}"))
    one = rows.groupBy("cls").agg(*aggs)
    pairs: list[tuple[str, Column]] = [(m, F.col(m)) for m in ("roc_auc", "pr_auc", "average_precision")]
    pos, neg = F.col("pos"), F.col("neg")
    for name, tp, fp in (("half", F.coalesce("half.tps", F.lit(0)), F.coalesce("half.fps", F.lit(0))), ("best", F.col("best.tps"), F.col("best.fps"))):
        pairs += [
            (f"{name}_accuracy", (tp + neg - fp) / (pos + neg)), (f"{name}_precision", ratio(tp, tp + fp)), (f"{name}_recall", ratio(tp, pos)),
            (f"{name}_f1", ratio(2 * tp, tp + fp + pos)), (f"{name}_tn", neg - fp), (f"{name}_fp", fp), (f"{name}_fn", pos - tp), (f"{name}_tp", tp)]
    pairs += [("best_threshold", F.col("best.threshold")), ("best_value", F.col("best.value"))]
    for t in targets:
        at = F.col(f"`at_{t}`")
        pairs += [(f"fpr_at_{t}_tpr", F.try_divide(at["fps"], neg)), (f"threshold_at_{t}_tpr", at["p"]), (f"actual_at_{t}_tpr", F.try_divide(at["tps"], pos))]
    return one.select("cls", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in pairs])))


# --- multiclass -----------------------------------------------------------------------------

def one_vs_rest(df: DataFrame, y: str = "y", probs: str = "probs") -> DataFrame:
    """(cls, y, p) rows for every class; the following groupBy shrinks them map-side."""
    return df.select(F.col(y).alias("_y"), F.posexplode(probs).alias("cls", "p")).select("cls", (F.col("_y") == F.col("cls")).cast("int").alias("y"), "p")


def argmax(probs: str = "probs") -> Column:
    return F.array_position(F.col(probs), F.array_max(probs)).cast("int") - 1


def roc_auc_multiclass(pts: DataFrame) -> DataFrame:
    """One-vs-rest AUC: per class plus macro and support-weighted means."""
    one = pts.groupBy("cls").agg(*_area_columns()[:1], F.first("pos").alias("pos"))
    return one.agg(F.avg("roc_auc").alias("macro"), (F.sum(F.col("roc_auc") * F.col("pos")) / F.sum("pos")).alias("weighted"))


def nids_report_multiclass(df: DataFrame, pts: DataFrame, targets: Sequence[float] = (0.9, 0.95, 0.99)) -> DataFrame:
    """(cls, metric, value): argmax metrics, FPR at each target, curve areas per class."""
    cells = counts(df.withColumn("_pred", argmax()), "y", "_pred")
    basic = classification_report(cells)
    fpr = fpr_at_tpr_multiclass(pts, targets).select("cls", F.concat(F.lit("fpr_at_tpr_"), F.col("target_tpr").cast("string")).alias("metric"), F.col("fpr").alias("value"))
    area = areas(pts)
    return basic.unionByName(fpr).unionByName(_long(area, ["roc_auc", "pr_auc", "average_precision"], F.col("cls").cast("string")))


def compare_models_fpr(pts: DataFrame, models: DataFrame, target: float = 0.95) -> DataFrame:
    """FPR at one TPR per model (``cls``); models without result get 0."""
    got = fpr_at_tpr(pts, [target]).select("cls", "fpr")
    return models.join(got, "cls", "left").select("cls", F.coalesce("fpr", F.lit(0.0)).alias("fpr"))


def cross_entropy(df: DataFrame, y: str = "y", probs: str = "probs") -> DataFrame:
    """Mean negative log of the probability given to the true class."""
    return df.agg(F.avg(-F.log(F.element_at(F.col(probs), F.col(y) + 1))).alias("cross_entropy"))
