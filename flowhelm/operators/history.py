"""Reports over training and search histories: one row per (run, epoch) or per trial.

Metrics are compared after rounding to six decimals, so a gain below 1e-6 is no improvement.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowhelm.plans.ordered import ROWS_PER_BLOCK, running_sums
from flowhelm.session import cut_lineage


def _rank(metric: str, loss: str) -> Column:
    return F.struct(F.round(metric, 6).alias("m"), (-F.col(loss)).alias("l"))


def best_epoch(df: DataFrame, run: str, epoch: str, metric: str, loss: str) -> DataFrame:
    """Per run the epoch with the best metric, ties by lower loss, then the first."""
    best = df.groupBy(run).agg(F.max(F.struct(_rank(metric, loss).alias("r"), (-F.col(epoch)).alias("e"))).alias("b"))
    return best.select(run, (-F.col("b.e")).alias("best_epoch"), F.col("b.r.m").alias("metric"), (-F.col("b.r.l")).alias("loss"))


def early_stop_epoch(df: DataFrame, run: str, epoch: str, metric: str, loss: str, patience: int, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per run the first epoch after ``patience`` epochs without improvement; null when never.

    Epochs count from 1 without gaps. The last improvement before an epoch is the first one with the best metric so far, so one
    running maximum of (metric, earlier epoch first) gives the waiting time.
    """
    ranked = cut_lineage(df.select(run, epoch, F.struct(_rank(metric, loss).alias("r"), (-F.col(epoch)).alias("e")).alias("_r")))
    top = running_sums(ranked, [epoch], {"_top": F.col("_r")}, [run], rows_per_block, largest=True)
    stop = F.when(F.col(epoch) + F.col("_top.e") >= patience, F.col(epoch))
    return top.groupBy(run).agg(F.min(stop).alias("stop_epoch"))


def search_report(trials: DataFrame, trial: str, value: str, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Every trial with the best value so far."""
    return running_sums(trials.select(trial, value), [trial], {"best_so_far": F.col(value)}, (), rows_per_block, largest=True)


def search_best(trials: DataFrame, trial: str, value: str, params: Sequence[str]) -> DataFrame:
    """Best value with its parameters (first trial wins ties) and the number of trials."""
    row = F.struct(F.col(value), (-F.col(trial)).alias("_t"), *params)
    best = trials.agg(F.max(row).alias("b"), F.count(F.lit(1)).alias("n_trials"))
    return best.select((-F.col("b._t")).alias(trial), F.col(f"b.{value}").alias(value), *[F.col(f"b.{p}").alias(p) for p in params], "n_trials")
