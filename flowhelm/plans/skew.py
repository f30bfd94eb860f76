"""Equi-joins whose hot keys are split over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 5_000_000
PIECES = 64


def hot_keys(left: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> list:
    """Keys with more than ``hot_rows`` rows: at most rows / hot_rows of them."""
    return left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(*keys).collect()


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], renamed: str = "_r_{}") -> tuple[DataFrame, Column]:
    """``right`` with renamed keys, and the null-safe equality of all keys."""
    other = right.withColumnsRenamed({k: renamed.format(k) for k in keys})
    same = left[keys[0]].eqNullSafe(other[renamed.format(keys[0])])
    for k in keys[1:]:
        same = same & left[k].eqNullSafe(other[renamed.format(k)])
    return other, same


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet each other; the keys of ``left`` stay."""
    other, same = same_keys(left, right, keys)
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    spread_on: str,
    how: str = "inner",
    hot_rows: int = HOT_ROWS,
    pieces: int = PIECES,
    hot: list | None = None,
) -> DataFrame:
    """Join where ``left`` may hold very many rows of one key.

    Keys with more than ``hot_rows`` left rows (or those given as ``hot``) get a salt from
    ``spread_on`` on the left and all ``pieces`` salts on the right, so their rows meet in ``pieces``
    tasks. Null keys are keys like others and meet each other.
    """
    keys = list(keys)
    hot = hot_keys(left, keys, hot_rows) if hot is None else hot
    if not hot:
        return null_safe_join(left, right, keys, how)
    schema = left.select(*keys).schema
    marks = F.broadcast(left.sparkSession.createDataFrame(hot, schema).withColumn("_hot", F.lit(True)))
    salt = F.pmod(F.xxhash64(spread_on), F.lit(pieces)).cast("int")
    left_s = null_safe_join(left, marks, keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    all_salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))
    right_s = null_safe_join(right, marks, keys, "left").withColumn("_salt", F.explode(all_salts)).drop("_hot")
    return null_safe_join(left_s, right_s, [*keys, "_salt"], how).drop("_salt")
