"""Joining a table of distinct values back to its fact rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowhelm.plans.skew import null_safe_join, salted_join

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def _width(field: T.StructField) -> Column:
    """Bytes of a value, about."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0))
    if isinstance(field.dataType, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * 8
    return F.lit(8)


def is_small(values: DataFrame) -> bool:
    """Whether counted rows and their bytes allow a broadcast; counted where they are."""
    width = F.lit(16)
    for field in values.schema.fields:
        width = width + _width(field)
    rows, size = values.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def sized(values: DataFrame) -> DataFrame:
    """``values`` as a side of a join, broadcast only when their counted size allows: a planner that goes by the size of a compressed
    file may take millions of rows for a few megabytes."""
    return F.broadcast(values) if is_small(values) else values.hint("merge")


def lookup_join(
    facts: DataFrame, values: DataFrame, keys: Sequence[str], spread_on: str, how: str = "left", small: bool | None = None, hot: list | None = None
) -> DataFrame:
    """Broadcast ``values`` when small, else a join with hot keys split. A caller with several such
    joins over the same ids checks the size and finds the hot keys once and passes them on."""
    if is_small(values) if small is None else small:
        return null_safe_join(facts, F.broadcast(values), list(keys), how)
    return salted_join(facts, values, keys, spread_on, how, hot=hot)


def keep_matching(facts: DataFrame, ids: DataFrame, fact_key: str, id_key: str = "id", how: str = "left_semi") -> DataFrame:
    """Semi / anti join on one column; the id list is broadcast only when its counted size allows."""
    wanted = ids.select(F.col(id_key).alias(fact_key)).distinct()
    if is_small(wanted):
        wanted = F.broadcast(wanted)
    return facts.join(wanted, fact_key, how)


def with_both_ends(edges: DataFrame, ids: DataFrame, src: str = "src", dst: str = "dst", id_key: str = "id") -> DataFrame:
    """Edges whose two endpoints are listed."""
    wanted = ids.select(id_key).distinct()
    if is_small(wanted):
        wanted = F.broadcast(wanted)
    return edges.join(wanted.withColumnRenamed(id_key, src), src, "left_semi").join(wanted.withColumnRenamed(id_key, dst), dst, "left_semi")
