"""Names and keys of rows: operators that pass a user's columns on, or decide about rows, need some of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowhelm.plans.ordered import number
from flowhelm.session import stored

KEY = "_row_key"


def set_aside(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """``df`` with all columns but ``needed`` under neutral names (`_c0`, `_c1`, ...), so that helper columns can't meet them."""
    return df.toDF(*[c if c in needed else f"_c{i}" for i, c in enumerate(df.columns)])


def put_back(df: DataFrame, names: Sequence[str], needed: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """The columns of :func:`set_aside` under their names again, then ``also``, which replace columns that bear their names."""
    inner = [c if c in needed else f"_c{i}" for i, c in enumerate(names)]
    kept = [(a, b) for a, b in zip(inner, names, strict=True) if b not in also]
    return df.select(*[F.col(a).alias(b) for a, b in kept], *also)


def with_row_keys(docs: DataFrame, ident: str = "doc_id", order: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with a key of its own for every row (``KEY``), and whether the ids serve as keys. Where ids are missing or repeated, all rows are
    numbered, in the order of the ids, missing ones last, then of the texts; the numbered table is written once."""
    plain = docs.withColumn(KEY, F.col(ident).cast("long"))
    if plain.groupBy(KEY).count().where(f"count > 1 OR {KEY} IS NULL").isEmpty():
        return plain, True
    marked = docs.withColumns({"_none": F.col(ident).isNull(), "_id": F.coalesce(F.col(ident).cast("long"), F.lit(0)), "_row": F.monotonically_increasing_id()})
    return stored(number(marked, ["_none", "_id", order, "_row"], name=KEY).drop("_none", "_id", "_row"), "keyed"), False
