"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


UNROLL = 16


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_hash(ident: str | Column, seed: str | int) -> Column:
    """md5 of ``id|seed``: the deterministic stand-in for a random draw."""
    return F.md5(F.concat(col(ident).cast("string"), F.lit("|"), F.lit(str(seed))))


def unit(hash_text: str | Column) -> Column:
    """A number strictly inside (0, 1) from the first eight hex digits of a hash."""
    return (F.conv(F.substring(col(hash_text), 1, 8), 16, 10).cast("double") + 1.0) / F.lit(4294967297.0)


def r6(c: str | Column) -> Column:
    return F.round(col(c), 6) + F.lit(0.0)


def is_nan_or_null(c: str | Column) -> Column:
    return col(c).isNull() | F.isnan(col(c))


def is_inf(c: str | Column) -> Column:
    return F.abs(col(c)) == F.lit(float("inf"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Sum of products from left to right."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-8))


def add(a: str | Column, b: str | Column) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x + y)


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def weighted(weights: Sequence[float], x: str | Column, start: int = 0) -> Column:
    """Dot product of literal weights and ``x[start:]``: short ones written out, so that they compile
    to plain code, long ones by array functions, so that plans stay small."""
    if len(weights) > UNROLL:
        return dot(vector(weights), F.slice(x, start + 1, len(weights)))
    total = F.lit(0.0)
    for j, w in enumerate(weights):
        total = total + F.lit(float(w)) * F.get(col(x), start + j)
    return total


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``; the plan holds it once, too."""
    return F.get(F.transform(F.array(value), body), 0)


def affine(weight: Sequence[Sequence[float]], bias: Sequence[float], x: str | Column) -> Column:
    """``W x + b`` with one literal row of W per output element; ``x`` given as an expression is
    evaluated once."""

    def rows(v: str | Column) -> Column:
        return F.array(*[weighted(row, v) + F.lit(float(b)) for row, b in zip(weight, bias)])

    return rows(x) if isinstance(x, str) else let(x, rows)


def seconds(t_us: str | Column) -> Column:
    return col(t_us) / F.lit(1_000_000.0)
