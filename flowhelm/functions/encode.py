"""Time encodings: a time in seconds to a vector, with given parameters, as native expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowhelm.functions.scalar import add, affine, col

QUANTUM = 0.1
POSITION_SCALE = 0.1


def cosine(t: str | Column, w: Sequence[float], b: Sequence[float]) -> Column:
    return F.array(*[F.cos(col(t) * F.lit(float(x)) + F.lit(float(y))) for x, y in zip(w, b)])


def quantized(t: str | Column, w: Sequence[float], b: Sequence[float], weight: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Round down to a tenth of a second, cosine, cut negatives, expand linearly."""
    q = F.floor(col(t) / F.lit(QUANTUM)) * F.lit(QUANTUM)
    return affine(weight, bias, F.transform(cosine(q, w, b), lambda x: F.greatest(x, F.lit(0.0))))


def bucket_index(t: str | Column, period: float, bins: int) -> Column:
    i = F.floor(F.pmod(col(t), F.lit(float(period))) / F.lit(float(period)) * bins)
    return F.least(F.greatest(i, F.lit(0)), F.lit(bins - 1)).cast("int")


def position_code(t: str | Column, period: float, dim: int) -> Column:
    turn = F.pmod(col(t), F.lit(float(period))) / F.lit(float(period))
    out = []
    for i in range(dim // 2):
        rate = F.lit(math.exp(-(i * math.log(10000.0) / (dim // 2))) * 2 * math.pi)
        out += [F.sin(turn * rate), F.cos(turn * rate)]
    return F.array(*out, *[F.lit(0.0)] * (dim % 2))


def learnable(df: DataFrame, t: str, table: DataFrame, period: float, bins: int, dim: int, out: str = "enc") -> DataFrame:
    """Embedding of the time bucket (table: bin, emb; one row per bin, hence broadcast) plus a small
    position code."""
    keyed = df.withColumn("_bin", bucket_index(t, period, bins)).join(F.broadcast(table.withColumnRenamed("bin", "_bin")), "_bin", "left")
    code = F.transform(position_code(t, period, dim), lambda x: x * F.lit(POSITION_SCALE))
    return keyed.withColumn(out, add("emb", code)).drop("_bin", "emb")


def time2vec(t: str | Column, w: Sequence[float], b: Sequence[float]) -> Column:
    """First element linear, the others periodic."""
    angles = [col(t) * F.lit(float(x)) + F.lit(float(y)) for x, y in zip(w, b)]
    return F.array(angles[0], *[F.sin(a) for a in angles[1:]])


def fourier_frequencies(n: int, base: float = 0.1, top: float | None = None, rising: bool = True) -> list[float]:
    """Log-spaced frequencies: rising from base to top, or falling from base by the same factor."""
    top = 100 * base if top is None else top
    step = math.log(top / base) / (n - 1 if n > 1 else 1)
    return [base * math.exp(i * step if rising else -i * step) for i in range(n)]


def fourier(t: str | Column, freqs: Sequence[float], phases: Sequence[float], linear: Sequence[tuple[float, float]] = ()) -> Column:
    """sin, cos per frequency, then the leftover linear elements."""
    out = []
    for f, p in zip(freqs, phases):
        angle = col(t) * F.lit(2 * math.pi * f) + F.lit(float(p))
        out += [F.sin(angle), F.cos(angle)]
    return F.array(*out, *[col(t) * F.lit(float(w)) + F.lit(float(b)) for w, b in linear])
