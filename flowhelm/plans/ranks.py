"""Exact order statistics and quotas by selection: nothing is sorted but the few values near a wanted rank.

A quantile sketch brackets every wanted rank. One pass counts what lies below, on and between the bracket's ends; it adds up
inside the scanning tasks, so only counts are shuffled. Values between two ends are counted one by one when few rows lie
there; else another sketch of that stretch narrows it first, so no stretch has to fit anywhere.

Quotas of rows in hash order work alike: counts per class and hash prefix find the prefix in which a quota ends, only the
hashes with that prefix are ranked, and the rows themselves pass a filter in place.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.functions.scalar import seeded_hash
from flowhelm.plans.lookup import is_small
from flowhelm.plans.skew import null_safe_join, salted_join
from flowhelm.session import stored

ACCURACY = 10_000
#: Rows between two ends that may be counted value by value; beyond that the stretch is narrowed.
INSIDE_ROWS = 200_000
ROUNDS = 12
#: Hash prefixes of so many hexadecimal digits are counted.
PREFIX_DIGITS = 4


def points_below(points: Column, value: Column, most: int, inclusive: bool = False) -> Column:
    """How many of the ascending ``points`` (at most ``most``) are below a value (``inclusive``: or equal), by binary search."""
    steps = [1 << b for b in range(max(1, most).bit_length() - 1, -1, -1)]

    def descend(low: Column, step: Column) -> Column:
        point = F.get(points, low + step - 1)
        return F.when(F.coalesce(point <= value if inclusive else point < value, F.lit(False)), low + step).otherwise(low)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), descend)


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    return df.select(F.inline(cells)).where(F.col("v").isNotNull() & ~F.isnan("v"))


def _brackets(n: int, ranks: Sequence[int], accuracy: int) -> list[float]:
    """Shares whose sketched values lie on either side of the ranks."""
    off = 2.0 / accuracy
    return sorted({min(1.0, max(0.0, r / n + d)) for r in ranks for d in (-off, off)})


def order_statistics(
    df: DataFrame, wanted: dict[str, Sequence[int]], sizes: dict[str, int], sketches: dict[str, Sequence[float]] | None = None,
    accuracy: int = ACCURACY, inside_rows: int = INSIDE_ROWS,
) -> dict[str, dict[int, float]]:
    """Per column the values at the given ranks (1-based, ascending) among its non-null numbers; ``sizes`` counts these. A caller that
    has sketched already passes ``sketches``, any ascending values. Only wanted values and ends of stretches reach the driver."""
    columns = [c for c in wanted if sizes[c] and wanted[c]]
    if not columns:
        return {c: {} for c in wanted}
    if sketches is None:
        row = df.agg(*[
            F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), _brackets(sizes[c], wanted[c], accuracy), accuracy).alias(f"q{i}")
            for i, c in enumerate(columns)]).first()
        sketches = {c: row[f"q{i}"] for i, c in enumerate(columns)}
    found: dict[str, dict[int, float]] = {c: {} for c in wanted}
    # A stretch: open ends, rows up to its lower end, and the ranks looked for in it.
    points = {c: sorted(set(sketches[c])) for c in columns}
    stretches = {c: [(None, None, 0, sorted(set(wanted[c])))] for c in columns}
    spark = df.sparkSession
    for _ in range(ROUNDS):
        open_columns = [c for c in columns if stretches[c]]
        if not open_columns:
            return found
        table = spark.createDataFrame([(i, [float(p) for p in points[c]]) for i, c in enumerate(columns) if stretches[c]], "f int, points array<double>")
        most = max(len(points[c]) for c in open_columns)
        cells = _cells(df, columns).join(F.broadcast(table), "f")
        low = points_below(F.col("points"), F.col("v"), most)
        on_point = F.get("points", F.col("low")) == F.col("v")
        cell = F.col("low") * 2 + F.coalesce(on_point, F.lit(False)).cast("int")
        counted = cells.withColumn("low", low).select("f", cell.alias("cell")).groupBy("f", "cell").agg(F.count(F.lit(1)).alias("n")).collect()
        counts = {(r["f"], r["cell"]): r["n"] for r in counted}
        narrow, fetch = {}, {}
        for i, c in enumerate(columns):
            if not stretches[c]:
                continue
            ranks = [r for s in stretches[c] for r in s[3]]
            stretches[c], before = [], 0
            for k in range(2 * len(points[c]) + 1):
                n = counts.get((i, k), 0)
                here = [r for r in ranks if before < r <= before + n]
                if here and k % 2:
                    found[c] |= {r: points[c][k // 2] for r in here}
                elif here:
                    lower = points[c][k // 2 - 1] if k else None
                    upper = points[c][k // 2] if k // 2 < len(points[c]) else None
                    (fetch if n <= inside_rows else narrow)[i, k] = (lower, upper, before, here, n)
                before += n
        if fetch:
            _fetch(df, columns, fetch, found)
        if narrow:
            _narrow(df, columns, narrow, stretches, points, accuracy)
    raise ArithmeticError("ranks not found")


def _stretches(df: DataFrame, columns: Sequence[str], ends: dict) -> DataFrame:
    """Cells inside open stretches, as (f, k, v)."""
    inside = []
    for (i, k), (lower, upper, *_) in ends.items():
        v = F.col(columns[i]).cast("double")
        keep = ~F.isnan(v)
        if lower is not None:
            keep = keep & (v > F.lit(lower))
        if upper is not None:
            keep = keep & (v < F.lit(upper))
        inside.append(F.when(keep, F.struct(F.lit(i).alias("f"), F.lit(k).alias("k"), v.alias("v"))))
    return df.select(F.explode(F.array_compact(F.array(*inside))).alias("_c")).select("_c.*")


def _fetch(df: DataFrame, columns: Sequence[str], ends: dict, found: dict) -> None:
    """Ranks inside short stretches: values counted, then running sums per stretch."""
    values = _stretches(df, columns, ends).groupBy("f", "k", "v").agg(F.count(F.lit(1)).alias("n"))
    running = values.withColumn("upto", F.sum("n").over(Window.partitionBy("f", "k").orderBy("v")))
    looked_for = df.sparkSession.createDataFrame([(i, k, r, r - before) for (i, k), (_, _, before, here, _) in ends.items() for r in here], "f int, k int, rank long, at long")
    hits = running.join(F.broadcast(looked_for), ["f", "k"]).where((F.col("upto") - F.col("n") < F.col("at")) & (F.col("at") <= F.col("upto")))
    for r in hits.select("f", "rank", "v").collect():
        found[columns[r["f"]]][r["rank"]] = r["v"]


def _narrow(df: DataFrame, columns: Sequence[str], ends: dict, stretches: dict, points: dict, accuracy: int) -> None:
    """New ends inside long stretches, from a sketch of each."""
    shares = sorted({q for (_, _, before, here, n) in ends.values() for q in _brackets(n, [r - before for r in here], accuracy)})
    sketched = _stretches(df, columns, ends).groupBy("f", "k").agg(F.percentile_approx("v", shares, accuracy).alias("q")).collect()
    new: dict[str, set] = {}
    for r in sketched:
        lower, upper, before, here, _ = ends[r["f"], r["k"]]
        c = columns[r["f"]]
        new.setdefault(c, set()).update([p for p in (lower, upper) if p is not None], r["q"])
        stretches[c].append((lower, upper, before, here))
    for c, found in new.items():
        points[c] = sorted(found)


def interpolated(values: dict[int, float], n: int, p: float) -> float:
    """Percentile by linear interpolation from the values at the ranks around it."""
    at = p * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    return values[low + 1] + (values[high + 1] - values[low + 1]) * (at - low)


def ranks_around(n: int, ps: Sequence[float]) -> list[int]:
    return sorted({r + 1 for p in ps for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})


# --- quotas in hash order ----------------------------------------------------------------------


def _hashed(df: DataFrame, ident: str, seed: str) -> Column:
    return F.coalesce(seeded_hash(ident, seed), F.lit(""))


def _cut_table(hashed: DataFrame, quotas: DataFrame, keys: Sequence[str], digits: int) -> DataFrame:
    """(keys, _cut, _ties, _take): the hash at which each class's ``quota`` ends, rows with just that hash, and how many of them
    belong to it. Classes whose quota is 0 have no row."""
    keys = list(keys)
    narrow = hashed.select(*keys, "_h", F.substring("_h", 1, digits).alias("_p"))
    counts = narrow.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    upto = counts.withColumns({"_upto": F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p")), "_size": F.sum("_n").over(Window.partitionBy(*keys))})
    running = null_safe_join(upto, quotas.select(*keys, "quota"), keys).withColumn("quota", F.least("quota", "_size"))
    ends = stored(
        running.where((F.col("_upto") - F.col("_n") < F.col("quota")) & (F.col("quota") <= F.col("_upto")))
        .select(*keys, "_p", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_rest")), "ends")
    near = null_safe_join(narrow, F.broadcast(ends) if is_small(ends) else ends, [*keys, "_p"])
    single = near.groupBy(*keys, "_p", "_rest", "_h").agg(F.count(F.lit(1)).alias("_ties"))
    place = single.withColumn("_upto", F.sum("_ties").over(Window.partitionBy(*keys, "_p").orderBy("_h")))
    last = place.where((F.col("_upto") - F.col("_ties") < F.col("_rest")) & (F.col("_rest") <= F.col("_upto")))
    return stored(last.select(*keys, F.col("_h").alias("_cut"), "_ties", (F.col("_rest") - F.col("_upto") + F.col("_ties")).alias("_take")), "cuts")


def mark_quota(
    df: DataFrame, ident: str, seed: str, quotas: DataFrame | int, keys: Sequence[str] = (), name: str = "_in", digits: int = PREFIX_DIGITS
) -> DataFrame:
    """Add ``name``: whether a row is among the first ``quota`` of its class (a number: of all rows) in the order of md5(id|seed);
    rows without an id come first, and a quota above the class takes all of it. Rows stay where they are as long as the class table may be broadcast; only rows that
    share the very last hash (repeated ids) are ranked."""
    hashed = df.withColumn("_h", _hashed(df, ident, seed))
    if isinstance(quotas, int):
        hashed, keys = hashed.withColumn("_all", F.lit(0)), ["_all"]
        quotas = df.sparkSession.createDataFrame([(0, quotas)], "_all int, quota long")
    keys = list(keys)
    cuts = _cut_table(hashed, quotas, keys, digits)
    small = is_small(cuts)
    joined = null_safe_join(hashed, F.broadcast(cuts), keys, "left") if small else salted_join(hashed, cuts, keys, "_h", "left")
    inside = F.coalesce(F.col("_h") <= F.col("_cut"), F.lit(False))
    extra = [c for c in ("_h", "_cut", "_ties", "_take", "_all") if c not in df.columns]
    if cuts.where("_take < _ties").isEmpty():
        return joined.withColumn(name, inside).drop(*extra)
    split = F.coalesce((F.col("_h") == F.col("_cut")) & (F.col("_take") < F.col("_ties")), F.lit(False))
    clear = joined.where(~split).withColumn(name, inside)
    turn = F.row_number().over(Window.partitionBy(*keys, "_h").orderBy("_h"))
    tied = joined.where(split).withColumn(name, turn <= F.col("_take"))
    return clear.unionByName(tied).drop(*extra)
