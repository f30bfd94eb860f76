"""Cleaning, imputing, encoding and scaling of flow tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowhelm.functions import ip as IP
from flowhelm.functions.scalar import is_inf, is_nan_or_null
from flowhelm.plans.lookup import lookup_join
from flowhelm.plans.ordered import ROWS_PER_BLOCK, number
from flowhelm.plans.ranks import interpolated, order_statistics, ranks_around
from flowhelm.session import cut_lineage

# Label column names looked for, in this order.
TARGET_NAMES = ["Label", "label", "attack_type", "Class", "target", "Target", "is_attack", "is_malicious", "Result", "y", "output",
                "classification", "category", "type"]
LEGACY_TARGET_NAMES = ["Label", "label", "attack_type"]
# Name parts that rule a column out as label / as feature.
NOT_TARGET_PARTS = ["id", "timestamp", "date", "time", "ip", "port", "feature", "duration", "sequence", "number"]
NOT_FEATURE_PARTS = ["flow id", "timestamp", "unnamed"]


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _floating(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def _text(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def clean_column_names(df: DataFrame) -> DataFrame:
    """Trim; every character that is no letter or digit of any script becomes ``_``. Later duplicates
    get the first of ``_2``, ``_3``, ... that no column has."""
    wanted = ["".join(x if x.isalnum() else "_" for x in c.strip()) for c in df.columns]
    taken, names = set(), []
    for base in wanted:
        name, n = base, 1
        while name in taken or (n > 1 and name in wanted):
            n += 1
            name = f"{base}_{n}"
        taken.add(name)
        names.append(name)
    return df.toDF(*names)


def strip_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def null_inf_report(df: DataFrame) -> DataFrame:
    """(column, n_null, n_inf) and a ``total`` row, from one aggregate."""
    floats = set(_floating(df))
    aggs = []
    for i, c in enumerate(df.columns):
        missing = is_nan_or_null(c) if c in floats else F.col(c).isNull()
        aggs += [F.count_if(missing).alias(f"n{i}"), (F.count_if(is_inf(c)) if c in floats else F.lit(0).cast("long")).alias(f"i{i}")]
    idx = range(len(df.columns))
    total_n, total_i = sum((F.col(f"n{i}") for i in idx), F.lit(0)), sum((F.col(f"i{i}") for i in idx), F.lit(0))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("n_null"), F.col(f"i{i}").alias("n_inf")) for i, c in enumerate(df.columns)]
    rows.append(F.struct(F.lit("total").alias("column"), total_n.cast("long").alias("n_null"), total_i.cast("long").alias("n_inf")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) with one row per cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.inline(cells))


def medians(df: DataFrame, columns: Sequence[str], sizes: dict[str, int] | None = None) -> dict[str, float]:
    """Exact median per column over the non-missing values (as many as ``sizes`` says, if known)."""
    if sizes is None:
        sizes = df.agg(*[F.count_if(~is_nan_or_null(c)).alias(c) for c in columns]).first().asDict()
    found = order_statistics(df, {c: ranks_around(sizes[c], [0.5]) for c in columns if sizes[c]}, sizes)
    return {c: interpolated(v, sizes[c], 0.5) for c, v in found.items()}


def impute_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN / null of numeric columns to the exact median; only columns with gaps are looked through for it."""
    columns = list(columns or _numeric(df))
    floats = set(_floating(df))
    missing = {c: is_nan_or_null(c) if c in floats else F.col(c).isNull() for c in columns}
    counted = [F.count(F.lit(1)).alias("n"), *[F.count_if(m).alias(f"m{i}") for i, m in enumerate(missing.values())]]
    holes = df.agg(*counted).first()
    todo = {c: holes["n"] - holes[f"m{i}"] for i, c in enumerate(columns) if holes[f"m{i}"]}
    if not todo:
        return df
    mid = medians(df, list(todo), todo)
    return df.withColumns({c: F.when(missing[c], F.lit(mid[c])).otherwise(F.col(c)) for c in todo if c in mid})


def fill_missing_text(df: DataFrame) -> DataFrame:
    return df.na.fill("missing", subset=_text(df))


def replace_inf(df: DataFrame, value: float | None = 0.0) -> DataFrame:
    """±Inf to ``value`` (None: to null, the older behaviour)."""
    return df.withColumns({c: F.when(is_inf(c), F.lit(value)).otherwise(F.col(c)) for c in _floating(df)})


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null text to the most frequent value, ties to the smallest."""
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])))
    counted = cells.where("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("b"))
    modes = {r["feature"]: r["b"]["value"] for r in best.collect()}
    return df.na.fill(modes) if modes else df


def constant_columns(df: DataFrame, count_null: bool = True) -> list[str]:
    """Columns with at most one distinct value; min = max avoids counting distinct values."""
    aggs = []
    for i, c in enumerate(df.columns):
        aggs += [F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"), F.bool_or(F.col(c).isNull()).alias(f"na{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(df.columns):
        lo, hi, na = row[f"lo{i}"], row[f"hi{i}"], row[f"na{i}"]
        same = lo == hi or (lo != lo and hi != hi)
        if lo is None or (same and not (count_null and na)):
            out.append(c)
    return out


def drop_constant_columns(df: DataFrame, count_null: bool = True) -> DataFrame:
    return df.drop(*constant_columns(df, count_null))


# Exclusive upper limits and the Spark type that holds the unsigned type.
_UNSIGNED = [(2**8, "uint8", "smallint"), (2**16, "uint16", "int"), (2**32, "uint32", "bigint")]
_SIGNED = [(2**7, "int8", "tinyint"), (2**15, "int16", "smallint"), (2**31, "int32", "int")]


def downcast_plan(df: DataFrame, inclusive: bool = False) -> list[tuple[str, str, str]]:
    """(column, narrow type, Spark type) from one min/max aggregate. ``inclusive`` also lets a column
    reach the largest value of the unsigned type, which the default rule refuses."""
    ints = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    plan = []
    if ints:
        row = df.agg(*[a for i, c in enumerate(ints) for a in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))]).first()
        for i, c in enumerate(ints):
            lo, hi = row[f"lo{i}"], row[f"hi{i}"]
            if lo is None:
                continue
            if lo >= 0:
                top = hi if inclusive else hi + 1
                plan.append(next(((c, n, s) for limit, n, s in _UNSIGNED if top < limit), (c, "uint64", "decimal(20,0)")))
            else:
                plan.append(next(((c, n, s) for limit, n, s in _SIGNED if -limit <= lo and hi < limit), (c, "int64", "bigint")))
    return plan + [(c, "float32", "float") for c in _floating(df)]


def downcast(df: DataFrame, inclusive: bool = False) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c, _, kind in downcast_plan(df, inclusive)})


def category_ratio(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct / total per text column; below one half it is a category candidate."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    cols = _text(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[count(c).alias(f"d{i}") for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column"), F.try_divide(f"d{i}", "n").alias("ratio")) for i, c in enumerate(cols)]
    return row.select(F.inline(F.array(*rows))).withColumn("category", F.col("ratio") < 0.5)


def target_candidates(df: DataFrame) -> DataFrame:
    """Heuristic label candidates (column, score) from one aggregate."""
    cols = [f for f in df.schema if not any(p in f.name.lower() for p in NOT_TARGET_PARTS)
            and isinstance(f.dataType, (T.StringType, T.IntegralType))]
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, score int")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(cols):
        aggs += [F.count_distinct(f.name).alias(f"d{i}"), F.min(f.name).alias(f"lo{i}"), F.max(f.name).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    out = []
    for i, f in enumerate(cols):
        if 1 < row[f"d{i}"] < min(1000, row["n"] * 0.1):
            spread = None if isinstance(f.dataType, T.StringType) else row[f"hi{i}"] - row[f"lo{i}"]
            out.append((f.name, 5 if spread is None else 3 if spread < 50 else 1 if spread < 200 else 0))
    return spark.createDataFrame(out, "column string, score int")


def identify_target(df: DataFrame, configured: str | None = None, legacy: bool = False) -> str:
    """Label column: configured, a known name, the best candidate (first column wins ties), the last."""
    if configured in df.columns:
        return configured
    for name in LEGACY_TARGET_NAMES if legacy else TARGET_NAMES:
        if name in df.columns:
            return name
    if not legacy:
        got = {r["column"]: r["score"] for r in target_candidates(df).collect()}
        if got:
            return max((c for c in df.columns if c in got), key=lambda c: got[c])
    return df.columns[-1]


def detect_ip_columns(df: DataFrame) -> list[tuple[str, float]]:
    """(column, valid share) for text columns named like an IP whose values mostly parse; one aggregate
    over all values of all such columns, nulls aside."""
    named = [c for c in _text(df) if "ip" in c.lower()]
    if not named:
        return []
    shares = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), IP.ip_valid(F.col(c)).cast("double"))).alias(f"s{i}") for i, c in enumerate(named)]).first()
    return [(c, share) for c, share in zip(named, shares, strict=True) if share is not None and share > 0.5]


def parse_ips(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add the parsed number / hex digits of each address, so that features do not parse again."""
    return df.withColumns({f"_n_{c}": IP.v4_number(F.col(c)) for c in columns} | {f"_d_{c}": IP.v6_digits(F.col(c)) for c in columns})


def ip_expressions(c: str) -> dict[str, Column]:
    n, d = F.col(f"_n_{c}"), F.col(f"_d_{c}")
    out = {f"{c}_octet_{i}": IP.octet(n, i) for i in (1, 2, 3, 4)}
    out |= {f"{c}_subnet_{b}": IP.subnet(n, b) for b in (8, 16, 24)}
    return out | {f"{c}_is_private": IP.is_private(n, d).cast("int"), f"{c}_is_global": IP.is_global(n, d).cast("int")}


def ip_features(df: DataFrame, columns: Sequence[str], parts: Sequence[str] = ("octet", "subnet", "private", "global")) -> DataFrame:
    """Replace each IP text column by octets, subnets and scope flags."""
    new: dict[str, Column] = {}
    for c in columns:
        new |= {k: e for k, e in ip_expressions(c).items() if any(p in k[len(c):] for p in parts)}
    parsed = parse_ips(df, columns).withColumns(new)
    return parsed.drop(*columns, *[f"_{k}_{c}" for k in "nd" for c in columns])


def ip_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("valid"), F.col(f"e{i}").alias("errors")) for i, c in enumerate(columns)]
    aggs = [a for i, c in enumerate(columns) for a in (F.count_if(IP.ip_valid(F.col(c))).alias(f"v{i}"), F.count_if(~IP.ip_valid(F.col(c))).alias(f"e{i}"))]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def timestamp_to_epoch(df: DataFrame, c: str, row_id: str, out: str = "epoch") -> DataFrame:
    """Seconds since 1970 from text, datetime or number. A text column is one of times if most of its values parse (the
    others are null then), else its values get category codes."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.NumericType):
        return df.withColumn(out, F.col(c).cast("double"))
    if not isinstance(kind, T.StringType):
        return df.withColumn(out, F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6))
    parsed = F.try_to_timestamp(F.col(c))
    if (df.agg(F.avg(F.when(F.col(c).isNotNull(), parsed.isNotNull().cast("int")))).first()[0] or 0.0) > 0.5:
        return df.withColumn(out, F.unix_micros(parsed) / F.lit(1e6))
    return category_codes(df, c, row_id, out).withColumn(out, F.col(out).cast("double"))


def _join_codes(df: DataFrame, codes: DataFrame, c: str, row_id: str, out: str) -> DataFrame:
    return lookup_join(df, codes, [c], row_id).withColumn(out, F.coalesce(F.col(out), F.lit(-1).cast("long")))


def category_codes(df: DataFrame, c: str, row_id: str, out: str = "code", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Codes 0..k-1 in sorted order, null -1."""
    values = df.where(F.col(c).isNotNull()).select(c).distinct()
    codes = number(values, [c], name=out, rows_per_block=rows_per_block).withColumn(out, F.col(out) - 1)
    return _join_codes(df, codes, c, row_id, out)


def factorize(df: DataFrame, c: str, row_id: str, out: str = "code", rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Codes by first appearance in ``row_id`` order, null -1."""
    first = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(row_id).alias("_first"))
    codes = number(first, ["_first"], name=out, rows_per_block=rows_per_block).select(c, (F.col(out) - 1).alias(out))
    return _join_codes(df, codes, c, row_id, out)


def label_encode(df: DataFrame, label: str, row_id: str, out: str = "label_code") -> DataFrame:
    """Labels to 0..k-1; already contiguous ones stay. Numbers keep numeric order unless negative."""
    if isinstance(df.schema[label].dataType, T.NumericType):
        s = df.agg(F.min(label), F.max(label), F.count_distinct(label)).first()
        whole = isinstance(df.schema[label].dataType, T.IntegralType)
        if whole and s[0] == 0 and s[1] == s[2] - 1:
            return df.withColumn(out, F.col(label).cast("long"))
        if s[0] is None or s[0] >= 0:
            return category_codes(df, label, row_id, out)
        as_text = df.withColumn("_text", F.col(label).cast("string"))
        return category_codes(as_text, "_text", row_id, out).drop("_text")
    return category_codes(df, label, row_id, out)


def label_map(df: DataFrame, code: str, label: str) -> DataFrame:
    return df.select(F.col(code).alias("code"), F.col(label).alias("label")).distinct()


def _finite(c: str) -> Column:
    return F.when(is_nan_or_null(c) | is_inf(c), F.lit(0.0)).otherwise(F.col(c).cast("double"))


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std) with population std, 0 replaced by 1; missing and infinite count as 0."""
    aggs = [a for i, c in enumerate(columns) for a in (F.avg(_finite(c)).alias(f"m{i}"), F.stddev_pop(_finite(c)).alias(f"s{i}"))]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("mean"), F.when(F.col(f"s{i}") == 0, F.lit(1.0)).otherwise(F.col(f"s{i}")).alias("std"))
            for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def apply_scaler(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Scale the columns named in a stats table (one row per column, so it fits the driver)."""
    fitted = {r["feature"]: (r["mean"], r["std"]) for r in stats.collect()}
    return df.withColumns({c: (_finite(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items() if c in df.columns})


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return apply_scaler(df, scaler_stats(df, columns))


def feature_columns(df: DataFrame, label: str, skip: Sequence[str] = ()) -> list[str]:
    return [c for c in _numeric(df) if c != label and c not in skip and not any(p in c.lower() for p in NOT_FEATURE_PARTS)]


def assemble_features(df: DataFrame, label: str, keep: Sequence[str]) -> DataFrame:
    """``features ARRAY<FLOAT>`` from the numeric non-label columns."""
    cols = feature_columns(df, label, keep)
    return df.select(*keep, F.col(label).alias("target"), F.array(*[F.col(c) for c in cols]).cast("array<float>").alias("features"))


def row_alignment(features: DataFrame, target: DataFrame, row_id: str) -> DataFrame:
    """Rows of either side without a partner; both counts are 0 when aligned."""
    a, b = features.select(row_id, F.lit(1).alias("_f")), target.select(row_id, F.lit(1).alias("_t"))
    return a.join(b, row_id, "full_outer").agg(
        F.count_if(F.col("_t").isNull()).alias("features_only"), F.count_if(F.col("_f").isNull()).alias("target_only"))


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def preprocess(df: DataFrame, row_id: str, target: str | None = None, select_features: bool = True, scale: bool = True) -> DataFrame:
    """The whole preparation: names, infinities, medians, missing text, constants, label, IP columns,
    label codes, feature selection, text codes, scaling. One statistics pass per step that needs it."""
    from flowhelm.operators.select import feature_selection

    df = fill_missing_text(impute_median(replace_inf(clean_column_names(df)), None))
    df = df.drop(*[c for c in constant_columns(df) if c != row_id])
    label = identify_target(df.drop(row_id), target)
    ips = [c for c, _ in detect_ip_columns(df.drop(label))]
    df = ip_features(df, ips) if ips else df
    df = label_encode(df, label, row_id, "_code").drop(label).withColumnRenamed("_code", label)
    df = cut_lineage(df)  # the passes below would otherwise each redo the parsing above
    if select_features:
        df = feature_selection(df, label, [row_id])[0]
    texts = [c for c in _text(df) if c not in (label, row_id)]
    for c in texts:
        df = factorize(df, c, row_id, "_code").drop(c).withColumnRenamed("_code", c)
    return standard_scale(df, feature_columns(df, label, [row_id])) if scale else df
