"""Mixing sources to target weights with a time-varying curriculum.

Every source has a weight and a tilt: its demand rate over training time t in [0, 1] is ``1 + tilt * (2t - 1)``, whose
integral ``t + tilt * (t*t - t)`` ends at 1, so the whole demand is the target that the weight gives. A source delivers
its documents in hash order, again from the start after each pass; the point where the integrated demand reaches the
words delivered before (to the middle of) a copy is its training position. Documents are range-sorted by that position.

Null or empty texts have size 0 and are never taken; a null source is a source of its own, last in order; repeated rows
are rows of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowhelm.llm.columns import KEY, put_back, set_aside, with_row_keys
from flowhelm.plans.lookup import is_small
from flowhelm.plans.ordered import number, running_sums
from flowhelm.session import stored

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BLOCK = 2_000  # a source is summed up in blocks from this size on, so no source is one task


def words_of(text: str | Column) -> Column:
    """Number of words of a text, 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float], tilts: Sequence[float], share: float, cap: float, block: int = ROWS_PER_BLOCK) -> DataFrame:
    """One row per source: size, weight and tilt (by rank, repeating) and target. Targets share ``share`` times all sizes
    by weight; none exceeds ``cap`` times the size of its source, and what it can't take goes to the others by weight.
    That is ``least(cap * size, level * weight)`` at the one level where the targets add up to the demand."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")) \
        .withColumns({"_last": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    ranked = number(sums, ["_last", "_name"], name="rank", rows_per_block=block)
    at = ((F.col("rank") - 1) % len(weights)).cast("int")
    tilt_at = ((F.col("rank") - 1) % len(tilts)).cast("int")
    sources = stored(ranked.select(
        "source", "source_size", "rank", F.get(F.array(*[F.lit(float(w)) for w in weights]), at).alias("weight"),
        F.get(F.array(*[F.lit(float(x)) for x in tilts]), tilt_at).alias("tilt")), "sources")
    full = F.col("source_size") * F.lit(float(cap))
    steps = running_sums(
        sources.withColumns({"_full": full, "_ratio": full / F.col("weight")}), ["_ratio", "rank"],
        {"_done": F.col("_full"), "_used": F.col("weight")}, rows_per_block=block)
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    demand = float(share) * total[0]
    # The level if this source and all with a higher ratio stay below their caps; right where it doesn't pass the ratio.
    level = (F.lit(demand) - (F.col("_done") - F.col("_full"))) / (F.lit(total[1]) - F.col("_used") + F.col("weight"))
    found = steps.select(F.min(F.when(level <= F.col("_ratio"), F.col("_ratio"))).alias("r"), F.min_by(level, F.when(level <= F.col("_ratio"), F.col("_ratio"))).alias("level")).first()
    share_of = full if found["level"] is None else F.least(full, F.lit(found["level"]) * F.col("weight"))
    return sources.withColumn("target", F.round(share_of, 6))


def plan(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), tilts: Sequence[float] = (0.5, -0.5, 0.0), share: float = 1.5, cap: float = 2.0, block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, copies taken and ``positions``, the training
    position of each copy.

    A source takes whole passes over its documents, then those whose middle lies before the rest of its target; so it
    ends within half of its boundary document. ``cap`` passes at most keep every document below ``cap`` times its size.
    """
    key = [KEY] if KEY in docs.columns else []  # carried along for mix()
    sized = stored(docs.select(*key, "doc_id", "source", words_of("text").alias("size")), "sizes")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    cumulated = running_sums(
        sized.withColumns({"_h": order, "_last": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))}),
        ["_h", "size"], {"_cum": F.col("size")}, ["_last", "_name"], block)
    # The targets reach each row through their source; a few numbers per source, so the hot side isn't moved.
    targets = source_targets(sized, weights, tilts, share, cap, block).withColumns(
        {"_last": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))}).drop("source")
    rows = cumulated.join(F.broadcast(targets) if is_small(targets) else targets, ["_last", "_name"])
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    middle = F.col("_cum") - F.col("size") / 2
    left = F.col("target") - F.col("_passes") * F.col("source_size")
    rows = rows.withColumn("_passes", passes).withColumn(
        "copies", F.when(F.col("size") > 0, F.col("_passes") + F.when(middle < left, 1).otherwise(0)).otherwise(0).cast("int"))
    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array().cast("array<int>"))

    def at(copy: Column) -> Column:
        x = F.least(F.lit(1.0), (copy * F.col("source_size") + middle) / F.col("target"))
        inside = (1 - F.col("tilt")) * (1 - F.col("tilt")) + 4 * F.col("tilt") * x
        return 2 * x / ((1 - F.col("tilt")) + F.sqrt(inside))

    return rows.withColumn("positions", F.transform(copies, at)) \
        .select(*key, "doc_id", "source", "size", "source_size", "target", "copies", "positions")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every copy of every taken document with all columns of ``docs``, range-sorted by training position. Columns of any name pass
    through; rows whose id is missing or repeated are told apart by a key of their own.
    """
    needed = ("doc_id", "source", "text")
    named, _ = with_row_keys(set_aside(docs, needed))
    placed = plan(named, **options).where("copies > 0").select(KEY, F.explode("positions").alias("_p"))
    return put_back(named.join(placed, KEY).orderBy("_p", KEY), docs.columns, needed)


SQL = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
sources AS (SELECT *, [3.0, 1.0, 2.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS weight, [0.5, -0.5, 0.0][((rank - 1) % 3 + 1)::INT]::DOUBLE AS tilt, 2.0::DOUBLE * source_size AS full_size FROM sums),
steps AS (SELECT *, full_size / weight AS ratio, sum(full_size) OVER w AS done, sum(weight) OVER w AS used, sum(weight) OVER () AS all_weight, 1.5::DOUBLE * sum(source_size) OVER () AS demand
  FROM sources WINDOW w AS (ORDER BY full_size / weight, rank ROWS UNBOUNDED PRECEDING)),
levels AS (SELECT *, (demand - (done - full_size)) / (all_weight - used + weight) AS level FROM steps),
chosen AS (SELECT min_by(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (SELECT source, source_size, tilt, round(CASE WHEN c.level IS NULL THEN full_size ELSE least(full_size, c.level * weight) END, 6) AS target FROM sources, chosen c),
cumulated AS (SELECT s.*, t.source_size, t.target, t.tilt, sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(s.doc_id::VARCHAR, '')), s.size ROWS UNBOUNDED PRECEDING)::DOUBLE - s.size::DOUBLE / 2 AS middle
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
passed AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes FROM cumulated),
taken AS (SELECT *, CASE WHEN size > 0 THEN passes + CASE WHEN middle < target - passes * source_size THEN 1 ELSE 0 END ELSE 0 END AS copies FROM passed)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size)::BIGINT AS taken,
  CASE WHEN copies > 0 THEN round(2 * least(1.0, middle / target) / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * least(1.0, middle / target))), 6) END AS first_position
FROM taken
"""
