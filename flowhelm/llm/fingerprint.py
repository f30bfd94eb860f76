"""Document fingerprints by winnowing, as native expressions.

A text's k-grams are runs of ``k`` UTF-8 bytes. Each gets a hash; of every ``window`` consecutive hashes the smallest is
chosen, the rightmost of equal ones, and chosen hashes are kept with their byte position. Any two texts that share a
passage of ``window + k - 1`` bytes share a chosen hash at the same place of the passage, and matches shorter than ``k``
bytes are never seen. A shorter text is one gram; an empty or null text has no grams.

A choice is one long: 33 bits of hash above 30 bits of position counted from the end, so the smallest long is the
rightmost smallest hash; any string that fits a row fits these positions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.plans.ordered import cut_rows, place

K = 12
WINDOW = 16
_POSITIONS = (1 << 30) - 1


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _minima(choices: Column, window: int) -> Column:
    """Minima of all runs of ``window`` (a square) neighbours, as minima of minima; with fewer, of all."""
    side = math.isqrt(window)

    def step(values: Column, stride: int) -> Column:
        starts = F.sequence(F.lit(0), F.size(values) - 1 - (side - 1) * stride)
        return F.transform(starts, lambda i: F.least(*[F.get(values, i + j * stride) for j in range(side)]))

    return F.when(F.size(choices) >= window, _once(step(choices, 1), lambda low: step(low, side))) \
        .when(F.size(choices) > 0, F.array(F.array_min(choices))).otherwise(choices)


def _grams(data: Column, k: int, offset: Column | int = 0) -> Column:
    """Packed (hash, position) of all grams of some bytes that begin at byte ``offset`` of their text."""
    n = F.greatest(F.length(data) - (k - 1), F.least(F.length(data), F.lit(1)))
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    at = _POSITIONS - (F.lit(0) + offset).cast("long")

    def gram(of: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.substring(of, i, F.lit(k))), 31), 30) + (at - i)

    # The bytes are bound once: a reference to a binary column inside a lambda would copy them for every gram.
    return _once(F.struct(data.alias("d"), starts.alias("i")), lambda x: F.transform(x["i"], lambda i: gram(x["d"], i)))


def winnow(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Add ``out``: the chosen (hash, position) of a text in reading order, packed (see :func:`hashes`, :func:`positions`);
    and ``_g``, ``_m``: all its grams and the minima of all windows, which :func:`winnow_edit` reuses."""
    return df.withColumn("_d", F.encode(F.coalesce(text, F.lit("")), "UTF-8")).withColumn("_g", _grams(F.col("_d"), k)) \
        .withColumn("_m", _minima(F.col("_g"), window)).withColumn(out, F.array_distinct("_m")).drop("_d")


def winnow_edit(df: DataFrame, edited: str, kept_bytes: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Add ``out`` for a text that shares its first ``kept_bytes`` bytes with the text of ``_g`` and ``_m``: windows
    inside these bytes are taken over, only the others are built."""
    same = F.col(kept_bytes) - (k + window - 2)  # windows that lie inside the kept bytes
    data = F.encode(F.col(edited), "UTF-8")
    fresh = F.concat(
        F.slice("_g", F.col("_same") + 1, F.lit(window - 1)),
        _grams(F.substring(data, F.col("_same") + window, F.length(data)), k, F.col("_same") + window - 1))
    whole = (same > 0) & (F.octet_length(edited) >= F.col(kept_bytes) + 1)
    grams = F.when(F.col("_whole"), fresh).otherwise(_grams(data, k))
    return df.withColumns({"_same": same, "_whole": whole}).withColumn("_eg", grams).withColumn("_em", _minima(F.col("_eg"), window)) \
        .withColumn("_em", F.when(F.col("_whole"), F.concat(F.slice("_m", F.lit(1), F.greatest(F.col("_same"), F.lit(0))), F.col("_em"))).otherwise(F.col("_em"))) \
        .withColumn(out, F.array_distinct("_em")).drop("_same", "_whole", "_eg", "_em")


def hashes(chosen: Column) -> Column:
    return F.transform(chosen, lambda c: F.shiftright(c, 30))


def positions(chosen: Column) -> Column:
    """Byte positions, from 0."""
    return F.transform(chosen, lambda c: (_POSITIONS - 1 - c.bitwiseAND(F.lit(_POSITIONS))).cast("int"))


def as_text(chosen: Column) -> Column:
    """Chosen hashes in reading order, in hexadecimal."""
    return F.array_join(F.transform(hashes(chosen), F.hex), ",")


def likeness(a: Column, b: Column) -> Column:
    """Share of common hashes among all of two fingerprints (distinct hashes); two empty ones are alike."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - common
    return F.when(every == 0, F.lit(1.0)).otherwise(common / every)


ROWS_PER_BLOCK = 1_000


def with_next(docs: DataFrame, value: str, name: str, rows_per_block: int = ROWS_PER_BLOCK, before=lambda df: df) -> DataFrame:
    """Add ``name``: ``value`` in the next row by descending doc_id (null ids last; after the last row: of the first).

    Rows meet in blocks of the id order, so the table is shuffled once. The row at the edge of a block, and the row with
    the largest id, are also copied to the block that looks back at them. ``before`` derives columns from the rows of a
    block after they are shuffled; ``value`` may be one of them.
    """
    rows = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "_tie": F.xxhash64("text")})
    order = ["_id", "_tie"]
    cuts = cut_rows(rows, order, (), rows_per_block)
    last = rows.select(F.max(F.struct(*order))).first()[0]
    if cuts:
        rows = place(rows, order, cuts).withColumnRenamed("_blk", "_halo")
        rows = place(rows, order, cuts, after_cut=True).withColumnRenamed("_blk", "_own")
    else:
        rows = rows.withColumns({"_halo": F.lit(0), "_own": F.lit(0)})
    top = F.lit(False) if last is None else (F.col("_id") == last[0]) & (F.col("_tie") == last[1])

    def to(block: Column, kind: int) -> Column:
        return F.struct(block.alias("blk"), F.lit(kind).alias("kind"))

    # kind 0: the largest row ahead of the first block; 1: an edge row ahead of its next block; 2: the row itself.
    targets = F.array_compact(F.array(to(F.col("_own"), 2), F.when(F.col("_halo") != F.col("_own"), to(F.col("_halo"), 1)), F.when(top, to(F.lit(0), 0))))
    spread = rows.withColumn("_to", F.explode(targets)).withColumns({"_blk": F.col("_to.blk"), "_kind": F.col("_to.kind")}).drop("_to", "_own", "_halo")
    dealt = before(spread.repartition("_blk").sortWithinPartitions("_blk", "_kind", *order))
    behind = Window.partitionBy("_blk").orderBy("_kind", *order)
    return dealt.withColumn(name, F.lag(value).over(behind)).where("_kind = 2").drop("_blk", "_kind", *order)


def compare_edits(docs: DataFrame, k: int = K, window: int = WINDOW, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Fingerprints of every text and of its edit: the last third of its code points replaced by the first as many of the
    next document's (see :func:`with_next`); with the likeness of the first to the second and to the next document's."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(own, "_both", "_next", rows_per_block, before=lambda df: winnow(df, "text", "_f", k, window)
                     .withColumn("_s", F.array_distinct(hashes(F.col("_f")))).withColumn("_both", F.struct("text", "_s")))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumns({"n_chars": n.cast("long"), "_head": F.substring("text", F.lit(1), n - third)}) \
        .withColumns({"_edit": F.concat("_head", F.substring(F.col("_next.text"), F.lit(1), third)), "_kept": F.octet_length("_head")})
    rows = winnow_edit(rows, "_edit", "_kept", "_ef", k, window)
    return rows.select(
        "doc_id", "n_chars", F.sha2("_edit", 256).alias("edited_sha256"), as_text(F.col("_f")).alias("fingerprint"), as_text(F.col("_ef")).alias("edited_fingerprint"),
        likeness(F.col("_s"), F.array_distinct(hashes(F.col("_ef")))).alias("near_edited"), likeness(F.col("_s"), F.col("_next._s")).alias("near_next"))
