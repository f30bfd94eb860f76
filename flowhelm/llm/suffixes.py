"""Suffix dedup by distributed prefix doubling over sampled positions.

Two positions are repeats if the ``length`` bytes that follow them are equal. Prefix doubling ranks positions by a short
prefix, then by pairs of ranks at growing offsets, and drops a position as soon as its rank is unique or its prefix
passes the threshold. Ranks only have to say equal or not, so a rank is a fingerprint of the bytes and the rank at an
offset is computed where the text is; what Spark sorts are the keys that decide whether a rank is unique.

1. Every window of ``length`` bytes elects one ``GRAM``-byte position inside it (the smallest hash, the rightmost of equal
   ones), which depends on its bytes alone; neighbouring windows mostly elect the same one. So about one position in
   ``(length - GRAM) / 2`` is ranked, and equal windows meet at equal ranks. Positions with a unique rank drop out.
2. The windows of an elected position form a run of text. Equal runs of one rank are copies: all but the first by
   (doc_id, position) are covered. The first ones stay if their rank has different runs and is still shared when it grows
   to the offset that every window reaches on one of its sides.
3. For those, the windows themselves are ranked by the pair of half-length ranks at offset 0 and at the offset that
   reaches the threshold; all but the first window of equal pairs are covered.

Every covered window removes its bytes. Matches never cross documents, and windows are judged on the input. Null texts
are empty; null doc_ids come after all others; rows that repeat a doc_id are different documents behind each other
(ordered by text); texts shorter than ``length`` keep all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.llm.columns import KEY, with_row_keys
from flowhelm.llm.text import Spans, as_long, mix, pieces
from flowhelm.plans.lookup import is_small
from flowhelm.session import stored

LENGTH = 100
GRAM = 32
_LOW = np.uint64((1 << 31) - 1)


def _windows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows that elect the same position: row, first and last window start, elected position."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, None
    spans = Spans(data, 5)
    hashes = spans.grams(gram)
    best = (hashes & ~_LOW) | (_LOW - np.arange(len(hashes), dtype=np.uint64))
    width, size = length - gram + 1, 1
    while size * 2 <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    count = np.maximum(np.diff(offsets) - length + 1, 0)
    row = np.repeat(np.arange(len(count)), count)
    at = offsets[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    elected = (_LOW - (best[at] & _LOW)).astype(np.int64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (elected[1:] != elected[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return row[first], at[first], at[last], elected[first], spans


def _elected(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(rank, run, sides, doc, start, more): rank of the elected bytes, name of the whole run, short names of the elected
    bytes with what stands left and right of them, first window, further windows."""
    side = (length - gram + 1) // 2

    def elect(batches):
        for batch in batches:
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            for at, offsets, data in pieces(batch.column("text")):
                row, first, last, position, spans = _windows(data, offsets, length, gram)
                if not len(row):
                    continue
                run = spans.hash(first, last + length) + mix((position - first).astype(np.uint64))
                alone = mix((ids[at + row].astype(np.uint64) << np.uint64(32)) + position.astype(np.uint64))  # no room: like no other
                lo, hi = position - side, position + gram + side
                left = np.where(lo >= offsets[:-1][row], spans.hash(np.maximum(lo, 0), position + gram), alone)
                right = np.where(hi <= offsets[1:][row], spans.hash(position, np.minimum(hi, len(data))), alone)
                sides = (left & ~np.uint64(0xFFFFFFFF)) | (right >> np.uint64(32))
                yield pa.RecordBatch.from_arrays(
                    [as_long(spans.hash(position, position + gram)), as_long(run), as_long(sides), pa.array(ids[at + row]), pa.array((first - offsets[:-1][row]).astype(np.int32)), pa.array((last - first).astype(np.int32))],
                    ["rank", "run", "sides", "doc", "start", "more"])

    return docs.mapInArrow(elect, "rank long, run long, sides long, doc long, start int, more int")


def _pairs(rows: DataFrame, length: int) -> DataFrame:
    """(a, b, doc, start) of the windows listed in ``runs`` (start and number as 32-bit pairs): their rank pairs."""
    half = (length + 1) // 2

    def rank(batches):
        for batch in batches:
            ids, runs = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("runs")
            for at, offsets, data in pieces(batch.column("text")):
                spans = Spans(data, 6)
                for r in range(len(offsets) - 1):
                    listed = np.array([(x["start"], x["more"]) for x in runs[at + r].as_py()], dtype=np.int64).reshape(-1, 2)
                    n = listed[:, 1] + 1
                    start = np.unique(np.repeat(listed[:, 0], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    here = offsets[r] + start
                    yield pa.RecordBatch.from_arrays(
                        [as_long(spans.hash(here, here + half)), as_long(spans.hash(here + (length - half), here + length)), pa.array(np.full(len(start), ids[at + r])), pa.array(start.astype(np.int32))],
                        ["a", "b", "doc", "start"])

    return rows.mapInArrow(rank, "a long, b long, doc long, start int")


def _merge(pairs: list, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under windows given as (start, further windows)."""
    x = np.array(pairs, dtype=np.int64).reshape(-1, 2)
    x = x[np.argsort(x[:, 0], kind="stable")]
    end = np.maximum.accumulate(x[:, 0] + x[:, 1] + length)
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:, 0] > end[:-1]
    first = np.flatnonzero(new)
    return x[first, 0], end[np.append(first[1:], len(x)) - 1]


def covered_windows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, start, more): windows that also start earlier. ``docs``: doc (unique, in order), text."""
    found = _elected(docs, length, gram)
    same = Window.partitionBy("rank", "run")
    rank = Window.partitionBy("rank")
    marked = found.withColumn("_first", F.min(F.struct("doc", "start")).over(same)) \
        .withColumn("_first", F.struct("doc", "start") == F.col("_first")) \
        .withColumns({"_n": F.count(F.lit(1)).over(rank), "_r0": F.min("run").over(rank), "_r1": F.max("run").over(rank)})
    kept = stored(marked.where((F.col("_n") > 1) & (~F.col("_first") | (F.col("_r0") != F.col("_r1"))))
                  .select("rank", "sides", "doc", "start", "more", F.col("_first").alias("open")), "ranks")
    # A window has half of its other bytes left or right of the elected ones: a longer rank on one side must be shared.
    left, right = (F.count(F.lit(1)).over(Window.partitionBy("rank", F.expr(half))) for half in ("shiftright(sides, 32)", "sides & 4294967295"))
    runs = kept.where("open").withColumns({"_l": left, "_r": right}).where("_l > 1 OR _r > 1").groupBy("doc").agg(F.collect_list(F.struct("start", "more")).alias("runs"))
    pairs = _pairs(_with_texts(docs, runs), length)
    earliest = F.min(F.struct("doc", "start")).over(Window.partitionBy("a", "b"))
    single = pairs.withColumn("_first", earliest).where(F.struct("doc", "start") != F.col("_first")).select("doc", "start", F.lit(0).alias("more"))
    return kept.where("NOT open").select("doc", "start", "more").unionByName(single)


def _with_texts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Inner join on doc; only texts that are listed move when the counted list of names may be broadcast."""
    lists = stored(lists, "lists")
    names = lists.select("doc")
    if is_small(names):
        docs = docs.join(F.broadcast(names), "doc", "left_semi")
    return docs.join(lists, "doc")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    if not gram < length:
        raise ValueError("a gram must be shorter than the windows")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = with_row_keys(plain)[0].withColumnRenamed(KEY, "doc")
    covered = covered_windows(named, length, gram)
    lists = stored(covered.groupBy("doc").agg(F.collect_list(F.struct("start", "more")).alias("cover")), "cover")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"

    def cut(batches):
        for batch in batches:
            covers = batch.column("cover") if "cover" in batch.schema.names else None
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            for r, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode()
                out["n_bytes"].append(len(data))
                cover = covers[r].as_py() if covers is not None else None
                removed = spans = 0
                if cover:
                    start, end = _merge([(x["start"], x["more"]) for x in cover], length)
                    removed, spans = int((end - start).sum()), len(start)
                    at, parts = 0, []
                    for a, b in zip(start.tolist(), end.tolist(), strict=True):
                        parts.append(data[at:a])
                        at = b
                    data = b"".join([*parts, data[at:]])
                out["n_removed"].append(removed)
                out["n_spans"].append(spans)
                out["kept"].append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(out[k], pa.int64()) for k in ("n_bytes", "n_removed", "n_spans")], pa.array(out["kept"], pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    names = lists.select("doc")
    if is_small(names):
        touched = named.join(F.broadcast(names), "doc", "left_semi").join(lists, "doc").select("doc_id", "text", "cover").mapInArrow(cut, schema)
        whole = named.join(F.broadcast(names), "doc", "left_anti").select("doc_id", "text").mapInArrow(cut, schema)
        return touched.unionByName(whole)
    return named.join(lists, "doc", "left").select("doc_id", "text", "cover").mapInArrow(cut, schema)
