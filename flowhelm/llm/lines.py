"""Line dedup: a sharded minimal perfect hash over line hashes indexes compact fingerprint and count arrays.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; 128 bits of hash name it. Keys of at
least ``least_chars`` code points that occur in at least two documents lose all their lines except in the document with
the smallest doc_id among them. The steps:

1. every batch of documents reduces its lines to one row per key (first and last document, number of documents), so a
   line that stands in every document costs a row per batch; a group-by finds the repeated keys;
2. their hashes are dealt to shards, each with a minimal perfect hash, fingerprints, counts and first documents, written
   as one row of the shared folder;
3. documents send their line hashes, packed per batch and shard, to these arrays; what comes back are the hashes that a
   document loses. There are enough shards for all lines, found or not; shards whose keys occur very often are copied and
   their probes dealt over the copies;
4. documents join with their own lost hashes and are cut.

Null or empty texts are one empty line and stay as they are (null stays null). Rows without a doc_id are
documents of their own behind all others, in the order of their texts; rows that repeat a doc_id are the same document, so their lines are not copies of each other. Ties don't
exist: hashes are distinct and the smallest doc_id decides. Columns of any name pass through, but `n_lines` and `n_dropped` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowhelm.llm import mph
from flowhelm.llm.columns import put_back, set_aside
from flowhelm.llm.text import IS_SPACE, LOWER, Spans, as_long, pieces
from flowhelm.plans.ordered import number
from flowhelm.session import stored

KEYS_PER_SHARD = 250_000
PROBES_PER_COPY = 2_000_000
_NULL_ID = 1 << 62  # rows without an id are numbered behind this


def _line_keys(data: np.ndarray, offsets: np.ndarray, least_chars: int):
    """Of all lines: row, start, end, and which have a key that counts; of these: both hashes."""
    breaks = np.flatnonzero(data == 10)
    rows = np.arange(len(offsets) - 1)
    start = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([rows, np.searchsorted(offsets, breaks, side="right") - 1])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.concatenate([start[1:] - 1, [len(data)]])
    last = np.concatenate([row[1:] != row[:-1], [True]])
    end[last] = offsets[row[last] + 1]
    solid = np.flatnonzero(~IS_SPACE[data])
    first = np.searchsorted(solid, start)
    behind = np.searchsorted(solid, end)
    full = behind > first
    lo = np.where(full, solid[np.minimum(first, len(solid) - 1)], 0) if len(solid) else np.zeros(len(start), np.int64)
    hi = np.where(full, solid[np.maximum(behind - 1, 0)] + 1, 0) if len(solid) else lo
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    counts = chars[hi] - chars[lo] >= least_chars
    lower = LOWER[data]
    lo, hi = lo[counts], hi[counts]
    return row, start, end, counts, Spans(lower, 1).hash(lo, hi), Spans(lower, 2).hash(lo, hi)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("_doc").to_numpy(zero_copy_only=False), dtype=np.int64)


def _batch_keys(batch: pa.RecordBatch, least_chars: int):
    """Distinct (document, key) of a batch."""
    ids, docs, low, high = _ids(batch), [], [], []
    for at, offsets, data in pieces(batch.column("text")):
        row, _, _, counts, a, b = _line_keys(data, offsets, least_chars)
        docs.append(ids[at + row[counts]])
        low.append(a)
        high.append(b)
    if not docs:
        return None
    docs, low, high = np.concatenate(docs), np.concatenate(low), np.concatenate(high)
    order = np.lexsort((docs, high, low))
    docs, low, high = docs[order], low[order], high[order]
    fresh = np.ones(len(docs), dtype=bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return docs[fresh], low[fresh], high[fresh]


def repeated_keys(docs: DataFrame, least_chars: int) -> DataFrame:
    """(low, high, first, n) of the keys that occur in two documents or more."""

    def reduce(batches):
        for batch in batches:
            got = _batch_keys(batch, least_chars)
            if got is None or not len(got[0]):
                continue
            ids, low, high = got
            new = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(ids))
            yield pa.RecordBatch.from_arrays(
                [as_long(low[begin]), as_long(high[begin]), as_long(ids[begin]), as_long(ids[end - 1]), as_long(end - begin)], ["low", "high", "first", "last", "n"])

    found = docs.mapInArrow(reduce, "low long, high long, first long, last long, n long")
    return found.groupBy("low", "high").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")) \
        .where(F.col("first") != F.col("last")).drop("last")


_SHARD = "shard int, sizes binary, bits binary, fingerprint binary, first binary, n binary, probes long"


def _build(key: tuple, keys: pa.Table) -> pa.Table:
    low, high, first, n = (np.asarray(keys.column(c)) for c in ("low", "high", "first", "n"))
    low, high = low.view(np.uint64), high.view(np.uint64)
    sizes, bits = mph.build(low, high)
    at = mph.Index(sizes, bits).find(low, high)
    arrays = []
    for x in (high, first, np.minimum(n, (1 << 32) - 1).astype(np.uint32)):
        placed = np.empty_like(x)
        placed[at] = x
        arrays.append(placed.tobytes())
    return pa.table([[key[0].as_py()], [sizes.tobytes()], [np.packbits(bits).tobytes()], *[[x] for x in arrays], [int(n.sum())]],
                    schema=pa.schema([("shard", pa.int32()), *[(c, pa.binary()) for c in ("sizes", "bits", "fingerprint", "first", "n")], ("probes", pa.int64())]))


def _lost(key: tuple, probes: pa.Table, shards: pa.Table) -> pa.Table:
    """Of the probes of a shard, the keys that a document loses, packed by document."""
    schema = pa.schema([("_doc", pa.int64()), ("lost", pa.binary())])
    if not len(shards) or not len(probes):
        return schema.empty_table()
    get = lambda c, kind: np.frombuffer(shards.column(c)[0].as_py(), dtype=kind)
    sizes = get("sizes", np.int64)
    index = mph.Index(sizes, np.unpackbits(get("bits", np.uint8), count=int(sizes.sum())).astype(bool))
    fingerprint, first = get("fingerprint", np.uint64), get("first", np.int64)
    docs, keys = [], []
    for at in range(len(probes)):
        ids = np.frombuffer(probes.column("docs")[at].as_py(), dtype=np.int64)
        pairs = np.frombuffer(probes.column("keys")[at].as_py(), dtype=np.uint64).reshape(-1, 2)
        number = index.find(pairs[:, 0], pairs[:, 1])
        hit = number >= 0
        hit[hit] = (fingerprint[number[hit]] == pairs[hit, 1]) & (first[number[hit]] != ids[hit])
        docs.append(ids[hit])
        keys.append(pairs[hit])
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    if not len(docs):
        return schema.empty_table()
    order = np.argsort(docs, kind="stable")
    docs, keys = docs[order], keys[order]
    begin = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]]))
    raw = keys.tobytes()
    end = np.append(begin[1:], len(docs))
    return pa.table([docs[begin], [raw[16 * a : 16 * b] for a, b in zip(begin, end, strict=True)]], schema=schema)


def _named(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_doc``, the document of a row: its id; rows without one are documents of their own, behind all others in the order of their
    texts."""
    missing = docs.where("doc_id IS NULL")
    if missing.isEmpty():
        return docs.withColumn("_doc", F.col("doc_id").cast("long"))
    numbered = number(missing.withColumn("_row", F.monotonically_increasing_id()), ["text", "_row"], name="_doc").drop("_row")
    own = numbered.withColumn("_doc", F.col("_doc") + F.lit(_NULL_ID))
    return stored(docs.where("doc_id IS NOT NULL").withColumn("_doc", F.col("doc_id").cast("long")).unionByName(own), "named")


def dedup_lines(docs: DataFrame, least_chars: int = 10, keys_per_shard: int = KEYS_PER_SHARD, probes_per_copy: int = PROBES_PER_COPY) -> DataFrame:
    """``docs`` with cut texts, and ``n_lines`` (before), ``n_dropped``."""
    spark = docs.sparkSession
    outer, needed = docs.columns, ("doc_id", "text")
    docs = _named(set_aside(docs, needed))
    identified = docs.select("_doc", F.col("text").cast("string").alias("text"))
    keys = stored(repeated_keys(identified, least_chars), "line_keys")
    # Lines that count are at least ``least_chars`` bytes and a break, so this bounds both what a shard holds and what asks it.
    n_bytes = identified.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(1, -(-keys.count() // keys_per_shard), -(-n_bytes // ((least_chars + 1) * probes_per_copy)))
    arrays = stored(keys.withColumn("shard", F.pmod("low", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(_build, _SHARD), "line_arrays")
    # A shard with many probes is read by several tasks: at most (lines / probes_per_copy) shards are listed here.
    copies = {r.shard: -(-r.probes // probes_per_copy) for r in arrays.where(F.col("probes") > probes_per_copy).select("shard", "probes").collect()}

    def probe(batches):
        for number, batch in enumerate(batches):
            got = _batch_keys(batch, least_chars)
            if got is None or not len(got[0]):
                continue
            ids, low, high = got
            shard = (low.view(np.int64) % shards).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            begin = np.searchsorted(shard[order], np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(begin)):
                rows = order[begin[s] : begin[s + 1]]
                copy = int((int(ids[0]) + number) % copies.get(int(s), 1))
                pairs = np.stack([low[rows], high[rows]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(s)], pa.int32()), pa.array([copy], pa.int32()), pa.array([ids[rows].tobytes()], pa.binary()), pa.array([pairs.tobytes()], pa.binary())],
                    ["shard", "copy", "docs", "keys"])

    probes = identified.mapInArrow(probe, "shard int, copy int, docs binary, keys binary")
    extra = spark.createDataFrame([(s, n) for s, n in copies.items()] or [(-1, 1)], "shard int, copies long")
    copied = arrays.join(F.broadcast(extra), "shard", "left") \
        .withColumn("copy", F.explode(F.sequence(F.lit(0), (F.coalesce("copies", F.lit(1)) - 1).cast("int")))).drop("copies")
    lost = probes.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy")).applyInArrow(_lost, "_doc long, lost binary")
    lost = lost.groupBy("_doc").agg(F.collect_list("lost").alias("_lost"))
    joined = docs.join(lost, "_doc", "left").drop("_doc")
    names = [c for c in docs.columns if c != "_doc"]
    text_at = names.index("text")

    def cut(batches):
        for batch in batches:
            text, lost = batch.column("text"), batch.column("_lost")
            n_lines, n_dropped = np.ones(len(text), dtype=np.int64), np.zeros(len(text), dtype=np.int64)
            fresh: list[str | None] = [None] * len(text)
            has = np.asarray(lost.is_valid()) & np.asarray(text.is_valid())
            for at, offsets, data in pieces(text):
                breaks = np.flatnonzero(data == 10)
                n_lines[at : at + len(offsets) - 1] += np.bincount(np.searchsorted(offsets, breaks, side="right") - 1, minlength=len(offsets) - 1)
                for r in np.flatnonzero(has[at : at + len(offsets) - 1]):
                    own = data[offsets[r] : offsets[r + 1]]
                    _, start, end, counts, low, high = _line_keys(own, np.array([0, len(own)]), least_chars)
                    gone = np.frombuffer(b"".join(lost[at + int(r)].as_py()), dtype=np.uint64).reshape(-1, 2)
                    gone = set(map(tuple, gone.tolist()))
                    drop = np.zeros(len(start), dtype=bool)
                    drop[counts] = [x in gone for x in zip(low.tolist(), high.tolist(), strict=True)]
                    n_dropped[at + r] = drop.sum()
                    raw = own.tobytes()
                    fresh[at + int(r)] = b"\n".join(raw[a:b] for a, b in zip(start[~drop], end[~drop], strict=True)).decode("utf-8")
            columns = [batch.column(c) for c in names]
            columns[text_at] = pa.array([f if h else t.as_py() for f, h, t in zip(fresh, has, text, strict=True)], pa.string()) if has.any() else text.cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines), pa.array(n_dropped)], [*names, "_n_lines", "_n_dropped"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "_doc")
    done = joined.mapInArrow(cut, f"{kinds}, _n_lines long, _n_dropped long")
    done = done.withColumnsRenamed({"_n_lines": "n_lines", "_n_dropped": "n_dropped"})
    return put_back(done, outer, needed, ("n_lines", "n_dropped"))


SQL = r"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, coalesce(f.first <> doc_id, false) AS gone FROM keyed LEFT JOIN firsts f ON keyed.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
