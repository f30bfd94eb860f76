"""LM scoring by deleted interpolation of n-gram estimates.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text with A-Z lower-cased, then one end. The probability of a token is

    a * c(previous, token) / c(previous) + b * c(token) / N + c / (V + 1),

maximum-likelihood estimates of falling order, mixed by weights a + b + c = 1 that depend on the bucket (power of two) of
the context's frequency. The weights are learnt on counts the estimates have not seen: a tenth of the training documents
is deleted from the counts and expectation-maximisation fits the weights of every bucket to the tokens of that tenth.
The scores then use the counts of all training documents.

How counts meet tokens without a row per token: the corpus is cut into chunks of some megabytes. A chunk sends every
distinct word and word pair once, as sorted 64-bit names packed per shard; a shard adds up the counts of equal names and
sends them back in the same order. So a frequent word costs one entry a chunk, no key is hot, and all counts cover all
training documents. Chunks and their counts are then written, packed, and both the fit and the scoring read them.

Null or empty texts are one end token; null doc_ids are held in training as if their text were empty (crc32 of the empty
string decides); repeated rows are documents of their own; an empty table gives no rows; without training tokens the
estimates are 0 and only the uniform part is left.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowhelm.llm.text import LOWER, Spans, constants, mix, pieces, row_bounds, words
from flowhelm.session import stored

CHUNK_BYTES = 6 << 20
KEYS_PER_SHARD = 1_000_000
BYTES_PER_KEY = 7  # of text, about, for a distinct pair in a chunk
FOLDS = 10
CELL = 8  # cells per doubling of an estimate
_END, _START = (np.uint64(x) for x in constants(91, 2))
_PAIR = constants(92, 2)


def _pack(x: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed planes of bytes."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit names: planes of their differences."""
    planes = np.ascontiguousarray(np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpack_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of all tokens, an end after each text; and the number of tokens of each text."""
    found, sizes = [], []
    for _, offsets, data in pieces(texts):
        data = LOWER[data]
        start, end, row = words(data, offsets)
        bounds = row_bounds(row, len(offsets) - 1)
        found.append(np.insert(Spans(data, 9).hash(start, end), bounds[1:], _END))
        sizes.append(np.diff(bounds) + 1)
    return (np.concatenate(found), np.concatenate(sizes)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _batches(batch: pa.RecordBatch, limit: int):
    """A batch in runs of rows of about ``limit`` bytes, at least one row each."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0))
    part = np.cumsum(size) // limit
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(size)]])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


_CHUNKS = "chunk long, ids binary, known binary, held binary, sizes binary, names binary, tokens binary"


def chunks(docs: DataFrame, held_out: int, modulus: int, limit: int) -> DataFrame:
    """The corpus as chunks: doc_ids (and which are not null), use of each document (0 train, 1 deleted from the counts for
    the fit, 2 held out), tokens per document, the distinct words' names in order, and the tokens as places in it."""

    def cut(batches):
        part, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in _batches(whole, limit):
                ids = batch.column("doc_id")
                sums = [zlib.crc32(b"" if i is None else str(i).encode()) for i in ids.to_pylist()]
                held = np.array([2 if c % modulus == held_out else int(c // modulus % FOLDS == 0) for c in sums], dtype=np.uint8)
                tokens, sizes = _tokens(batch.column("text"))
                names, places = np.unique(tokens, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | number]), *[pa.array([x], pa.binary()) for x in (
                        np.asarray(ids.fill_null(0)).tobytes(), np.asarray(ids.is_valid()).astype(np.uint8).tobytes(), held.tobytes(), _pack(sizes), _pack_keys(names), _pack(places))]],
                    ["chunk", "ids", "known", "held", "sizes", "names", "tokens"])
                number += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _CHUNKS)


def _grams(names: np.ndarray, tokens: np.ndarray, sizes: np.ndarray):
    """Place of the context of every token (-1: the start), and the names of the pairs."""
    first = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], tokens[:-1]]).astype(np.int64)
    before[first] = -1
    context = np.where(before < 0, _START, names[before])
    return before, mix(context * _PAIR[0] + names[tokens] * _PAIR[1])


def _requests(stored_chunks: DataFrame, shards: int) -> DataFrame:
    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names, tokens, sizes = _unpack_keys(row["names"]), _unpack(row["tokens"]).astype(np.int64), _unpack(row["sizes"])
                use = np.repeat(np.frombuffer(row["held"], np.uint8), sizes)
                pairs, place = np.unique(_grams(names, tokens, sizes)[1], return_inverse=True)
                for kind, keys, at in ((0, names, tokens), (1, pairs, place)):
                    counts = [np.bincount(at[use == u], minlength=len(keys)) for u in (0, 1)]
                    # Shards are ranges of names, so the answers of all shards behind each other are in order again.
                    edge = np.searchsorted(keys, (np.arange(1, shards, dtype=np.float64) / shards * 2**64).astype(np.uint64)) if shards > 1 else np.zeros(0, np.int64)
                    edges = np.concatenate([[0], edge, [len(keys)]]).astype(np.int64)
                    for s in np.flatnonzero(np.diff(edges)):
                        a, b = edges[s], edges[s + 1]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind], pa.int32()), pa.array([int(s)], pa.int32()), pa.array([row["chunk"]]), *[pa.array([x], pa.binary()) for x in (_pack_keys(keys[a:b]), _pack(counts[0][a:b]), _pack(counts[1][a:b]))]],
                            ["kind", "shard", "chunk", "keys", "kept", "deleted"])

    return stored_chunks.mapInArrow(send, "kind int, shard int, chunk long, keys binary, kept binary, deleted binary")


_ANSWER = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("kept", pa.binary()), ("deleted", pa.binary())])


def _answer(key: tuple, asked: pa.Table) -> pa.Table:
    """Counts of a shard's names over all chunks, for each chunk in its order; and for chunk -1 the totals."""
    kind, shard = key[0].as_py(), key[1].as_py()
    parts = [_unpack_keys(x.as_py()) for x in asked.column("keys")]
    ends = np.cumsum([len(p) for p in parts])
    names, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = [np.bincount(place, np.concatenate([_unpack(x.as_py()) for x in asked.column(c)]), len(names)).astype(np.int64) for c in ("kept", "deleted")]
    rows = {"chunk": asked.column("chunk").to_pylist(), "kept": [], "deleted": []}
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        rows["kept"].append(_pack(total[0][place[a:b]]))
        rows["deleted"].append(_pack(total[1][place[a:b]]))
    if kind == 0:
        both = total[0] + total[1]
        rows["chunk"].append(-1)
        rows["kept"].append(np.array([total[0].sum(), (total[0] > 0).sum()], dtype=np.int64).tobytes())
        rows["deleted"].append(np.array([both.sum(), (both > 0).sum()], dtype=np.int64).tobytes())
    n = len(rows["chunk"])
    return pa.table([rows["chunk"], [kind] * n, [shard] * n, rows["kept"], rows["deleted"]], schema=_ANSWER)


_COUNTED = "chunk long, ids binary, known binary, held binary, sizes binary, single binary, pair binary, cells binary, totals binary"


def _log_cell(p: np.ndarray) -> np.ndarray:
    """Number of the cell of a positive estimate; 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.rint(np.log2(np.maximum(p, 1e-300)) * CELL) + 4096, 0).astype(np.int64)


def bucket(count: np.ndarray) -> np.ndarray:
    """Power of two of a context's frequency, from 1; 0 for contexts never seen."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _counted(starts: tuple[int, int]):
    """Joins a chunk with its answers: counts of every token, context and pair; and the cells of the deleted tokens."""

    def join(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        schema = pa.schema([("chunk", pa.int64()), *[(c.split()[0], pa.binary()) for c in _COUNTED.split(", ")[1:]]])
        answers = answers.sort_by([("kind", "ascending"), ("shard", "ascending")])
        kept, deleted = ([x.as_py() for x in answers.column(c)] for c in ("kept", "deleted"))
        if not len(chunk):  # the totals
            sums = [np.sum([np.frombuffer(x, np.int64) for x in y], axis=0) for y in (kept, deleted)]
            return pa.table([[-1], *[[None]] * 7, [np.concatenate(sums).tobytes()]], schema=schema)
        row = chunk.to_pylist()[0]
        kinds = answers.column("kind").to_pylist()

        def joined(raw: list[bytes], kind: int) -> np.ndarray:
            return np.concatenate([_unpack(x) for x, k in zip(raw, kinds, strict=True) if k == kind]).astype(np.int64)

        names, tokens, sizes = _unpack_keys(row["names"]), _unpack(row["tokens"]).astype(np.int64), _unpack(row["sizes"])
        before, pairs = _grams(names, tokens, sizes)
        if sum(len(_unpack(x)) for x, k in zip(kept, kinds, strict=True) if k == 0) != len(names):
            raise ValueError("chunks changed between two passes over the documents; give a written table or stable=False")
        place = np.unique(pairs, return_inverse=True)[1]
        counts = []  # of the kept and the deleted training documents
        for raw, start in ((kept, starts[0]), (deleted, starts[1])):
            words_ = joined(raw, 0)
            counts.append((words_[tokens], np.where(before < 0, start, words_[before]), joined(raw, 1)[place]))
        use = np.repeat(np.frombuffer(row["held"], np.uint8), sizes)
        single, context, pair = (x[use == 1] for x in counts[0])
        code = (bucket(context) << 40) | (_log_cell(pair / np.maximum(context, 1)) << 20) | _log_cell(single.astype(np.float64))
        code, n = np.unique(code, return_counts=True)
        both = [counts[0][k] + counts[1][k] for k in (0, 2)]
        return pa.table([[row["chunk"]], *[[row[c]] for c in ("ids", "known", "held", "sizes")], *[[_pack(x)] for x in both], [np.stack([code, n]).tobytes()], [None]], schema=schema)

    return join


def learn_weights(cells: dict[int, int], tokens: int, distinct: int, rounds: int = 200) -> np.ndarray:
    """Weights per bucket from the cells of deleted tokens, by expectation-maximisation. Buckets without such tokens take
    the weights of the next lower bucket with some."""
    weights = np.tile(np.array([0.0, 0.5, 0.5]), (66, 1))
    if not cells:
        return weights
    code, n = np.array(list(cells), dtype=np.int64), np.array(list(cells.values()), dtype=np.float64)
    at, pair, single = code >> 40, (code >> 20) & 0xFFFFF, code & 0xFFFFF
    value = lambda c: np.where(c > 0, np.exp2((c - 4096) / CELL), 0.0)
    p = np.stack([value(pair), value(single) / max(tokens, 1), np.full(len(code), 1 / (distinct + 1))], axis=1)
    for b in range(66):
        own = at == b
        if not own.any():
            weights[b] = weights[b - 1] if b else weights[b]
            continue
        w = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.7, 0.3])
        for _ in range(rounds):
            part = p[own] * w
            new = (part / part.sum(axis=1, keepdims=True) * n[own, None]).sum(axis=0) / n[own].sum()
            done = np.abs(new - w).max() < 1e-7
            w = new
            if done:
                break
        w = np.maximum(w, [0.0, 1e-9, 1e-9])  # no token may be impossible
        weights[b] = w / w.sum()
    return weights


def score(docs: DataFrame, held_out: int = 2, modulus: int = 7, chunk_bytes: int = CHUNK_BYTES, keys_per_shard: int = KEYS_PER_SHARD, stable: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams) and score,
    log10 probabilities. Documents whose crc32 of the doc_id modulo ``modulus`` is ``held_out`` are not learnt from.

    Chunks are read twice. They are written in between, unless the caller says that ``docs`` is ``stable``: the scan of a
    written table, which is split alike each time."""
    cut = chunks(docs, held_out, modulus, chunk_bytes)
    cut = cut if stable else stored(cut, "chunks")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")))
    learnt, deleted = crc % modulus != held_out, F.floor(crc / modulus) % FOLDS == 0
    n_bytes, kept_starts, deleted_starts = docs.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if(learnt & ~deleted), F.count_if(learnt & deleted)).first()
    shards = max(1, -(-n_bytes // (BYTES_PER_KEY * keys_per_shard)))
    answers = _requests(cut, shards).groupBy("kind", "shard").applyInArrow(_answer, "chunk long, kind int, shard int, kept binary, deleted binary")
    counted = stored(cut.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_counted((kept_starts, deleted_starts)), _COUNTED), "counted")
    totals = counted.where("chunk = -1").select("totals").first()
    kept_n, kept_v, all_n, all_v = np.frombuffer(totals[0], np.int64).tolist() if totals else (0, 0, 0, 0)

    def open_cells(batches):
        for batch in batches:
            for raw in batch.column("cells"):
                code, n = np.frombuffer(raw.as_py(), np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    # At most 66 buckets x cells of two estimates reach the driver, whatever the corpus.
    cells = counted.where("chunk >= 0").select("cells").mapInArrow(open_cells, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    weights = learn_weights({r.code: r.n for r in cells.toLocalIterator()}, kept_n, kept_v)

    def rate(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = _unpack(row["sizes"]).astype(np.int64)
                single, pair = (_unpack(row[c]).astype(np.float64) for c in ("single", "pair"))
                context = np.concatenate([[0.0], single[:-1]])  # a word is a context as often as it is a token
                context[np.cumsum(sizes) - sizes] = kept_starts + deleted_starts
                w = weights[bucket(context)]
                p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * single / max(all_n, 1) + w[:, 2] / (all_v + 1)
                begin = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x, begin) if len(x) else x
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["known"], np.uint8) == 0)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.frombuffer(row["held"], np.uint8) == 2), pa.array(sizes), pa.array(total((single > 0).astype(np.int64))), pa.array(np.full(len(sizes), all_n, dtype=np.int64)),
                     pa.array(total(np.log10((single + 1) / (all_n + all_v + 1)))), pa.array(total(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counted.where("chunk >= 0").drop("cells", "totals").mapInArrow(
        rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
