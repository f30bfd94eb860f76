"""MinHash near-dedup with circulant permutations.

A document's set holds the hashes of its distinct 5-word shingles (words are runs outside ``[\\x20\\x09-\\x0D]`` of the
text with A-Z lower-cased; fewer words: the whole sequence as one shingle; none: the empty set, linked with nothing).
A first permutation scatters the shingles over a circle of D places; a second one gives each place a value. Coordinate j
of the signature is the smallest value that the scattered shingles meet after the second permutation is shifted by j, so
one look-up per shingle reads the consecutive values of all coordinates.

Signatures are cut into bands; equal bands are candidates and every link is confirmed on the full sets. Documents of
equal sets count as one (a class) from the start. In a band's group no pairs are made: each class is compared with the
hub of the group, the one that meets the most others over all bands, and what then lies outside the largest component of
a group with some members of that component. Members that then still lie outside are compared with all members of other
components, in tiles that give out links alone, so no link is lost. Components of the confirmed links spread the smallest doc_id.

Null texts have empty sets; null doc_ids are ignored as names (they come last); repeated rows share a class (rows that
share a doc_id are taken to share their text); an empty table gives no rows; extra columns are not touched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.llm.columns import KEY, with_row_keys
from flowhelm.llm.text import LOWER, Spans, as_long, constants, mix, pieces, row_bounds, shingle_hashes, words
from flowhelm.plans.lookup import is_small
from flowhelm.session import stored

WORDS = 5
NEAR, OF = 75, 100
ROWS_PER_BAND = 6
RECALL = 0.9999
TILE = 512
DRAWS = 4  # members of a group's largest component that one outside it meets first; the rest is decided in tiles
_CIRCLE = 1 << 18
_TABLE: dict[int, np.ndarray] = {}


def bands_for(similarity: float = NEAR / OF, rows: int = ROWS_PER_BAND, recall: float = RECALL) -> int:
    """Bands that a pair of this similarity misses with probability 1 - recall at most."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def _values(width: int) -> np.ndarray:
    """The second permutation around the circle, as overlapping runs of ``width`` values."""
    if width not in _TABLE:
        order = np.random.Generator(np.random.PCG64(20177)).permutation(_CIRCLE).astype(np.uint32)
        _TABLE[width] = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: width - 1]]), width)
    return _TABLE[width]


def _sets(texts: pa.Array, size: int):
    """Per piece: first row, number of rows, shingle hashes sorted within rows and distinct, bounds of the rows."""
    for at, offsets, data in pieces(texts):
        data = LOWER[data]
        n = len(offsets) - 1
        start, end, row = words(data, offsets)
        hashes, row = shingle_hashes(Spans(data).hash(start, end), row_bounds(row, n), size)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        fresh = np.ones(len(row), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        hashes, row = hashes[fresh], row[fresh]
        yield at, n, hashes, row_bounds(row, n)


def signatures(docs: DataFrame, words_per_shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, a, b, bands): size of the set, two names of the whole set, a name per band."""
    width = bands * rows
    factor = constants(77, rows)

    def sign(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, n, hashes, bounds in _sets(batch.column("text"), words_per_shingle):
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                lowest = np.zeros((n, width), dtype=np.uint32)
                a, b = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                if len(full):
                    starts = bounds[:-1][full]
                    a[full] = np.add.reduceat(mix(hashes + np.uint64(1)), starts)
                    b[full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    place = (mix(hashes + np.uint64(99)) >> np.uint64(46)).astype(np.int64)
                    values = _values(width)
                    for r in full:
                        lo, hi = bounds[r], bounds[r + 1]
                        best = values[place[lo : lo + 512]].min(axis=0) if hi - lo > 512 else values[place[lo:hi]].min(axis=0)
                        for next_ in range(lo + 512, hi, 512):
                            np.minimum(best, values[place[next_ : min(hi, next_ + 512)]].min(axis=0), out=best)
                        lowest[r] = best
                names = (lowest.reshape(n, bands, rows).astype(np.uint64) * factor).sum(axis=2, dtype=np.uint64)
                names = mix(names + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + n], pa.array(size.astype(np.int64)), as_long(a), as_long(b), pa.ListArray.from_arrays(offsets, as_long(names[size > 0].reshape(-1)))],
                    ["doc_id", "n_shingles", "a", "b", "bands"])

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, a long, b long, bands array<long>")


def shingle_sets(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(doc_id, set): the sorted shingle hashes as bytes."""

    def pack(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for at, n, hashes, bounds in _sets(batch.column("text"), words_per_shingle):
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + n], pa.array([raw[8 * bounds[r] : 8 * bounds[r + 1]] for r in range(n)], pa.binary())], ["doc_id", "set"])

    return docs.mapInArrow(pack, "doc_id long, set binary")


def _common(batches):
    """Sizes of the intersections of two columns of sets."""
    for batch in batches:
        n = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
             for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("m"), batch.column("h"), pa.array(n, pa.int64()), batch.column("nm"), batch.column("nh")], ["m", "h", "common", "nm", "nh"])


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(m, h, common, nm, nh) for pairs of classes: sizes of the sets and of what they share."""
    x = sets.select(F.col("doc_id").alias("m"), F.col("set").alias("x"))
    y = sets.select(F.col("doc_id").alias("h"), F.col("set").alias("y"))
    return pairs.join(x, "m").join(y, "h").select("m", "h", "x", "y", "nm", "nh").mapInArrow(_common, "m long, h long, common long, nm long, nh long")


def is_near(common: str = "common", near: int = NEAR):
    return OF * F.col(common) >= near * (F.col("nm") + F.col("nh") - F.col(common))


def components(links: DataFrame) -> DataFrame:
    """(m, root) for the ends of links: the smallest id that each reaches, itself included.

    Alternating stars: first every node ties its larger neighbours to its smallest one, then its smaller neighbours and
    itself to their smallest one, until all edges lead to a root. Both are a window over one shuffle."""
    edges = links.select(F.greatest("m", "h").alias("u"), F.least("m", "h").alias("v")).where("u <> v").distinct()
    smallest, last = F.min("v").over(Window.partitionBy("u")), None
    while True:
        edges = stored(edges, "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            return edges.select(F.col("u").alias("m"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("m"), F.col("v").alias("root")).distinct())
        last = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("low", F.least("u", smallest)).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        small = large.withColumn("low", smallest)
        edges = small.select(F.inline(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v"))))).where("u <> v").distinct()


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "m", "left").withColumn("root", F.coalesce("root", "m"))


def _placed(starred: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their roots; and of every group with several roots the one that most members have (``lead``) and
    ``drawn``, some members of it: at most ``DRAWS``, by hash, different ones in each group."""
    placed = stored(_rooted(starred, roots), "placed")
    by_hash = F.row_number().over(Window.partitionBy("name", "root").orderBy(F.xxhash64("m", "name"), "m"))
    drawn = placed.withColumn("_turn", by_hash).groupBy("name", "root").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("_turn") <= DRAWS, F.struct("m", "nm"))).alias("drawn"))
    lead = drawn.groupBy("name").agg(F.max_by(F.struct("root", "drawn"), F.struct("n", "root")).alias("w"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("all"), F.max("n").alias("most"))
    return placed, stored(lead.where("roots > 1").select("name", F.col("w.root").alias("lead"), F.col("w.drawn").alias("drawn"), "all", (F.col("all") - F.col("most")).alias("outside")), "lead")


def _untried(pairs: DataFrame, tried: DataFrame, near: int) -> DataFrame:
    """Distinct pairs whose sizes allow a link and that were not compared before in either order."""
    fits = OF * F.least("nm", "nh") >= near * F.greatest("nm", "nh")
    both = tried.select("m", "h").unionByName(tried.select(F.col("h").alias("m"), F.col("m").alias("h")))
    return pairs.where(fits & (F.col("m") != F.col("h"))).select("m", "h", "nm", "nh").distinct().join(both, ["m", "h"], "left_anti")


def _tile(near: int):
    """Links between the sets of two tables of (m, root, set) and (y_m, y_root, y_set), other roots only: the sets of one side are looked up in
    one sorted array of the other's, so the work is what they share."""

    def link(x: pa.Table, y: pa.Table) -> pa.Table:
        schema = pa.schema([("m", pa.int64()), ("h", pa.int64())])
        if not len(x) or not len(y):
            return schema.empty_table()
        sets = [np.frombuffer(r.as_py(), np.uint64) for r in y.column("y_set")]
        size = np.array([len(r) for r in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        others, roots = np.asarray(y.column("y_m")), np.asarray(y.column("y_root"))
        ms, hs = [], []
        for m, root, raw in zip(x.column("m").to_pylist(), x.column("root").to_pylist(), x.column("set"), strict=True):
            own = np.frombuffer(raw.as_py(), np.uint64)
            lo, hi = np.searchsorted(every, own, side="left"), np.searchsorted(every, own, side="right")
            n = hi - lo
            met = owner[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            common = np.bincount(met, minlength=len(sets))
            hit = np.flatnonzero((OF * common >= near * (len(own) + size - common)) & (roots != root))
            ms += [m] * len(hit)
            hs += others[hit].tolist()
        return pa.table([pa.array(ms, pa.int64()), pa.array(hs, pa.int64())], schema=schema)

    return link


def _linked_in_tiles(placed: DataFrame, lead: DataFrame, sets: DataFrame, near: int) -> DataFrame:
    """(m, h) linked pairs of different components that share a group: every member outside the group's largest component
    against all members, in tiles of ``TILE`` x ``TILE`` rows. Only links leave a tile."""
    rows = placed.join(lead.select("name", "lead", "outside", "all"), "name").join(sets.withColumnRenamed("doc_id", "m"), "m")
    tiles = {"_q": F.ceil(F.col("outside") / TILE).cast("int"), "_t": F.ceil(F.col("all") / TILE).cast("int")}
    rows = rows.withColumns(tiles)
    x = rows.where("root <> lead").select("name", F.pmod(F.xxhash64("m"), "_q").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("j"), "m", "root", "set")
    y = rows.select("name", F.explode(F.sequence(F.lit(0), F.col("_q") - 1)).alias("i"), F.pmod(F.xxhash64("m", F.lit(1)), "_t").cast("int").alias("j"), "m", "root", "set")
    y = y.toDF("y_name", "y_i", "y_j", "y_m", "y_root", "y_set")
    return x.groupBy("name", "i", "j").cogroup(y.groupBy("y_name", "y_i", "y_j")).applyInArrow(_tile(near), "m long, h long").distinct()


def near_components(docs: DataFrame, words_per_shingle: int = WORDS, near: int = NEAR, rows: int = ROWS_PER_BAND) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``. Rows whose id is missing or repeated are documents of their own, in the
    order of ids (missing ones last) and texts; the first of a component is kept, and its id, maybe missing, names the component."""
    named, own = with_row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    if own:
        return _near_components(named.drop(KEY), words_per_shingle, near, rows)
    found = keyed_components(named, words_per_shingle, near, rows)
    ids = named.select(KEY, "doc_id")
    names = ids.toDF("_first", "component_id")
    return found.join(ids, KEY).join(names, found["first"] == names["_first"]).select("doc_id", "n_shingles", "component_id", "kept")


def keyed_components(named: DataFrame, words_per_shingle: int = WORDS, near: int = NEAR, rows: int = ROWS_PER_BAND) -> DataFrame:
    """(KEY, n_shingles, first, kept) per row of a table with row keys; ``first`` is the smallest key of the component."""
    texts = named.select(F.col(KEY).alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(_near_components(texts, words_per_shingle, near, rows), "keyed").withColumnsRenamed({"doc_id": KEY, "component_id": "first"})


def _near_components(texts: DataFrame, words_per_shingle: int, near: int, rows: int) -> DataFrame:
    bands = bands_for(near / OF, rows)
    signed = stored(signatures(texts, words_per_shingle, bands, rows), "signatures")
    full = signed.where("n_shingles > 0")
    classes = stored(full.groupBy("a", "b", "n_shingles").agg(F.min("doc_id").alias("m"), F.min_by("bands", F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("bands")), "classes")
    group = Window.partitionBy("name")
    spread = classes.where("m IS NOT NULL").select("m", F.col("n_shingles").alias("nm"), F.explode("bands").alias("name"))
    met = spread.withColumn("together", F.count(F.lit(1)).over(group)).where("together > 1")
    members = met.withColumn("met", F.sum("together").over(Window.partitionBy("m"))).drop("together")
    hub = F.max(F.struct(F.col("met"), (-F.col("m")).alias("h"), F.col("nm"))).over(group)
    starred = stored(members.withColumn("_hub", hub).select("name", "m", "nm", (-F.col("_hub.h")).alias("h"), F.col("_hub.nm").alias("nh")), "stars")
    wanted = starred.select(F.col("m").alias("doc_id")).distinct()
    sets = stored(shingle_sets(texts.join(F.broadcast(wanted) if is_small(wanted) else wanted, "doc_id", "left_semi"), words_per_shingle), "sets")
    tried = stored(compare(starred.where("m <> h").select("m", "h", "nm", "nh").distinct(), sets), "tried")
    links = tried.where(is_near(near=near)).select("m", "h")
    roots = components(links)
    # Members outside the largest component of their group meet some members of it, others in each group.
    placed, lead = _placed(starred, roots)
    some = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda i: F.get("drawn", F.pmod(F.xxhash64("m", i), F.size("drawn")).cast("int")))
    outside = placed.join(lead, "name").where(F.col("root") != F.col("lead")).withColumn("_h", F.explode(some)) \
        .select("m", "nm", F.col("_h.m").alias("h"), F.col("_h.nm").alias("nh"))
    more = stored(compare(_untried(outside, tried, near), sets), "tried")
    found = more.where(is_near(near=near)).select("m", "h")
    if not found.isEmpty():
        links = links.unionByName(found)
        roots = components(links)
        placed, lead = _placed(starred, roots)
    # What is left: members outside the largest component of a group against those of other components, in tiles.
    more = stored(_linked_in_tiles(placed, lead, sets, near), "more")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    rooted = _rooted(classes.select("a", "b", "n_shingles", "m"), roots).select("a", "b", "n_shingles", F.col("root").alias("component_id"))
    own = signed.select("doc_id", "n_shingles", "a", "b")
    linked = own.where("n_shingles > 0").join(rooted, ["a", "b", "n_shingles"])
    alone = own.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return linked.unionByName(alone, allowMissingColumns=True).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False)).alias("kept"))
