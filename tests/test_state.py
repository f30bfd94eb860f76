"""Keyed state of streams: lives with timers, admission, change propagation, crowded cells, over several micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from flowhelm.catalog import streams as Q
from flowhelm.operators import attention as A
from flowhelm.plans import reach
from flowhelm.session import scratch_path
from flowhelm.streaming import jobs as J
from flowhelm.streaming import state as S

HOUR = 3_600_000_000
START = 10_000 * HOUR


def feed(spark, schema, slices):
    """A stream of one file per slice, in order."""
    path = scratch_path(spark, "feed")
    frames = [spark.createDataFrame(rows, schema).coalesce(1) for rows in slices]
    for frame in frames:
        frame.write.mode("append").parquet(path)
    return J.stream_source(spark, path, frames[0].schema, files_per_batch=1)


def with_time(rows):
    """Times counted from a start far behind the epoch, where no watermark is."""
    return rows.withColumn("t_us", F.col("t_us") + START).withColumn("ts", F.timestamp_micros("t_us"))


def run(spark, frame, step, mode="update"):
    where = scratch_path(spark, "checkpoint")
    query = frame.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", where).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def test_merged_lives():
    assert S.merged([(5, 6, 2), (0, 1, 1), (20, 20, 1), (8, 8, 1)], 3) == [(0, 1, 1), (5, 8, 3), (20, 20, 1)]
    assert S.merged([(0, 0, 1), (10, 10, 1), (5, 5, 1)], 5) == [(0, 10, 3)]


def test_lives_end_come_back_and_take_late_events(spark):
    """Late events of `a` join two lives; `b` ends and lives again; what ended leaves no state."""
    slices = [
        [("a", 0), ("a", 3 * HOUR), ("b", 0)], [("a", 1 * HOUR + 1), ("a", 2 * HOUR), ("c", 4 * HOUR)], [("b", 9 * HOUR), ("z", 20 * HOUR)], [("b", 21 * HOUR), ("z", 21 * HOUR)]]
    path = scratch_path(spark, "lives")
    with S.on_disk(spark):
        query = run(spark, S.node_lives(with_time(feed(spark, "id string, t_us long", slices)), "ts", 3600 + 1, "6 hours"), J.write_batch(path))
    got = sorted((r.id, r.first_us - START, r.last_us - START, r.activity, r.ended) for r in S.latest_lives(spark.read.parquet(path)).collect())
    assert got == [
        ("a", 0, 3 * HOUR, 4, True), ("b", 0, 0, 1, True), ("b", 9 * HOUR, 9 * HOUR, 1, True), ("b", 21 * HOUR, 21 * HOUR, 1, False),
        ("c", 4 * HOUR, 4 * HOUR, 1, True), ("z", 20 * HOUR, 21 * HOUR, 2, False)]
    assert query.lastProgress["numInputRows"] == 0  # the timers fire after the last events


def test_state_of_lives_is_bounded(spark):
    """Twelve micro-batches of new nodes: only those of the last hours are state."""
    slices = [[(f"n{i}-{k}", i * 10 * HOUR + k) for k in range(200)] for i in range(12)]
    path = scratch_path(spark, "lives")
    with S.on_disk(spark):
        query = run(spark, S.node_lives(with_time(feed(spark, "id string, t_us long", slices)), "ts", 3600, "1 hour"), J.write_batch(path))
    sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert S.latest_lives(spark.read.parquet(path)).where("ended").count() == 2200
    assert max(sizes) <= 3 * 2 * 2 * 200 + 200, sizes  # lives and their timers of two slices, not of twelve


def test_edges_of_unknown_nodes_are_refused(spark):
    schema = "id string, src string, dst string, t_us long, flow_id long"
    node = lambda x: (x, None, None, None, None)
    edge = lambda a, b, t: (None, a, b, t, t)
    slices = [
        [node("a"), node("b"), edge("a", "b", 2), edge("a", "b", 1), edge("a", "c", 3), edge("x", "a", 4), (None, None, "a", 5, 5)],
        [node("c"), node("a"), edge("a", "c", 6), edge("c", "a", 7), edge("a", "b", 8)], [edge("c", "x", 9), edge("c", "c", 10), node("x")]]
    arriving, store = feed(spark, schema, slices), scratch_path(spark, "graph")
    nodes, edges = arriving.where("id IS NOT NULL").select("id"), arriving.where("id IS NULL").drop("id")
    J.grow_graph(spark, nodes, edges, store)
    got = sorted((r.src, r.dst, r.t_us, r.src_last_us, r.dst_last_us) for r in J.temporal_graph(spark, store).collect())
    assert got == [("a", "b", 1, 8, 8), ("a", "c", 6, 8, 10), ("c", "a", 7, 10, 8), ("c", "c", 10, 10, 10), ("c", "x", 9, 10, 9)]


def test_growing_goes_on_and_reads_only_what_is_new(spark):
    """Four calls, one slice each: every call takes in its own rows, the graph holds all."""
    schema = "id string, src string, dst string, t_us long, flow_id long"
    path, store = scratch_path(spark, "feed"), scratch_path(spark, "graph")
    frame = None
    for i in range(4):
        rows = [(f"n{i}", None, None, None, None), *((None, f"n{k}", f"n{i}", i * 10 + k, i * 10 + k) for k in range(i + 1))]
        frame = spark.createDataFrame(rows, schema)
        frame.coalesce(1).write.mode("append").parquet(path)
        arriving = J.stream_source(spark, path, frame.schema)
        J.grow_graph(spark, arriving.where("id IS NOT NULL").select("id"), arriving.where("id IS NULL").drop("id"), store)
        new = spark.read.parquet(f"{store}/admitted").groupBy("arrival_us").count().orderBy(F.desc("arrival_us")).first()["count"]
        assert new == i + 1
    assert J.temporal_graph(spark, store).count() == 10


@pytest.mark.parametrize("hops", [1])
def test_scoring_what_a_change_reaches_equals_scoring_all(spark, hops):
    """A graph whose sources have edges into them, too; windows that some edges leave."""
    rng = random.Random(3)
    day = 86_400_000_000
    slices = [[(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}", i * 6 * day + rng.randrange(day), 100 * i + k, 1.0) for k in range(n)] for i, n in enumerate((60, 9, 2, 5))]
    schema = "src string, dst string, t_us long, flow_id long, bytes double"
    ids = [f"n{i}" for i in range(13)]
    nodes = spark.createDataFrame([(x, [rng.random() for _ in range(len(Q.LAYERS[0].weight[0]) - Q.TDIM)]) for x in ids], "id string, feat array<double>")
    results, read = {}, {}

    def step(batch, number):
        if batch.isEmpty():
            return
        kept = batch.persist()
        read[number] = kept.where("src IS NOT NULL").count()
        top = max(e[2] for s in slices[: number + 1] for e in s)
        results[number] = {r.id: r.feat for r in Q.touched_vectors(kept, nodes, newest=top).collect()}
        kept.unpersist()

    with S.on_disk(spark):
        run(spark, S.edges_into_touched(feed(spark, schema, slices), Q._REACH_US, hops), step, "append")
    for number in range(len(slices)):
        known = spark.createDataFrame([e for s in slices[: number + 1] for e in s], schema)
        recent = Q.E.recent(known, Q._REACH_US).withColumn("t", F.pmod("t_us", F.lit(day)) / F.lit(1e6))
        touched = {x for e in slices[number] for x in e[:2]}
        want = {r.id: r.feat for r in A.tgat_layer(recent, nodes, Q.LAYERS[0], Q.encode, Q.TDIM).collect() if r.id in touched}
        assert results[number].keys() == want.keys()
        assert all(results[number][x] == pytest.approx(want[x], abs=1e-12) for x in want)
    assert read[2] < read[0]


def test_crowded_cell(spark):
    """Two hundred events in one second: every pair is found once, and no cell holds more than its part of them."""
    rng = random.Random(1)
    rows = [(i, 1000 * HOUR + rng.randrange(1_000_000)) for i in range(200)] + [(1000 + i, 1000 * HOUR + 40_000_000 * i) for i in range(20)]
    stream = lambda: with_time(feed(spark, "flow_id long, t_us long", [rows[::2], rows[1::2]]))
    path = scratch_path(spark, "near")
    J.run_appended(J.proximity_join(stream(), stream(), 60, sub_cells=8, salts=8), path)
    got = sorted((r.src, r.dst) for r in spark.read.parquet(path).collect())
    assert got == sorted((a, b) for a, s in rows for b, t in rows if a != b and 0 <= t - s <= 60_000_000)


@pytest.mark.parametrize("most,held", [(4096, 1 << 18), (3, 50)])
def test_events_of_a_cell_are_one_row_of_join_state(spark, monkeypatch, most, held):
    """Pairs within and across micro-batches, at the ends of the reach, over borders of cells, of late events; missing times and ids have none."""
    rng = random.Random(2)
    rows = [(i, 1000 * HOUR + rng.randrange(2400) * 500_000) for i in range(400)] + [(400 + i, 1000 * HOUR + 2000_000_000 + 60_000_000 * i) for i in range(5)]
    odd = [(None, 1000 * HOUR + 5), (500, None)]
    monkeypatch.setattr(reach, "PACK_ROWS", most, raising=False)
    monkeypatch.setattr(reach, "HELD_ROWS", held, raising=False)
    stream = lambda: with_time(feed(spark, "flow_id long, t_us long", [rows[::2], rows[1::2] + odd]))
    path, checkpoint = scratch_path(spark, "near"), scratch_path(spark, "checkpoint")
    J.run_appended(J.proximity_join(stream(), stream(), 60), path, checkpoint=checkpoint)
    got = sorted((r.src, r.dst, r.t_us) for r in spark.read.parquet(path).collect())
    assert got == sorted((a, b, t + START) for a, s in rows for b, t in rows if a != b and 0 <= t - s <= 60_000_000)
    state = [spark.read.format("statestore").option("joinSide", side).load(checkpoint).count() for side in ("left", "right")]
    assert most < 400 or sum(state) <= 30
