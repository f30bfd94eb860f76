"""Keyed state of streaming jobs: node lives with timers, admission of edges between known nodes, edges into touched nodes.

State lives in the state store on disk (:func:`on_disk`), keyed and read by key: a micro-batch costs what it touches, however
large the graph has grown. Most nodes have a few rows in a micro-batch, so lives and found edges are worked out on plain rows: a pandas frame
a key costs more than its rows, and every call of the state store is a round trip.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
FOLD_ROWS = 10_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def on_disk(spark: SparkSession) -> Iterator[None]:
    """Start streaming queries inside: keyed state needs the state store that keeps its rows on disk."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def merged(lives: list[tuple[int, int, int]], idle_us: int) -> list[tuple[int, int, int]]:
    """Lives (first, last, events) joined where they are at most ``idle_us`` apart."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(lives):
        if out and first - out[-1][1] <= idle_us:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class NodeLives(StatefulProcessor):
    """Open lives of a node. A life ends when the watermark is ``idle_us`` past its last event: it is given out and forgotten, and a later
    event starts another one. Late events in front of the watermark join or connect lives, in any order of arrival.

    Each call gives out the lives still open (``order`` 0 after events, 1 after a timer; a row without times when there is none),
    so the newest rows of a node are its state.
    """

    def __init__(self, idle_us: int):
        self.idle_us = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "first array<long>, last array<long>, n array<long>")

    def _lives(self) -> list[tuple[int, int, int]]:
        state = self.open.get()
        return list(zip(*state, strict=True)) if state is not None else []

    def _timer(self, lives: list[tuple[int, int, int]]) -> int | None:
        """When the first of the lives ends, in milliseconds; a node has this one timer."""
        return -(-(min(last for _, last, _ in lives) + self.idle_us) // 1000) if lives else None

    def _keep(self, before: list[tuple[int, int, int]], lives: list[tuple[int, int, int]]) -> None:
        was, at = self._timer(before), self._timer(lives)
        if was != at:
            if was is not None:
                self.handle.deleteTimer(was)
            if at is not None:
                self.handle.registerTimer(at)
        if lives:
            self.open.update(tuple(list(c) for c in zip(*lives, strict=True)))
        elif before:
            self.open.clear()

    def _rows(self, key, lives: list[tuple[int, int, int]], ended: bool, order: int) -> Iterator[Row]:
        for first, last, n in lives or [(None, None, None)]:
            yield Row(id=key[0], first_us=first, last_us=last, activity=n, ended=ended, order=order)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self._lives()
        lives, news = before, []
        for row in rows:
            news.append((row.t_us, row.t_us, 1))
            if len(news) == FOLD_ROWS:
                lives, news = merged([*lives, *news], self.idle_us), []
        lives = merged([*lives, *news], self.idle_us)
        self._keep(before, lives)
        yield from self._rows(key, lives, False, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        lives = self._lives()
        over = [x for x in lives if x[1] + self.idle_us <= passed]
        left = [x for x in lives if x[1] + self.idle_us > passed]
        self._keep(lives, left)
        if over:
            yield from self._rows(key, over, True, 1)
        yield from self._rows(key, left, False, 1)

    def close(self) -> None:
        pass


def node_lives(stream: DataFrame, ts: str, idle_s: int, delay: str) -> DataFrame:
    """Snapshots and ends of the lives of ``id`` (see :class:`NodeLives`), from rows (id, t_us, ts)."""
    schema = "id string, first_us long, last_us long, activity long, ended boolean, order int"
    return stream.withWatermark(ts, delay).groupBy("id").transformWithState(NodeLives(idle_s * 1_000_000), schema, "Update", "EventTime")


def latest_lives(saved: DataFrame) -> DataFrame:
    """Ended and open lives from the rows of all micro-batches (``_batch``)."""
    newest = saved.groupBy("id").agg(F.max(F.struct("_batch", "order")).alias("_top"))
    open_ = saved.where("NOT ended AND first_us IS NOT NULL").join(newest, "id").where((F.col("_batch") == F.col("_top._batch")) & (F.col("order") == F.col("_top.order")))
    columns = ["id", "first_us", "last_us", "activity", "ended"]
    return saved.where("ended").select(*columns).unionByName(open_.select(*columns))


class Admission(StatefulProcessor):
    """Passes on the edges at nodes that are registered, in this micro-batch or before; refuses the others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known, waiting = self.known.exists(), []
        for part in rows:
            news = part["src"].isna()
            if news.any() and not known:
                known = True
                self.known.update((True,))
                yield part[news]
                part = part[~news]
                yield from waiting
                waiting = []
            elif news.any():
                part = part[~news]  # registered before
            if len(part):
                if known:
                    yield part
                else:
                    waiting.append(part)

    def close(self) -> None:
        pass


def admitted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges (src, dst, t_us, flow_id) whose ends are nodes (id) of the same or an earlier micro-batch, with the time of that
    micro-batch. The known nodes are state, asked by key for each end: first ``src``, then ``dst``."""
    schema = "id string, src string, dst string, t_us long, flow_id long, arrival_us long"
    news = nodes.select(
        "id", F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(None).cast("long").alias("t_us"), F.lit(None).cast("long").alias("flow_id"))
    asked = edges.select(F.col("src").alias("id"), "src", "dst", "t_us", "flow_id").where("src IS NOT NULL AND dst IS NOT NULL")
    both = news.unionByName(asked).withColumn("arrival_us", F.unix_micros(F.current_timestamp()))
    first = both.groupBy("id").transformWithStateInPandas(Admission(), schema, "Append", "None")
    second = first.withColumn("id", F.coalesce("dst", "id")).groupBy("id").transformWithStateInPandas(Admission(), schema, "Append", "None")
    return second.where("src IS NOT NULL").select("src", "dst", "t_us", "flow_id", "arrival_us")


class EdgesInto(StatefulProcessor):
    """Edges into a node, as far back as ``window_us`` before the newest time that came with its rows. Rows of ``kind`` `edge` are
    new edges, `ask` rows ask for all of them, rows of ``kind`` `found` pass (and ask): edges that an earlier step has found."""

    def __init__(self, window_us: int, hop: int):
        self.window_us, self.hop = window_us, hop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edges = handle.getListState("edges", "src string, t_us long, flow_id long, bytes double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        asked, news, newest = False, [], None
        for row in rows:
            asked = asked or row.kind != "edge"
            if row.t_us is not None and (newest is None or row.t_us > newest):
                newest = row.t_us
            if row.kind == "edge":
                news.append((row.src, row.t_us, row.flow_id, row.bytes))
            elif row.kind == "found":
                yield Row(**{c: row[c] for c in FOUND})
        kept = [tuple(e) for e in self.edges.get()] if asked or news else []
        live = [e for e in (*kept, *news) if e[1] is not None and newest is not None and e[1] >= newest - self.window_us]
        if len(live) < len(kept) + len(news):
            self.edges.put(live) if live else self.edges.clear()
        elif news:
            self.edges.appendList(news)
        if asked and (live or not self.hop):
            for src, t_us, flow_id, size in live or [(None, newest, None, None)]:
                yield Row(dst=key[0], src=src, t_us=t_us, flow_id=flow_id, bytes=size, hop=self.hop)

    def close(self) -> None:
        pass


#: Columns of found edges: ``hop`` 0 leads into a touched node, 1 into a source of such an edge, and so on.
FOUND = ("dst", "src", "t_us", "flow_id", "bytes", "hop")
_FOUND_SCHEMA = "dst string, src string, t_us long, flow_id long, bytes double, hop int"


def edges_into_touched(stream: DataFrame, window_us: int, hops: int = 1) -> DataFrame:
    """What a change can reach: all edges of the window into the nodes that a micro-batch touches (as either end), then those into
    their sources, up to ``hops`` steps. A touched node without edges gives a row without ``src``; edges that lie behind the window of
    another node may still be among the rows. What is read of the past follows the micro-batch, not the graph."""
    base = stream.where("src IS NOT NULL AND dst IS NOT NULL")

    def rows(frame: DataFrame, ident: str, kind: str) -> DataFrame:
        have = [F.col(c) if c in frame.columns else F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in _FOUND_SCHEMA.split(", "))]
        return frame.select(F.col(ident).alias("id"), F.lit(kind).alias("kind"), *have)

    asked = rows(base, "src", "ask").unionByName(rows(base, "dst", "ask"))
    found = None
    for hop in range(hops + 1):
        both = rows(base, "dst", "edge").unionByName(asked)
        found = both.groupBy("id").transformWithState(EdgesInto(window_us, hop), _FOUND_SCHEMA, "Append", "None")
        asked = rows(found.withColumn("id", F.coalesce("src", "dst")), "id", "found")
    return found
