"""Repair of conversations: faults of their turns, and the cheapest edits that give an orderly sequence of roles.

Each turn becomes a symbol: its role's initial (`s`, `u`, `a`, `o`: another), a capital where its text is truncated, `x` where it
is blank or a duplicate and has to go. Cost and best edits from a turn on depend only on the symbols that follow and on
the state of the role grammar, so signatures are minimised from the end: one automaton node for each distinct suffix of
all conversations, reached by (symbol, node behind it). Distinct signatures are sorted by their reversed symbols and
dealt out by range; a task walks them like a path in that automaton and works out the cost-to-go and the first edit of
the best audit once per node and grammar state, for all conversations that share the suffix (edits of one node and
state that cost the same differ in their initial, so the first edit settles ties). Every conversation then looks up its signature.

Conversations above ``BLOCK_TURNS`` turns are cut into blocks. A block's automaton ends in a context, the cost-to-go at the start of
the next block (as differences, of which there are few); contexts pass backwards over blocks as products of 4 x 4
tables of costs, states pass forwards. So no task holds the turns of a conversation; only the digest, a chain by nature, reads them in one go.

Defined results: null roles and texts are one space, null turns come first, equal turns go by role and text, null
conversation ids are one conversation; empty texts are blank; repeated rows are duplicates; empty tables give no rows;
columns besides the four are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowhelm.plans.lookup import is_small, lookup_join
from flowhelm.plans.ordered import number
from flowhelm.plans.skew import null_safe_join
from flowhelm.session import stored

BLOCK_TURNS = 65_536
RANGE_REQUESTS = 20_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the grammar of role initials, `(s?(ua)+)?`: nothing yet, after `s`, after `u`, after `a`; the next ones, and what may be set there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FORCED = ("u", "u", "a", "u")
START, STATES, NEVER = 0, 4, 1 << 60
END = "end"
#: Edits in plans: kept, deleted, set to user or assistant, inserted user or assistant; and their initials in audits.
PLAN, AUDIT = "KDUAij", "KDRRII"
BLANK = r"[^\x20\x09-\x0D]"
ROLES = {"i": "user", "U": "user", "j": "assistant", "A": "assistant"}


# -- the automaton ----------------------------------------------------------------------------------------------------


def _with_inserts(node: list[tuple[int, str]]) -> list[tuple[int, str]]:
    changed = True
    while changed:
        changed = False
        for q in range(STATES):
            role = FORCED[q]
            cost = INSERT + node[NEXT[q][role]][0]
            if cost < node[q][0] or (cost == node[q][0] < NEVER and node[q][1] in ("K", "U", "A")):
                node[q] = (cost, "i" if role == "u" else "j")
                changed = True
    return node


def last_node(context: str) -> list[tuple[int, str]]:
    """Cost-to-go per state where the symbols end: of the conversation, or of a block under a context."""
    if context == END:
        return _with_inserts([(0, ""), (NEVER, ""), (NEVER, ""), (0, "")])
    return [(int(c) if c else NEVER, "") for c in context.split(",")]


def node_before(symbol: str, behind: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Cost-to-go and first edit per state where ``symbol`` comes before the node ``behind``."""
    node = []
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    for q in range(STATES):
        best = (DELETE + behind[q][0], "D")
        if symbol != "x":
            if role in NEXT[q]:
                best = min(best, (extra + KEEP + behind[NEXT[q][role]][0], "K"), key=lambda x: x[0])
            forced = FORCED[q]
            best = min(best, (extra + REROLE + behind[NEXT[q][forced]][0], forced.upper()), key=lambda x: x[0])
        node.append((min(best[0], NEVER), best[1]))
    return _with_inserts(node)


class Path:
    """The nodes behind the symbols read last; those that the next signature shares stay."""

    def __init__(self) -> None:
        self.context, self.reversed, self.nodes, self.made = None, "", [], 0

    def read(self, context: str, reversed_symbols: str) -> None:
        if context != self.context:
            self.context, self.reversed, self.nodes = context, "", [last_node(context)]
        shared = len(os.path.commonprefix([self.reversed, reversed_symbols]))
        del self.nodes[shared + 1 :]
        for symbol in reversed_symbols[shared:]:
            self.nodes.append(node_before(symbol, self.nodes[-1]))
        self.made += len(reversed_symbols) - shared
        self.reversed = reversed_symbols

    def best(self, start: int) -> tuple[int | None, int | None, str | None, int | None]:
        """Cost-to-go, own cost, plan and last state of the best edits from a state."""
        total = self.nodes[-1][start][0]
        if total >= NEVER:
            return None, None, None, None
        at, state, plan = len(self.nodes) - 1, start, []
        while True:
            edit = self.nodes[at][state][1]
            if not edit:
                return total, total - self.nodes[0][state][0], "".join(plan), state
            plan.append(edit)
            if edit == "K":
                state = NEXT[state][self.reversed[at - 1].lower()]
            elif edit != "D":
                state = NEXT[state][FORCED[state]]
            if edit not in "ij":
                at -= 1


def solve(requests: DataFrame) -> DataFrame:
    """Best edits for distinct (context, symbols, start): ``total``, ``own``, ``plan``, ``last``, stored."""
    distinct = requests.select("context", "symbols", "start").distinct().withColumn("_reversed", F.reverse("symbols"))
    dealt = distinct.repartitionByRange("context", "_reversed").sortWithinPartitions("context", "_reversed", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = Path()
        for batch in batches:
            found = []
            for context, reversed_symbols, start in zip(*(batch.column(c).to_pylist() for c in ("context", "_reversed", "start")), strict=True):
                path.read(context, reversed_symbols)
                found.append(path.best(start))
            totals, owns, plans, lasts = zip(*found, strict=True) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("context"), batch.column("symbols"), batch.column("start"),
                 pa.array(totals, pa.int64()), pa.array(owns, pa.int64()), pa.array(plans, pa.string()), pa.array(lasts, pa.int32())],
                names=["context", "symbols", "start", "total", "own", "plan", "last"])

    return stored(dealt.mapInArrow(run, "context string, symbols string, start int, total long, own long, plan string, last int"), "repairs")


# -- conversations as blocks of symbols -------------------------------------------------------------------------------


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def numbered_turns(rows: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Turns with their place in the conversation, block, first fault and symbol, stored."""
    plain = rows.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    placed = stored(
        number(plain, ["turn", "role", "text"], ["conv_id"], "pos")
        .withColumn("same", F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))), "turns")
    first = stored(placed.groupBy("conv_id", "same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated")
    seen = F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    fault = F.when(~F.col("text").rlike(BLANK), "blank").when(seen, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    gone = F.col("fault").isin("blank", "duplicate")
    return (
        lookup_join(placed, first, ["conv_id", "same"], "pos")
        .withColumn("fault", fault).withColumn("initial", _initial(F.col("role")))
        .withColumn("symbol", F.when(F.coalesce(gone, F.lit(False)), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial")))
        .withColumn("block", F.floor((F.col("pos") - 1) / block_turns).cast("long")).drop("same", "first"))


def blocks_of(turns: DataFrame) -> DataFrame:
    """Symbols and role initials of each block (at most ``BLOCK_TURNS`` turns), stored."""
    turn = F.array_sort(F.collect_list(F.struct("pos", "symbol", "initial")))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("_turns", lambda t: t[field]), "")

    return stored(
        turns.groupBy("conv_id", "block").agg(turn.alias("_turns"))
        .select("conv_id", "block", joined("symbol").alias("symbols"), joined("initial").alias("initials")), "blocks")


def _arrow(rows: list[tuple], like: pa.Table, names: list[str], types: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    key = pa.array([like.column("conv_id")[0].as_py()] * len(rows), like.column("conv_id").type) if rows else pa.array([], like.column("conv_id").type)
    return pa.Table.from_arrays([key, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=["conv_id", *names])


def _contexts(table: pa.Table) -> pa.Table:
    """Context of each block of a conversation, from the last one backwards."""
    costs: dict[int, dict[tuple[str, int], int]] = {}
    for b, context, start, total in zip(*(table.column(c).to_pylist() for c in ("block", "context", "start", "total")), strict=True):
        costs.setdefault(b, {})[context, start] = NEVER if total is None else total
    rows, ahead = [], None
    for b in sorted(costs, reverse=True):
        own = costs[b]
        if ahead is None:
            rows.append((b, END))
            ahead = [own[END, p] for p in range(STATES)]
            continue
        least = min(ahead)
        rows.append((b, ",".join(str(c - least) for c in ahead)))
        ahead = [min(own[_only(q), p] + ahead[q] for q in range(STATES)) for p in range(STATES)]
    return _arrow(rows, table, ["block", "context"], [pa.int64(), pa.string()])


def _starts(table: pa.Table) -> pa.Table:
    """State at the start of each block, from the first one on."""
    last = {(b, s): e for b, s, e in zip(*(table.column(c).to_pylist() for c in ("block", "start", "last")), strict=True)}
    rows, state = [], START
    for b in sorted({b for b, _ in last}):
        rows.append((b, state))
        state = last[b, state]
    return _arrow(rows, table, ["block", "start"], [pa.int64(), pa.int32()])


def _only(state: int) -> str:
    """The context in which a block must end in ``state``."""
    return ",".join("0" if q == state else "" for q in range(STATES))


def _each_start(frame: DataFrame) -> DataFrame:
    return frame.withColumn("start", F.explode(F.array(*[F.lit(q) for q in range(STATES)])))


def planned_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with the best plan of edits for each and its cost."""
    long_ones = blocks.where("block > 0").select("conv_id").distinct()
    at_once = blocks.withColumn("context", F.lit(END)).withColumn("start", F.lit(START))
    if not long_ones.isEmpty():
        long_ones = stored(long_ones, "long")
        parts = stored(null_safe_join(blocks, long_ones, ["conv_id"], "left_semi"), "parts")
        ends = parts.groupBy("conv_id").agg(F.max("block").alias("_end"))
        marked = null_safe_join(parts, ends, ["conv_id"])
        asked = _each_start(marked.withColumn(
            "context", F.explode(F.when(F.col("block") == F.col("_end"), F.array(F.lit(END))).otherwise(F.array(*[F.lit(_only(q)) for q in range(STATES)])))))
        kind = blocks.schema["conv_id"].dataType.simpleString()
        costs = _looked_up(asked, solve(asked)).select("conv_id", "block", "context", "start", "total")
        found = costs.groupBy("conv_id").applyInArrow(_contexts, f"conv_id {kind}, block long, context string")
        placed = stored(null_safe_join(parts, found, ["conv_id", "block"]), "contexts")
        ways = _looked_up(_each_start(placed), solve(_each_start(placed))).select("conv_id", "block", "start", "last")
        states = ways.groupBy("conv_id").applyInArrow(_starts, f"conv_id {kind}, block long, start int")
        chosen = null_safe_join(placed, states, ["conv_id", "block"])
        at_once = null_safe_join(at_once, long_ones, ["conv_id"], "left_anti").unionByName(chosen)
    asked = stored(at_once, "asked")
    return stored(_looked_up(asked, solve(asked)), "planned")


def _looked_up(asked: DataFrame, found: DataFrame) -> DataFrame:
    return lookup_join(asked, found, ["context", "symbols", "start"], "conv_id", small=is_small(found))


# -- results ----------------------------------------------------------------------------------------------------------


def repaired_rows(turns: DataFrame, planned: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The repaired conversations, a row a turn in the order of (pos, step), with the edit that made it."""
    pieces = planned.select(
        "conv_id", (F.col("block") * block_turns + 1).alias("_from"), F.posexplode(F.regexp_extract_all("plan", F.lit(r"([ij]*[DKUA](?:[ij]*\z)?)"), F.lit(1))).alias("_o", "_piece"))
    edits = pieces.where("_piece <> 'D'").select("conv_id", (F.col("_from") + F.col("_o")).alias("pos"), "_piece")
    steps = F.posexplode(F.split("_piece", "")).alias("step", "_edit")
    joined = null_safe_join(turns.select("conv_id", "pos", "role", "text"), edits, ["conv_id", "pos"]).select("conv_id", "pos", "role", "text", steps)
    set_to = F.when(F.col("_edit").isin("U", "i"), "user").when(F.col("_edit").isin("A", "j"), "assistant").otherwise(F.col("role"))
    return joined.where("_edit <> 'D' AND _edit <> ''").select(
        "conv_id", "pos", "step", set_to.alias("role"), F.when(F.col("_edit").isin("i", "j"), "").otherwise(F.col("text")).alias("text"),
        F.translate("_edit", PLAN, AUDIT).alias("edit"))


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 over `role:text` of each conversation's rows, newline-joined: a stream over sorted rows, nothing is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, open_ = None, None, False
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            done: list[tuple] = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if not open_ or conv != current:
                    if open_:
                        done.append((current, digest.hexdigest()))
                    current, digest, open_ = conv, hashlib.sha256(), True
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            yield _digest_batch(done, kind)
        if open_:
            yield _digest_batch([(current, digest.hexdigest())], kind)

    kind = repaired.schema["conv_id"].dataType.simpleString()
    ordered = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "step").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def _digest_batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["conv_id", "repaired_sha256"])


def report(conversations: DataFrame, turns: DataFrame, planned: DataFrame) -> DataFrame:
    """A row per conversation id: counts of faults, costs and audit."""

    def faults(kind: str) -> Column:
        return F.coalesce(F.sum((F.col("fault") == kind).cast("long")), F.lit(0)).alias(kind)

    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    counts = turns.groupBy("conv_id").agg(span.alias("gaps"), faults("blank"), faults("duplicate"), faults("truncated"))
    following = F.lead(F.substring("initials", 1, 1), 1, "").over(Window.partitionBy("conv_id").orderBy("block"))
    pairs = planned.withColumn("_row", F.concat("initials", following))
    illegal = F.length("_row") - 1 - F.regexp_count("_row", F.lit("(?=su|ua|au)"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", F.translate("plan", PLAN, AUDIT).alias("_a")))), lambda b: b["_a"]), "")
    edits = pairs.withColumn("_illegal", illegal).groupBy("conv_id").agg(
        F.sum("_illegal").cast("long").alias("illegal"), F.sum("own").cast("long").alias("cost"), audit.alias("audit"))
    ids = conversations.select("conv_id").distinct()
    every = null_safe_join(null_safe_join(ids, counts, ["conv_id"], "left"), edits, ["conv_id"], "left")
    return every.na.fill(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).na.fill("", ["audit"])


def repair(conversations: DataFrame, rows: DataFrame | None = None, block_turns: int = BLOCK_TURNS) -> tuple[DataFrame, DataFrame]:
    """Repaired rows, and the report for every id of ``conversations``, whose turns are ``rows`` (if given: a damaged version of them)."""
    turns = stored(numbered_turns(conversations if rows is None else rows, block_turns), "numbered")
    planned = planned_blocks(blocks_of(turns))
    return repaired_rows(turns, planned, block_turns), report(conversations, turns, planned)


def damage(conversations: DataFrame) -> DataFrame:
    """Faults planted by checksum of `conv_id:turn`, one row in twenty each: dropped, emptied, without sentence ends, twice, by the user."""

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(known("text"), "[.!?]", "")).otherwise(known("text"))
    return (
        conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(known("role")).alias("role"), text.alias("text"), kind.alias("_kind"))
        .where("_kind <> 0").withColumn("_times", F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .drop("_kind", "_times"))


def damaged_and_repaired(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Report and digest of all conversations after damage and repair."""
    repaired, found = repair(conversations, damage(conversations), block_turns)
    nothing = hashlib.sha256(b"").hexdigest()
    return null_safe_join(found, digests(repaired), ["conv_id"], "left").na.fill(nothing, ["repaired_sha256"]).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


#: The same report in SQL: checksums by table, signatures worked off from their last symbol, candidates compared with whole audits.
SQL = r"""
WITH RECURSIVE
crc AS (
  SELECT list(list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t
  FROM range(256) r(i)),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations),
kinds AS (
  SELECT named.*, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]))) % 20 AS kind
  FROM named, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS initial,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' END AS fault
  FROM placed),
symbols AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS symbol,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM faults),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    string_agg(symbol, '' ORDER BY pos) AS signature
  FROM symbols GROUP BY conv_id),
suffixes AS (
  SELECT signature, length(signature) AS i, {'c': 0, 'a': '', 'p': ''} AS e, {'c': 10, 'a': 'II', 'p': 'ij'} AS s, {'c': 5, 'a': 'I', 'p': 'j'} AS u, {'c': 0, 'a': '', 'p': ''} AS a
  FROM (SELECT DISTINCT signature FROM counted)
  UNION ALL
  SELECT signature, i - 1,
    least_of([e0, {'c': 5 + u1.c, 'a': 'I' || u1.a, 'p': 'i' || u1.p}]), least_of([s0, {'c': 5 + u1.c, 'a': 'I' || u1.a, 'p': 'i' || u1.p}]),
    u1, least_of([a0, {'c': 5 + u0.c, 'a': 'I' || u0.a, 'p': 'i' || u0.p}])
  FROM (
    SELECT *, least_of([u0, {'c': 5 + a0.c, 'a': 'I' || a0.a, 'p': 'j' || a0.p}]) AS u1 FROM (
      SELECT signature, i,
        least_of([deleted(e), rerole(y, u, 'U'), kept(y, 's', s), kept(y, 'u', u)]) AS e0,
        least_of([deleted(s), rerole(y, u, 'U'), kept(y, 'u', u)]) AS s0,
        least_of([deleted(u), rerole(y, a, 'A'), kept(y, 'a', a)]) AS u0,
        least_of([deleted(a), rerole(y, u, 'U'), kept(y, 'u', u)]) AS a0
      FROM (SELECT *, substr(signature, i, 1) AS y FROM suffixes WHERE i > 0)))),
best AS (SELECT signature, e.c::BIGINT AS cost, e.a AS audit, e.p AS plan FROM suffixes WHERE i = 0),
steps AS (
  SELECT signature, n, substr(plan, n, 1) AS edit, length(regexp_replace(substr(plan, 1, n), '[ij]', '', 'g')) AS pos
  FROM (SELECT signature, plan, unnest(range(1, length(plan) + 1)) AS n FROM best)),
repaired AS (
  SELECT c.conv_id, sha256(string_agg(
      CASE edit WHEN 'i' THEN 'user:' WHEN 'j' THEN 'assistant:' WHEN 'U' THEN 'user:' || text WHEN 'A' THEN 'assistant:' || text ELSE role || ':' || text END,
      chr(10) ORDER BY n)) AS repaired_sha256
  FROM counted c JOIN steps USING (signature) LEFT JOIN symbols y ON y.conv_id IS NOT DISTINCT FROM c.conv_id AND y.pos = steps.pos AND steps.edit NOT IN ('i', 'j')
  WHERE edit <> 'D' GROUP BY c.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best USING (signature)
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _expanded(sql: str) -> str:
    """The candidate expressions of the recursive step written out."""

    def kept(symbol: str, role: str, ahead: str) -> str:
        cost = f"CASE WHEN lower({symbol}) = '{role}' THEN {KEEP} + CASE WHEN {symbol} <> lower({symbol}) THEN {TRUNCATED} ELSE 0 END ELSE 1000000 END"
        return f"{{'c': {cost} + {ahead}.c, 'a': 'K' || {ahead}.a, 'p': 'K' || {ahead}.p}}"

    def rerole(symbol: str, ahead: str, letter: str) -> str:
        cost = f"CASE WHEN {symbol} = 'x' THEN 1000000 WHEN {symbol} <> lower({symbol}) THEN {REROLE + TRUNCATED} ELSE {REROLE} END"
        return f"{{'c': {cost} + {ahead}.c, 'a': 'R' || {ahead}.a, 'p': '{letter}' || {ahead}.p}}"

    def deleted(ahead: str) -> str:
        return f"{{'c': {DELETE} + {ahead}.c, 'a': 'D' || {ahead}.a, 'p': 'D' || {ahead}.p}}"

    sql = re.sub(r"kept\((\w), '(\w)', (\w)\)", lambda m: kept(*m.groups()), sql)
    sql = re.sub(r"rerole\((\w), (\w), '(\w)'\)", lambda m: rerole(*m.groups()), sql)
    sql = re.sub(r"deleted\((\w)\)", lambda m: deleted(m[1]), sql)
    return sql.replace("least_of(", "list_min(")


SQL = _expanded(SQL)
