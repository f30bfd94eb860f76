"""Repairs against brute force over edits, in blocks of any size, and on odd rows."""

import functools
import hashlib
import itertools
import random
import re

import pytest
from corpus import prose

from flowhelm.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(symbols):
    """Least (cost, audit, plan) over all edits with at most four inserts in a row, whole audits compared."""

    @functools.lru_cache(None)
    def best(at, last, inserts):
        found = [(0, "", "")] if at == len(symbols) and last in ("", "a") else []

        def go(cost, edit, letter, role, to, left):
            if role and (last, role) not in STEP:
                return
            rest = best(to, role or last, left)
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1], letter + rest[2]))

        if inserts:
            go(5, "I", "i", "u", at, inserts - 1)
            go(5, "I", "j", "a", at, inserts - 1)
        if at < len(symbols):
            y = symbols[at]
            go(2, "D", "D", "", at + 1, 4)
            if y != "x":
                more = 5 if y.isupper() else 0
                if y.lower() != "o":
                    go(more, "K", "K", y.lower(), at + 1, 4)
                go(more + 1, "R", "U", "u", at + 1, 4)
                go(more + 1, "R", "A", "a", at + 1, 4)
        return min(found, default=None)

    return best(0, "", 4)


def by_hand(rows):
    """Report and repaired rows of one conversation, its rows in order."""
    seen, symbols, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        initial = role[0] if role[:1] in ("s", "u", "a") and role else "o"
        symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        if fault:
            counts[fault] += 1
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, plan = cheapest(symbols)
    out, left = [], iter(rows)
    for edit in plan:
        if edit in "ij":
            out.append(("user:", "assistant:")["ij".index(edit)])
            continue
        _, role, text = next(left)
        if edit != "D":
            out.append({"K": role, "U": "user", "A": "assistant"}[edit] + ":" + text)
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(rng, n):
    rows = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", " ", ""])
            text = rng.choice([prose(rng, 3), prose(rng, 3) + ".", prose(rng, 2) + "!\n ", "same.", "same.", "", " \t", "ends  "])
            rows.append((c if c else None, rng.choice([t, t, t + 3, None]), role, text))
    return rows


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role.encode(), text.encode())


def expected(rows):
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    return {c: by_hand(sorted(turns, key=order)) for c, turns in groups.items()}


def result(frame, digests):
    digest = {r.conv_id: r.repaired_sha256 for r in digests.collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.conv_id, nothing)) for r in frame.collect()}


@pytest.mark.parametrize("block_turns", [1, 2, 4, repair.BLOCK_TURNS])
def test_against_brute_force(spark, block_turns):
    rows = conversations(random.Random(block_turns), 60)
    repaired, report = repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), block_turns=block_turns)
    assert result(report, repair.digests(repaired)) == expected(rows)


def test_nodes_are_shared_and_ties_settled():
    signatures = ["".join(s) for n in range(5) for s in itertools.product("suaoSUAOx", repeat=n)]
    path = repair.Path()
    for symbols in sorted(signatures, key=lambda s: s[::-1]):
        path.read(repair.END, symbols[::-1])
        total, own, plan, _ = path.best(repair.START)
        cost, audit, want = cheapest(symbols)
        assert (total, own, plan) == (cost, cost, want) and plan.translate(str.maketrans(repair.PLAN, repair.AUDIT)) == audit
    assert path.made == len(signatures) - 1  # one node for each suffix


def test_dropped_conversations_nulls_and_extra_columns(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x."), (2, None, "user", "a."), (2, None, "user", "a."), (3, 0, "user", "b.")]
    wide = [(*r, "clash", 7, "x") for r in rows]
    frame = spark.createDataFrame(wide, SCHEMA + ", pos string, block int, symbol string")
    repaired, report = repair.repair(frame, frame.where("conv_id <> 3"))
    got = result(report, repair.digests(repaired))
    assert got == expected([r for r in rows if r[0] != 3]) | {3: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair.damaged_and_repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repaired_rows(spark):
    rows = [(5, 0, "system", "Be brief."), (5, 1, "user", "Hi."), (5, 2, "user", "Hello?"), (5, 4, "tool", "42."), (5, 5, "assistant", "42.")]
    repaired, _ = repair.repair(spark.createDataFrame(rows, SCHEMA))
    got = [(r.role, r.text, r.edit) for r in repaired.orderBy("pos", "step").collect()]
    assert got == [("system", "Be brief.", "K"), ("user", "Hi.", "K"), ("assistant", "Hello?", "R"), ("user", "42.", "R"), ("assistant", "42.", "K")]


def test_long_text_and_hot_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(5000)] + [(2, 0, "user", "long " * 400_000 + ".")]
    repaired, report = repair.repair(spark.createDataFrame(rows, SCHEMA), block_turns=64)
    got = result(report, repair.digests(repaired))
    text = "\n".join(f"{r}:{x}" for c, _, r, x in rows if c == 1)
    assert got[1] == (0, 0, 0, 0, 0, 0, "K" * 5000, hashlib.sha256(text.encode()).hexdigest())
    assert got[2][:-1] == (0, 0, 0, 0, 0, 2, "D")


def test_query_on_damaged_table(spark, sf):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in repair.damage(spark.read.parquet(f"{sf}/conversations.parquet")).collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.QUERIES["op13_repair"](spark, sf).collect()}
    want = expected(rows)
    assert {c: got[c] for c in want} == want
