import hashlib

import xxhash
from pyspark.sql import functions as F

from flowhelm.llm import fingerprint as fp


def brute(text: str, k: int, window: int) -> list[tuple[int, int]]:
    data = text.encode()
    n = max(len(data) - k + 1, min(len(data), 1))
    grams = [(xxhash.xxh64_intdigest(data[i : i + k], 42) >> 31, i) for i in range(n)]
    chosen = []
    for i in range(max(1, n - window + 1) if n else 0):
        low = min(grams[i : i + window], key=lambda g: (g[0], -g[1]))
        if low not in chosen:
            chosen.append(low)
    return chosen


TEXTS = {
    9: "the quick brown fox jumps over the lazy dog and runs away into the deep dark forest", 8: None, 7: "", 6: "ab", 5: "a" * 60,
    4: "été où ça naïve — " * 6, 3: "a\nb", 2: "the quick brown fox jumps over the lazy cat", None: "no id at all here, but a text it is", 1: "xyz" * 30,
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")


def test_against_brute_force(spark):
    rows = [(i, t, "clash") for i, t in TEXTS.items()]
    for block in (1000, 3):
        got = {r.doc_id: r for r in fp.compare_edits(frame(spark, rows), 5, 4, block).collect()}
        assert len(got) == len(rows)
        order = sorted(TEXTS, key=lambda i: (i is None, -(i or 0)))
        for at, i in enumerate(order):
            text, after = TEXTS[i] or "", TEXTS[order[(at + 1) % len(order)]] or ""
            third = len(text) // 3
            edited = text[: len(text) - third] + after[:third]
            a, b, c = (brute(t, 5, 4) for t in (text, edited, after))
            assert got[i].n_chars == len(text)
            assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert got[i].fingerprint == ",".join(f"{h:X}" for h, _ in a)
            assert got[i].edited_fingerprint == ",".join(f"{h:X}" for h, _ in b), (i, block)
            for name, other in (("near_edited", b), ("near_next", c)):
                x, y = {h for h, _ in a}, {h for h, _ in other}
                assert abs(got[i][name] - (len(x & y) / len(x | y) if x | y else 1.0)) < 1e-12


def test_positions_and_guarantee(spark):
    text = TEXTS[9]
    row = fp.winnow(frame(spark, [(1, text, ""), (2, "### " + text + " %%%", "")]), "text", "f", 5, 4).select("doc_id", fp.hashes(F.col("f")).alias("h"), fp.positions(F.col("f")).alias("p")).collect()
    one, two = ({(h, p - 4 * (r.doc_id - 1)) for h, p in zip(r.h, r.p, strict=True)} for r in row)
    assert [(h, p) for h, p in zip(row[0].h, row[0].p, strict=True)] == brute(text, 5, 4)
    assert len(one & two) >= len(one) - 4


def test_empty_single_and_repeated(spark):
    assert fp.compare_edits(frame(spark, [])).count() == 0
    one = fp.compare_edits(frame(spark, [(1, "some words of a text", "x")])).first()
    assert one.near_next == 1.0
    same = fp.compare_edits(frame(spark, [(1, "some words of a text", "x")] * 3)).collect()
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 1
