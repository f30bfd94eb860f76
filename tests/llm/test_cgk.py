"""Walks and sampled tables: recall at the full edit rate in foreign text, and what the result says about it."""

import random

import numpy as np
import pyarrow as pa
import pytest
from corpus import SYLLABLES

from flowhelm.llm import cgk, decontaminate


def text(rng, n):
    return "".join(rng.choice(SYLLABLES) for _ in range(n))[:n]


def edited(rng, raw, n):
    out = bytearray(raw)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(b"#%$")
        elif kind == 1:
            out.insert(at, rng.choice(b"#%$"))
        else:
            del out[at]
    return bytes(out)


@pytest.mark.parametrize("low", [32, 64, 128, 256, 1024])
def test_walks_alone_find_copies_at_the_full_edit_rate(low):
    """Other copies than those of the calibration: a tenth of the bytes replaced, inserted or deleted, any phase, other text around."""
    rng = random.Random(low)
    raws = [text(rng, rng.randrange(low, 2 * low)).encode() for _ in range(40)]
    walks = cgk.Walks(low, np.arange(40), raws, 0.1)
    assert walks.measured >= 0.95
    found = total = 0
    for n, raw in enumerate(raws):
        for _ in range(5):
            data = f"{text(rng, rng.randrange(3 * low))} ".encode() + edited(rng, raw, len(raw) // 10) + f" {text(rng, low)}".encode()
            windows, entries, _ = walks.candidates(np.frombuffer(data, np.uint8), np.arange(0, len(data), walks.stride))
            found += n in walks.owner[entries]
            total += 1
    assert found >= 0.95 * total
    other = np.frombuffer("".join(rng.choice("ABCDEFGH123456789") for _ in range(20_000)).encode(), np.uint8)
    assert len(walks.candidates(other, np.arange(0, len(other), walks.stride))[0]) == 0


def test_few_and_equal_items():
    one = cgk.Walks(64, np.array([3]), [b"abcdefgh" * 9], 0.1)  # a text of one period
    assert one.measured >= 0.9
    assert cgk.Walks(64, np.arange(2), [b"a" * 70, b"a" * 80], 0.0).measured >= 0.9


def test_result_says_what_found_it(spark):
    rng = random.Random(9)
    items = [(1, text(rng, 150)), (2, text(rng, 300)), (3, "short item text")]
    texts = [f"{text(rng, 50)} {t} {text(rng, 50)}" for _, t in items] + [f"{text(rng, 40)} {edited(rng, items[1][1].encode(), 15).decode()}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string"), evidence=True).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 3), (3, 2)}
    assert got[0, 1].by_walk and got[1, 2].by_walk and not got[2, 3].by_walk
    assert got[2, 3].recall is None and all(got[k].recall >= 0.95 for k in ((0, 1), (1, 2), (3, 2)))
    empty = decontaminate.Finder([])
    assert list(empty.found(pa.array(["a", None]))) == []
