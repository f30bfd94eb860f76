"""The mixture's score against sums over Python counters, and the weights against expectation-maximisation on exact estimates."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from corpus import docs, rows  # noqa: F401

from flowhelm.llm import ngrams


def model(rows):
    """Tokens by document, and counts (tokens, pairs, contexts) of the kept, the deleted and all training documents."""
    tokens = {r[0]: [*brute.WORD.findall((r[1] or "").translate(brute.UPPER)), None] for r in rows}
    crc = {i: zlib.crc32(str(i).encode()) for i in tokens}
    train = [i for i in tokens if crc[i] % 7 != 2]
    deleted = [i for i in train if crc[i] // 7 % ngrams.FOLDS == 0]

    def counts(ids):
        single = Counter(x for i in ids for x in tokens[i])
        pair = Counter(p for i in ids for p in zip([0, *tokens[i]], tokens[i]))  # noqa: B905
        return single, pair, Counter(p for i in ids for p in [0, *tokens[i][:-1]])

    kept = [i for i in train if i not in deleted]
    return tokens, deleted, counts(kept), counts(train)


def bucket(n):
    return int(math.log2(n)) + 1 if n else 0


@pytest.fixture(scope="module")
def grown(spark, rows):
    """The fixture's documents several times under other ids, so that a tenth of them holds enough tokens."""
    return [(40 * k + r[0], r[1]) for k in range(6) for r in rows]


def test_scores_to_the_last_digit(spark, grown):
    tokens, deleted, (single, pair, context), (all_single, all_pair, all_context) = model(grown)
    n, v = sum(single.values()), len(single)
    cells = Counter()
    for i in deleted:
        for p in zip([0, *tokens[i]], tokens[i]):  # noqa: B905
            share = pair[p] / max(context[p[0]], 1)
            code = bucket(context[p[0]]) << 40 | int(ngrams._log_cell(np.array([share]))[0]) << 20 | int(ngrams._log_cell(np.array([float(single[p[1]])]))[0])
            cells[code] += 1
    assert len(cells) > 20
    weights = ngrams.learn_weights(dict(cells), n, v)
    all_n, all_v = sum(all_single.values()), len(all_single)
    got = {r.doc_id: r for r in ngrams.score(spark.createDataFrame(grown, "doc_id long, text string").repartition(3)).collect()}
    for i, own in tokens.items():
        want = 0.0
        for p in zip([0, *own], own):  # noqa: B905
            w = weights[bucket(all_context[p[0]])]
            want += math.log10(w[0] * all_pair[p] / max(all_context[p[0]], 1) + w[1] * all_single[p[1]] / all_n + w[2] / (all_v + 1))
        assert got[i].score == pytest.approx(want, rel=1e-9, abs=1e-9)


def test_weights_are_those_of_exact_estimates(grown):
    """Cells round estimates to an eighth of a doubling; the weights they give are near those of the estimates themselves."""
    tokens, deleted, (single, pair, context), _ = model(grown)
    n, v = sum(single.values()), len(single)
    cells, exact = Counter(), {}
    for i in deleted:
        for p in zip([0, *tokens[i]], tokens[i]):  # noqa: B905
            share, b = pair[p] / max(context[p[0]], 1), bucket(context[p[0]])
            cells[b << 40 | int(ngrams._log_cell(np.array([share]))[0]) << 20 | int(ngrams._log_cell(np.array([float(single[p[1]])]))[0])] += 1
            exact.setdefault(b, []).append((share, single[p[1]] / n, 1 / (v + 1)))
    weights = ngrams.learn_weights(dict(cells), n, v)
    for b, parts in exact.items():
        p = np.array(parts)
        w = np.array([0.4, 0.4, 0.2]) if b else np.array([0.0, 0.7, 0.3])
        for _ in range(5000):
            share = p * w
            w = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        gain = np.log(p @ w).mean() - np.log(p @ weights[b]).mean()
        assert -1e-9 <= gain < 2e-3  # the likelihood of the deleted tokens is as good as the best
