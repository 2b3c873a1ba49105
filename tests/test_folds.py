"""Order-dependent folds against plain restatements."""

import itertools
import random

import numpy as np
import pytest

from quern.functions import text as tx
from quern.operators import folds


def plain_cuts(starts, ends, reward, low, high):
    n, best = len(starts), None
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            at = [0, *cuts, n]
            if all(low <= ends[b - 1] - starts[a] <= high for a, b in zip(at, at[1:], strict=False)):
                score = sum(reward[c - 1] for c in cuts)
                best = score if best is None else max(best, score)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_segments_are_the_best(seed):
    r = random.Random(seed)
    starts = np.cumsum([0] + [r.choice([1.0, 2.0, 5.0, 9.0, 14.0]) for _ in range(8)])
    ends, starts = starts[1:], starts[:-1]
    reward = np.array([r.uniform(-0.5, 0.5) for _ in starts])
    found = folds.cut_events(ends - starts, starts, ends, reward, 3, 30)
    want = plain_cuts(starts, ends, reward, 3, 30)
    if want is None:
        assert found is None
    else:
        assert found[0][0] == 0 and found[-1][1] == len(starts)
        assert sum(reward[b - 1] for _, b in found[:-1]) == pytest.approx(want)


def test_long_shots_and_rests():
    def cut(*durations):
        e = np.cumsum(durations).astype(float)
        return folds.segments(e - durations, e, np.full(len(e), -1.0))

    assert cut(1, 31) == [(0, 2)]
    assert cut(5, 31, 1) == [(0, 1), (1, 3)]
    assert cut(40, 35) == [(0, 1), (1, 2)]
    assert cut(40, 1, 35) == [(0, 2), (2, 3)]
    assert cut(1) == [(0, 1)]


def plain_chain(score, order, gap, skip):
    n, m = score.shape
    best = np.zeros((n, m))
    last = np.full((n, m), None)
    for t, s in itertools.product(range(n), range(m)):
        options = [(score[t, s], order[t, s])] if score[t, s] > 0 else [(0.0, None)]
        if t:
            options.append((best[t - 1, s], last[t - 1, s]))
            if s and score[t, s] > 0 and best[t - 1, s - 1] > 0 and order[t, s] - last[t - 1, s - 1] >= gap:
                options.append((best[t - 1, s - 1] + score[t, s], order[t, s]))
        if s:
            u = max(range(t + 1), key=lambda x: best[x, s - 1])
            options.append((skip * best[u, s - 1], last[u, s - 1]))
        value = max(o[0] for o in options)
        best[t, s], last[t, s] = next(o for o in options if o[0] == value)
    return best.max() if n else 0.0


@pytest.mark.parametrize("seed", range(40))
def test_chains(seed):
    r = np.random.default_rng(seed)
    n, m = r.integers(1, 9), r.integers(1, 4)
    score = np.where(r.random((n, m)) < 0.5, r.random((n, m)).round(2), 0)
    order = np.arange(n)[:, None] + r.integers(0, 3, (n, m))
    total, hops, _ = folds.chain(score, order, 1, 0.7)
    assert total == pytest.approx(plain_chain(score, order, 1, 0.7))
    assert [s for s, _ in hops] == sorted({s for s, _ in hops})


def test_chain_skips_a_missing_stage():
    score = np.array([[1.0, 0, 0], [0, 0, 0], [0, 0, 0.9]])
    total, hops, skipped = folds.chain(score, np.arange(3)[:, None].repeat(3, 1), 1, 0.7)
    assert total == pytest.approx(0.7 + 0.9) and hops == [(0, 0), (2, 2)] and skipped == 1


def test_grouped_folds(spark):
    frames = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.99, 0.01]), (1, 2, [0.0, 1.0]), (1, 3, [0.7, 0.7]), (2, 0, [1.0, 1.0])], "video long, idx long, emb array<float>")
    assert sorted(map(tuple, folds.greedy_keyframes(frames, "video").collect())) == [(1, 0), (1, 2), (1, 3), (2, 0)]
    got = sorted(map(tuple, folds.leader_clusters(frames, "video", 0.8).collect()))
    assert got == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 0, 0)]
    texts = spark.createDataFrame([(1, 0, "Xin chao"), (1, 12, "Xin chào"), (1, 25, "Xin chào"), (1, 26, "khác hẳn")], "video long, frame long, text string")
    assert sorted(map(tuple, folds.merge_runs(texts, "video").collect())) == [(1, 0, 12, "Xin chào"), (1, 25, 25, "Xin chào"), (1, 26, 26, "khác hẳn")]
    boxes = spark.createDataFrame([(1, f, 0, 10.0 + f % 3, 10.0) for f in range(10)] + [(1, 3, 1, 300.0, 9.0)], "video long, frame long, idx long, x double, y double")
    (only,) = folds.position_clusters(boxes, "video").collect()
    assert only["frames"] == 10 and abs(only["x"] - 11) < 0.2


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_fuzzy():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("ab c") for _ in range(r.randrange(12))) for _ in range(2))
        assert tx.lcs(a, b) == plain_lcs(a, b)
    assert tx.fuzzy_score("big  CAT", "a big cat sat") == 1.0
    assert tx.fuzzy_score("", "x") == 0.0 and tx.fuzzy_score("x", None) == 0.0
    assert 0 < tx.fuzzy_score("bag cat", "a big cat sat") < 1
    assert tx.token_set_ratio("b a", "a b c") == 1.0
    assert tx.partial_ratio("abc", "xxabcxx") == 1.0
    assert tx.similarity("Đường", "duong") > 0.99
