"""The pipeline's near-duplicate stage against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quern.llm import simhash


def plain_kept(rows):
    """The smallest id of each component of similarity 0.8 or more."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if 5 * both >= 4 * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return set(least.values())


@pytest.mark.parametrize(("part", "tile"), [(4096, 16_384), (3, 9)])
def test_near_copies_are_kept_once(spark, monkeypatch, part, tile):
    monkeypatch.setattr(simhash, "PART", part)
    monkeypatch.setattr(simhash, "WIDE_TILE", tile)
    r = random.Random(4)
    rows = []
    for base in range(6):
        words = [f"w{r.randrange(5000)}" for _ in range(120)]
        for edits in (0, 0, 1, 2, 3, 4, 8):
            copy = list(words)
            for at in r.sample(range(120), edits):
                copy[at] = f"x{r.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(100, None), (101, ""), (102, "a b"), (103, "A  b"), (104, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    kept = [x["doc_id"] for x in stage(spark, docs, "").collect()]
    assert sorted(kept) == sorted(plain_kept(rows))


def test_linked_forest():
    sets = [np.arange(a, a + 100, dtype=np.uint64) for a in (0, 5, 11, 200, 22, 205, 900)]
    u, v = simhash.linked(sets)
    assert len(u) == 4 and {frozenset(x) for x in zip(u.tolist(), v.tolist())} <= {frozenset(p) for p in ((0, 1), (0, 2), (1, 2), (2, 4), (3, 5))}


def test_candidates_reach_similarity_four_fifths():
    r = np.random.default_rng(8)
    missed = 0
    for n in (8, 9, 20, 100, 2000):
        for _ in range(200):
            shared, a, b = np.split(r.integers(1 << 63, size=n + 2 * (n // 8), dtype=np.uint64), [n, n + n // 8])  # n / (n + 2n/8) = 4/5
            x, y = (np.frombuffer(simhash.wide_fingerprint(np.concatenate([shared, more])), np.uint64)[None] for more in (a, b))
            missed += simhash.close_wide(x, y, False).tolist() != [0, 0]
    assert missed <= 2
