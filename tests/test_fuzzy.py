"""Exact fuzzy search against the plain scorer on every pair."""

import random

import numpy as np
import pytest

from quern.functions import text as tx
from quern.operators import fuzzy


def test_windows_against_plain_subsequences():
    rng = random.Random(3)
    for _ in range(60):
        a = "".join(rng.choice("abcd é") for _ in range(rng.randint(1, 150)))
        b = "".join(rng.choice("abcdfé ") for _ in range(rng.randint(1, 300)))
        begin = np.array([rng.randint(0, len(b)) for _ in range(20)])
        end = np.array([rng.randint(x, len(b)) for x in begin])
        got = fuzzy.lcs_windows(fuzzy.points_of(a), fuzzy.points_of(b), begin, end)
        assert got.tolist() == [tx.lcs(a, b[x:y]) for x, y in zip(begin, end, strict=True)]


@pytest.mark.parametrize(("k", "at_least"), [(3, 0.0), (100, 0.7)])
def test_every_pair(spark, k, at_least):
    rng = random.Random(k)
    words = "ba bad bat cat cart at a tab tabs é đo xin chào hello hallo".split()
    made = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    docs = [(i, made(25)) for i in range(150)] + [(150 + i, "hello bad cat") for i in range(5)] + [(200, None), (201, ""), (202, "  "), (203, made(9) + " " + made(2000))]
    queries = [(i, made(7)) for i in range(12)] + [(20, None), (21, ""), (22, "hello  BAD cart"), (23, "hello bad cart"), (24, made(90))]
    found = fuzzy.fuzzy_best(
        spark.createDataFrame([(i, t, 0.0) for i, t in docs], "doc_id long, text string, score double").repartition(3),
        spark.createDataFrame(queries, "query_id long, text string"), k, at_least,
    )
    want = []
    for q, text in queries:
        scores = sorted((-tx.fuzzy_score(text, d), i) for i, d in docs)
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate([x for x in scores if -x[0] > 0 and -x[0] >= at_least][:k])]
    assert sorted(map(tuple, found.select("query_id", "doc_id", "score", "rank").collect())) == sorted(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    ask = lambda d: d.withColumnRenamed("doc_id", "query_id")
    assert fuzzy.fuzzy_best(none, ask(some), 2).count() == fuzzy.fuzzy_best(some, ask(none), 2).count() == 0
