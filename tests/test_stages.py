"""Searches in stages, boundary tables and repaired folds against plain restatements."""

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import boundary, evaluate, folds, pooling, search, shots, stages


def plain_chain(place, scores, c):
    """Every state with its way back, as the rules say: all earlier times are searched for a skip, and any state may end the chain."""
    times, n = scores.shape
    support = [[max(((scores[u, s], -place[u]) for u in range(times) if abs(place[u] - place[t]) <= c.window and scores[u, s] > 0), default=(0.0, None)) for s in range(n)] for t in range(times)]
    best, final = {}, (0.0, [], 0, None)
    for t, s in itertools.product(range(times), range(n)):
        x, o = support[t][s][0], None if support[t][s][1] is None else -support[t][s][1]
        state = (x, [(s, o)], 0, o) if x > 0 else (0.0, [], 0, None)
        if t and best[t - 1, s][0] > state[0]:
            state = best[t - 1, s]
        if t and s and x > 0 and best[t - 1, s - 1][0] > 0:
            was = best[t - 1, s - 1]
            if o - was[3] >= c.apart and was[0] + x > state[0]:
                state = (was[0] + x, was[1] + [(s, o)], was[2], o)
        if s:
            was = max((best[u, s - 1] for u in range(t + 1)), key=lambda b: b[0])
            if c.skip * was[0] > state[0]:
                state = (c.skip * was[0], was[1], was[2] + 1, was[3])
        best[t, s] = state
        if state[0] > final[0]:
            final = state
    return final


@pytest.mark.parametrize("seed", range(80))
def test_best_chain(seed):
    r = random.Random(seed)
    times, n = r.randint(1, 14), r.randint(1, 4)
    place = np.cumsum([r.choice([1, 2, 5]) for _ in range(times)])
    scores = np.array([[r.choice([0.0, 0.0, r.uniform(-0.2, 1)]) for _ in range(n)] for _ in range(times)])
    c = stages.Chaining(gap=10, window=r.choice([0, 2, 4]), apart=r.choice([1, 3]), skip=r.choice([0.7, 0.95]))
    found, want = stages.best_chain(place, scores, c), plain_chain(place, scores, c)
    if found is None:
        assert want[0] == 0
    else:
        assert found[0] == pytest.approx(want[0]) and [(s, o) for s, o, _, _ in found[1]] == want[1] and found[2] == want[2]
        assert all(v[s] == x for s, _, x, v in found[1])


def test_chain_ends_at_any_stage():
    """A last stage without hits costs nothing; a missing middle one costs the discount."""
    c = stages.Chaining(window=0, apart=1)
    ends = np.array([[1.0, 0, 0], [0, 1.0, 0]])
    assert stages.best_chain(np.array([1, 5]), ends, c)[0] == 2.0
    gap = np.array([[1.0, 0, 0], [0, 0, 1.0]])
    score, hops, skipped = stages.best_chain(np.array([1, 5]), gap, c)
    assert score == pytest.approx(1.7) and [h[0] for h in hops] == [0, 2] and skipped == 1
    assert stages.best_chain(np.array([1]), np.zeros((1, 2)), c) is None


def test_weights_and_fusion(spark):
    asked = spark.createDataFrame([(1, 0, "text"), (1, 0, "ocr"), (1, 1, "image"), (2, 0, "odd")], "query_id long, stage long, channel string")
    w = {(r["query_id"], r["stage"], r["channel"]): r["weight"] for r in stages.stage_weights(asked, {"text": 0.4, "ocr": 0.3, "image": -1}).collect()}
    assert w == {(1, 0, "text"): pytest.approx(4 / 7), (1, 0, "ocr"): pytest.approx(3 / 7), (1, 1, "image"): 1.0, (2, 0, "odd"): 1.0}
    hits = [(1, 0, "text", "v", 5, 0.5), (1, 0, "text", "v", 5, 1.0), (1, 0, "text", "v", 6, -0.5), (1, 0, "ocr", "v", 6, 2.0), (1, 0, "ocr", "v", 7, -3.0), (1, 0, "subtitle", "v", 9, 4.0), (1, 1, "image", "v", 5, -2.0)]
    df = spark.createDataFrame(hits, "query_id long, stage long, channel string, video string, place long, score double")
    got = {(r["stage"], r["place"]): (r["score"], r["channels"]) for r in stages.fused(df, stages.stage_weights(asked, {"text": 0.4, "ocr": 0.3})).collect()}
    assert got == {(0, 5): (1.0, {"text": 1.0}), (0, 6): (pytest.approx((3 / 7 - 2 / 7) / (4 / 7)), {"text": -0.5, "ocr": 1.0}), (1, 5): (1.0, {"image": 1.0})}


def test_temporal_search_of_one_and_many_stages(spark):
    asked = spark.createDataFrame([(1, 0, "text"), (2, 0, "text"), (2, 1, "text"), (3, 0, "text")], "query_id long, stage long, channel string")
    hits = [(1, 0, "text", "a", 10, 0.9), (1, 0, "text", "b", 7, 0.3), (2, 0, "text", "a", 100, 1.0), (2, 1, "text", "a", 400, 0.5), (2, 1, "text", "a", 9000, 1.0)]
    df = spark.createDataFrame(hits, "query_id long, stage long, channel string, video string, place long, score double")
    got = {(r["query_id"], r["rank"]): (r["video"], round(r["score"], 6), r["matched"], [(h["stage"], h["place"]) for h in r["chain"]]) for r in stages.temporal_search(df, asked, 5).collect()}
    assert got == {(1, 1): ("a", 1.0, 1, [(0, 10)]), (1, 2): ("b", round(1 / 3, 6), 1, [(0, 7)]), (2, 1): ("a", 1.5, 2, [(0, 100), (1, 400)]), (2, 2): ("a", 1.0, 1, [(1, 9000)])}
    assert stages.temporal_search(df.limit(0), asked, 5).count() == 0


def test_fold_takes_null_for_a_key(spark):
    rows = [(a, b, i, float(i)) for a in (None, 1) for b in (0, None, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "a long, b long, i long, x double")
    got = folds.fold(df, ["a", "b"], ["i"], ["x"], lambda p: [(len(p["x"]), float(p["x"].sum()))], "n long, t double").collect()
    assert len(got) == 6 and {(r["n"], r["t"]) for r in got} == {(50, 1225.0)}


def test_fold_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(3000).select((F.col("id") % 5).alias("g"), "id")
        got = folds.fold(df, ["g"], ["id"], ["id"], lambda p: [(len(p["id"]), bool((np.diff(p["id"]) == 5).all()))], "n long, ok boolean").collect()
        assert sorted((r["g"], r["n"], r["ok"]) for r in got) == [(g, 600, True) for g in range(5)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pools_of_groups_without_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], None), (1, None, None), (2, [1.0, 0.0], [0.0, 2.0])], "g long, a array<double>, b array<double>")
    got = {r["g"]: r.asDict() for r in folds.multi_pools(df, ["g"], ["a", "b"], 2).collect()}
    assert got[1]["has_a"] and not got[1]["has_b"] and got[1]["b_soft"] == [0.0, 0.0]
    assert got[1]["a_mean"] == pytest.approx([0.6, 0.8]) and got[1]["a_soft"] == pytest.approx([0.6, 0.8]) and got[2]["b_max"] == pytest.approx([0.0, 1.0])


def test_expand_with_many_channels(spark):
    """Channels with edges don't hit their items as well, however many there are."""
    hits = spark.createDataFrame([(1, f"c{i}", i, 1) for i in range(100)] + [(1, "own", 500, 2)], "query_id long, channel string, item_id long, rank int")
    edges = spark.createDataFrame([(f"c{i}", i, i + 1000, 0.5) for i in range(99)], "channel string, item_id long, target long, weight double")
    got = sorted((r["target"], r["weight"]) for r in pooling.expand(hits, edges).collect())
    assert got == sorted([(i + 1000, 0.5) for i in range(99)] + [(99, 1.0), (500, 1.0)])


def test_face_sets_and_used_weights(spark):
    faces = spark.createDataFrame([("v", 0, [2]), ("v", 1, None), ("v", 2, [1, 2]), ("v", 3, [7])], "video string, idx long, face_ids array<long>")
    got = {r["idx"]: (r["left_ids"], r["right_ids"], r["shared_ids"]) for r in boundary.face_context(faces, "video", 2).collect()}
    assert got == {0: ([2], [1, 2], [2]), 1: ([2], [1, 2, 7], [2]), 2: ([1, 2], [7], [])}
    df = spark.createDataFrame([(True, False), (False, False)], "a_valid boolean, b_valid boolean")
    assert [r[0] for r in df.select(boundary.used_weights({"a": 0.3, "b": 0.4})).collect()] == [{"a": 1.0}, {}]


def test_sampled_frames(spark):
    got = spark.range(1).select(*(shots.sample_frames(F.lit(a).cast("long"), F.lit(b).cast("long"), 3, F.lit(40).cast("long")) for a, b in ((-2, 5), (5, 4), (-9, -3), (50, 60), (38, 45)))).first()
    assert list(got) == [[1, 4], [4], [0], [39], [38]]


def test_normalised_shots_keep_what_is_given(spark):
    raw = spark.createDataFrame([("v", 0, None, 9.0, 12.0, 2.5, 4), ("v", 1, 8, 1.0, 0.5, None, None)], "video string, place long, id long, start double, end double, duration_sec double, start_frame long")
    got = sorted(tuple(r) for r in shots.normalise(raw, "video", "place").collect())
    assert got == [("v", 0, 9.0, 12.0, 2.5, 4, None), ("v", 8, 1.0, 0.5, 0.0, None, None)]


def test_index_windows_by_share(spark):
    cases = [(0.0, 1.0), (-5.0, 0.0), (9.99, 20.0), (12.0, 13.0)]
    got = spark.range(1).select(*(shots.index_window(F.lit(a), F.lit(b), F.lit(0.0), F.lit(10.0), F.lit(8)) for a, b in cases)).first()
    assert [tuple(r) for r in got] == [(0, 1), (0, 1), (7, 8), (7, 8)]


def test_knn_ties_over_batches(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(5000)], "item_id long, emb array<double>")
    queries = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id long, emb array<double>")
    got = sorted((r["query_id"], r["rank"], r["item_id"]) for r in search.knn(vectors, queries, 4).collect())
    assert got == [(1, i + 1, 2 + 3 * i) for i in range(4)] + [(2, i + 1, i) for i in range(4)]


def test_keyframe_evaluation_from_json(spark):
    chain = lambda *at: json.dumps([[[v, f], [[0.5], 1.0, i]] for i, (v, f) in enumerate(at)])
    rows = [
        (1, "single-stage", 1, '["broken"'), (1, "single-stage", 2, json.dumps([["v", 500], 0.9])), (1, "single-stage", 3, json.dumps([["v", 50], 0.8])),
        (2, "multi-stage", 1, chain(("v", 10), ("v", "x"))), (2, "multi-stage", 2, chain(("u", 10), ("u", 90))), (2, "multi-stage", 3, chain(("v", 10), ("v", 90))), (3, "multi-stage", 1, chain(("v", 25), ("v", 25))),
    ]
    body = spark.createDataFrame([(json.dumps({"results": [{"video_id": "v", "fps": 25}]}),)], "body string")
    truth = spark.createDataFrame([(q, "v", 1.0, 2.0) for q in (1, 2, 3, 4)], "query_id long, video string, s double, e double")
    df = spark.createDataFrame(rows, "query_id long, mode string, rank int, result string")
    got = {r["query_id"]: (r["video_rank"], r["first"]) for r in evaluate.keyframe_ranks(df, evaluate.fps_map(body), truth).collect()}
    assert got == {1: (2, 3), 2: (3, 3), 3: (1, None), 4: (None, None)}
    with pytest.raises(Exception, match="frame rates"):
        evaluate.fps_map(spark.createDataFrame([("[1]",)], "body string")).collect()
