"""Edges of the joins, fusions, features and sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vectors as vx
from quern.operators import boundary, evaluate, intervals, search, shots
from quern.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_zero_length_and_bridging_subtitles(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 9.0)], "video long, idx long, s double, e double")
    subs = spark.createDataFrame([(1, 7, 4.8, 5.4), (1, 8, 2.0, 2.0), (1, 9, 5.0, 5.0)], "video long, sid long, bs double, be double")
    assert [(v, i, x) for v, i, x, *_ in rows(intervals.edge_weights(subs, s, "video").select("video", "sid", "idx"))] == [(1, 7, 0), (1, 7, 1)]
    assert intervals.overlap_join(s, subs, "video", closed=True).where("sid = 9").count() == 2
    (b,) = intervals.bridge(s, subs, "video").collect()
    assert b["items"] == 1 and b["total"] == pytest.approx(0.2) and b["penalty"] == pytest.approx(0.16)


def test_points_and_nearest(spark):
    s = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 6.0, 9.0)], "video long, idx long, s double, e double")
    p = spark.createDataFrame([(1, 1, 2.0), (1, 2, 9.0), (1, 3, 99.0), (1, 4, 5.0000005), (1, 5, 5.5), (1, 6, -1.0)], "video long, id long, t double")
    assert rows(intervals.point_in_interval(p, s, "video")) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 0), (1, 5, 1), (1, 6, 1)]
    m = spark.createDataFrame([(1, 10), (1, 20), (1, 40)], "video long, m long")
    q = spark.createDataFrame([(1, 1, 15), (1, 2, 5), (1, 3, 90), (1, 4, 14), (2, 5, 1)], "video long, id long, t long")
    assert rows(intervals.nearest(q, m, "video")) == [(1, 1, 20), (1, 2, 10), (1, 3, 40), (1, 4, 10), (2, 5, None)]


def test_fusion_edges(spark):
    one = spark.createDataFrame([(1, "a", 1, 3.0), (2, "a", 2, 2.0)], "item_id long, channel string, rank int, score double")
    got = {r["item_id"]: r["fused"] for r in search.rank_decay_fusion(one, 10).collect()}
    assert got[1] > got[2]  # a single model keeps its ranking
    assert rows(search.max_norm_fusion(one.where("false"), {"a": 1.0})) == []
    assert {r["item_id"]: r["fused"] for r in search.max_norm_fusion(one, {"a": 0.5}).collect()} == pytest.approx({1: 1.0, 2: 2 / 3})
    assert search.channel_weights({"a": 0.4, "b": -1}, ["a", "b"]) == {"a": 1.0, "b": 0.0}
    assert search.channel_weights({}, ["a", "b"]) == {"a": 0.5, "b": 0.5}
    r = search.accumulate(one, ["item_id"], {"a": 2.0}).where("item_id = 1").first()
    assert r["score"] == pytest.approx(2 / 61) and r["evidence"]["a"]["rank"] == 1


def test_knn_edges(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERIES", 1)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 1.0])], "item_id long, emb array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "query_id long, emb array<float>")
    assert rows(search.knn(v, q, 2).select("query_id", "rank", "item_id")) == [(1, 1, 1), (1, 2, 2), (2, 1, 4), (2, 2, 1)]
    assert search.subset_knn(v, q, v.where("false"), 2).count() == 0
    assert search.knn(v, q.where("false"), 2).count() == 0


def test_pools(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (1, None), (2, [1.0, 0.0]), (2, [-1.0, 0.0])], "k long, v array<double>")
    for how in ("mean", "max", "softmax"):
        got = {(r["k"], r["pos"]): r["x"] for r in vx.pool(v, "k", "v", how).collect()}
        assert got[1, 0] == pytest.approx(0.6) and got[1, 1] == pytest.approx(0.8)
    assert vx.pool(v.where("v is null"), "k", "v").count() == 0
    n = v.where("k = 1 and v is not null").select(*(vx.l2_normalize(F.col("v"), m)[0].alias(m) for m in ("add", "clip", "keep"))).first()
    assert all(x == pytest.approx(0.6) for x in n)


def test_changes(spark):
    s = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, None), (1, 2, [0.0, 1.0]), (2, 0, [1.0, 0.0])], "video long, idx long, v array<double>")
    got = {(r["video"], r["idx"]): (round(r["change"], 6), r["valid"]) for r in boundary.embedding_change(s, "video", "v").collect()}
    assert got == {(1, 0): (1.0, True), (1, 1): (1.0, True)}
    faces = spark.createDataFrame([(1, 0, "a", 1)], "video long, idx long, face string, n long")
    cuts = spark.createDataFrame([(1, 0), (1, 9)], "video long, idx long")
    assert rows(boundary.face_change(faces, cuts, "video", weighted=False)) == [(1, 0, 1.0, True), (1, 9, 0.0, False)]
    assert rows(boundary.face_change(faces, cuts, "video")) == [(1, 0, 0.0, False), (1, 9, 0.0, False)]


def test_metrics(spark):
    truth = spark.createDataFrame([(1, "a", 0.0, 5.0), (2, "a", 0.0, 5.0), (3, "b", 0.0, 1.0)], "query_id long, video string, s double, e double")
    found = spark.createDataFrame([(1, "a", 5.0, 5.0, 1), (2, "a", 5.0, 9.0, 1), (2, "a", 4.0, 6.0, 10), (3, "x", 0.0, 1.0, 1)], "query_id long, video string, s double, e double, rank int")
    m = evaluate.summary(evaluate.first_hits(found, truth)).first()
    assert m["mrr"] == pytest.approx((1 + 0.1 + 0) / 3) and m["hit_at_1"] == pytest.approx(1 / 3) and m["hit_at_10"] == pytest.approx(2 / 3)
    js = spark.createDataFrame([(1, 1, '[["v1", 20], 0.5]'), (1, 2, "oops"), (1, 3, '[[["v2", 5], [1, 2, 0]], [["v2", 9], [1, 2, 0]]]')], "query_id long, rank int, result string")
    assert rows(evaluate.results_from_json(js)) == [(1, 1, "v1", 20, 20), (1, 3, "v2", 5, 9)]


def test_shots_and_stages(spark):
    raw = spark.createDataFrame([("v", 4.0, 2.0), ("v", 0.0, 4.0)], "video string, start double, end_time double")
    assert rows(shots.normalise(raw, "video").select("video", "shot_id", "s", "e", "duration")) == [("v", 0, 0.0, 4.0, 4.0), ("v", 1, 4.0, 2.0, 0.0)]
    st = spark.createDataFrame([(1, 0, " a ", "", None), (1, 1, "a", None, None), (1, 2, " ", "", ""), (1, 3, "b", "", None)], "query_id long, stage long, visual string, ocr string, subtitle string")
    assert rows(shots.clean_stages(st).select("stage", "visual")) == [(0, "a"), (1, "b")]
    boxes = spark.createDataFrame([(1, 1, 10.0, y, 20.0, y + 5, 0.0, "hello there", 0.9) for y in (80.0, 85.0, 90.0)] + [(1, 1, 10.0, 80.0, 20.0, 85.0, 0.0, "日本語", 0.4)], "video long, frame long, x1 double, y1 double, x2 double, y2 double, angle double, text string, score double")
    assert [r["route"] for r in shots.route_boxes(boxes, (0, 70, 100, 100)).orderBy("text", "y1").collect()] == ["subtitle", "subtitle", "scene", None]
    t = spark.range(1).select(shots.frame_times(F.lit(0), F.lit(49), F.lit(25.0), F.lit(40)).alias("t"), shots.resample(F.array(*map(F.lit, range(5))), 3).alias("r")).first()
    assert (t["t"]["s"], t["t"]["e"]) == (0.0, 1.6) and t["r"] == [0, 2, 4]


def test_text(spark):
    one = spark.createDataFrame([("Đường về!  nhà",)], "t string")
    r = one.select(tx.fold(F.col("t")).alias("f"), tx.match_form(F.col("t")).alias("m"), tx.tokenize(F.col("t")).alias("k"), tx.timecode(F.lit(3661.0006)).alias("c"), tx.timecode(F.lit(3661.9996), ",").alias("d"), tx.safe_id(F.lit("__é__")).alias("s"), tx.json_payload(F.lit('<think>x{</think>```json {"a":1} ``` ')).alias("j"), tx.quality(F.lit("Xin chào")).alias("q")).first()
    assert r["f"] == "Duong ve!  nha" and r["m"] == "đường về nhà" and r["k"] == ["đường", "về", "nhà"]
    assert (r["c"], r["d"], r["s"], r["j"]) == ("01:01:01.001", "01:01:01,999", "empty_id", '{"a":1}')
    assert r["q"] == pytest.approx(1.5 + 4 + 0.4)


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / "in" / f"{name}.json").write_text('{"items": [{"text": "x"}], "embeddings": [[1.0]]}')
    schema = "items array<struct<text:string>>, embeddings array<array<float>>"
    got = tables.read_items(spark, f"{tmp_path}/in", schema, ["a"])
    assert rows(tables.text_items(got).select("video_id", "ord", "item.text")) == [("a", 0, "x")]
    with pytest.raises(Exception, match="no file for z"):
        tables.read_items(spark, f"{tmp_path}/in", schema, ["z"]).collect()
    body = spark.createDataFrame([("v", '[{"frame_id": 3, "text": "t"}, {"frame_index": 4, "text": " "}, {"frame_id": -1, "text": "q"}]'), ("w", '{"7": "u"}')], "video_id string, body string")
    assert rows(tables.ocr_items(body)) == [("v", 3, "t"), ("w", 7, "u")]
    assert rows(tables.write_store({"x": got.select("video_id")}, f"{tmp_path}/out")) == [("x", 1)]
    done = spark.createDataFrame([("a",)], "video_id string")
    assert rows(tables.pending(spark.createDataFrame([("a",), ("b",)], "video_id string"), done)) == [("b",)]
    assert rows(tables.run_summary(spark.createDataFrame([("done",), ("done",)], "status string"))) == [("done", 2), ("failed", 0), ("skipped", 0)]


def test_streaming(spark, tmp_path):
    from quern.streaming import sessions

    frames = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [1.0, 0.01]), (1, 2, [0.0, 1.0])], "video long, idx long, emb array<double>")
    frames.coalesce(1).write.parquet(f"{tmp_path}/f")
    stream = spark.readStream.schema(frames.schema).parquet(f"{tmp_path}/f")
    q = sessions.stream_keyframes(stream, "video").writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("kept")) == [(1, 0), (1, 2)]
    at = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 02:00:00")], "video long, t string").select("video", F.to_timestamp("t").alias("t"))
    assert sorted(r["n"] for r in sessions.stream_sessions(at, "video", "t", "10 minutes", "1 hour").collect()) == [1, 2]


def test_bm25_cuts_ties_by_id(spark):
    docs = spark.createDataFrame([(i, "a " + "z " * (40 - i)) for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "a")], "query_id long, text string")
    found = search.bm25(docs, q, 10, b=1e-12)  # scores differ beyond nine places alone, as by the order of sums
    assert [r["doc_id"] for r in found.orderBy("rank").collect()] == list(range(10))


@pytest.mark.parametrize("small", [False, True])
def test_bm25_against_the_formula(spark, monkeypatch, small):
    if small:  # many blocks of queries, items and pairs
        for name, value in (("QUERIES", 2), ("ITEMS", 3), ("PAIRS", 2)):
            monkeypatch.setattr(search, name, value)
    texts = ["red fox red", "", None, "blue fox", "red red red red", "fox", "blue", "red fox red", "green é", "fox blue red green"]
    asked = {0: "red fox", 1: "red red", 2: "", 3: "unseen", 4: "É blue blue", 5: None, 6: "fox green red blue"}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    queries = spark.createDataFrame(list(asked.items()), "query_id long, text string")
    words = [t.split() if t is not None else None for t in texts]
    mean = np.mean([len(w) for w in words if w is not None])
    want = set()
    for q, text in asked.items():
        scores = {}
        for d, w in enumerate(words):
            for t in (text or "").lower().split():
                if w and t in w:
                    df = sum(t in (x or ()) for x in words)
                    scores[d] = scores.get(d, 0) + math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean))
        best = sorted(scores, key=lambda d: (-round(scores[d], 9), d))[:4]
        want |= {(q, d, round(scores[d], 6), i + 1) for i, d in enumerate(best)}
    found = search.bm25(docs, queries, 4)
    assert {(r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in found.collect()} == want
    assert search.bm25(docs.limit(0), queries, 4).count() == search.bm25(docs, queries.limit(0), 4).count() == 0
