"""Feature files, stores and loaders on written files."""

import json
import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import pooling, search
from quern.sources import features, stores, tables


class Evil:
    def __reduce__(self):
        return print, ("run",)


def dump(path, payload):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(pickle.dumps(payload))


@pytest.fixture
def videos(tmp_path):
    for v in ("2", "10"):
        dump(tmp_path / f"visual_embeddings/{v}.pkl", {"shots": [{"shot_id": 0, "embedding": np.array([3.0, 4.0], np.float32)}, {"shot_id": 1, "keyframe_embeddings": np.array([[2.0, 0.0], [0.0, 0.0]])}, {"shot_id": 2, "keyframe_embeddings": []}]})
        dump(tmp_path / f"action_features/{v}.pkl", {"shots": [{"shot_id": np.int64(1), "action_feature": [0.0, 5.0], "pooling": "mean"}]})
        dump(tmp_path / f"subtitle_embeddings/{v}.pkl", {"items": [{"start_time_sec": 1, "end_time_sec": 2.5, "text": "hi"}], "embeddings": np.ones((1, 2))})
        face = tmp_path / f"face_detection/{v}/shots_with_faces.json"
        face.parent.mkdir(parents=True)
        face.write_text(json.dumps([{"shot_id": 0, "face_ids": [2, 1], "face_id_counts": {"1": 4}, "face_detections": [{"a": 1}, {"a": 2}]}, {"shot_id": 1}]))
    return tmp_path


def test_video_features(spark, videos):
    f = features.video_features(spark, str(videos), ["2"])
    got = {r["shot_id"]: r["emb"] for r in f["visual"].collect()}
    assert got[0] == pytest.approx([0.6, 0.8]) and got[1] == pytest.approx([1.0, 0.0]) and got[2] is None
    assert [tuple(r) for r in f["action"].collect()] == [("2", 1, [pytest.approx(0.0), pytest.approx(1.0)], 1, "mean")]
    assert [tuple(r) for r in f["subtitle"].collect()] == [("2", 0, 1.0, 2.5, "hi", [1.0, 1.0])]
    assert sorted(tuple(r) for r in f["face"].collect()) == [("2", 0, [2, 1], {"1": 4}, 2), ("2", 1, [], {}, 0)]
    assert {r["video_id"] for r in features.video_features(spark, str(videos))["face"].collect()} == {"2", "10"}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        features.video_features(spark, str(videos), ["2", "3"])["visual"].collect()


def test_slices_of_files(spark, videos):
    names = lambda *a: sorted(r["video_id"] for r in features.read_files(spark, f"{videos}/visual_embeddings", "pkl", None, *a).collect())
    assert names() == ["10", "2"] and names(0, 0) == ["2"] and names(1) == ["10"] and names(5, 9) == []
    for v in ("b", "a", "c"):
        (videos / f"{v}.mp4").write_bytes(b"x" * 3)
    media = lambda *a, **k: sorted(r["video_id"] for r in tables.read_media(spark, str(videos), *a, **k).collect())
    assert media() == ["a", "b", "c"] and media(1, 2) == ["b", "c"] and media(ids=["c"]) == ["c"]


def test_item_vectors_in_order_of_numbers(spark, tmp_path):
    dump(tmp_path / "10.pkl", {"events": [{"event_id": 0, "embedding": [1.0]}]})
    dump(tmp_path / "9.pkl", {"video_id": "nine", "events": [{"event_id": 1, "embedding": np.array([2.0])}, {"event_id": 0, "embedding": np.array([3.0])}], "other": {1, 2}})
    got = [tuple(r) for r in features.item_vectors(spark, str(tmp_path), "events").orderBy("index_id").collect()]
    assert got == [(0, "nine:1", "nine", [2.0]), (1, "nine:0", "nine", [3.0]), (2, "10:0", "10", [1.0])]


def test_pickles_run_nothing(spark, tmp_path):
    dump(tmp_path / "1.pkl", {"events": [{"event_id": 0, "embedding": Evil()}]})
    with pytest.raises(Exception, match="isn't allowed"):
        features.item_vectors(spark, str(tmp_path), "events").collect()


def test_texts_and_vectors_of_unequal_number(spark, tmp_path):
    dump(tmp_path / "1.pkl", {"captions": [{"caption": "a"}], "embeddings": np.ones((2, 2))})
    with pytest.raises(Exception, match="1 items and 2 vectors"):
        features.text_features(features.read_files(spark, str(tmp_path))).collect()


def test_subtitle_texts(spark, tmp_path):
    (tmp_path / "v1.json").write_text(json.dumps([{"frame_start": 5, "frame_end": 9, "text": "  Hello \n World"}, {"frame_start": 6, "frame_end": 7, "text": " "}, {"frame_start": 8, "frame_end": 9}]))
    (tmp_path / "v2.json").write_text("{}")
    got = [tuple(r) for r in features.subtitle_texts(spark, str(tmp_path), "s").collect()]
    assert got == [("s_v1_5", "v1", 5, 9, "hello world")]


@pytest.fixture
def bundle(spark):
    events = spark.createDataFrame([("v", 0, 0.0, 10.0, [0, 1]), ("v", 1, 10.0, 20.0, [2])], "video string, event long, s double, e double, shots array<long>")
    shots = spark.createDataFrame([("v", 0, 0.0, 5.0), ("v", 1, 5.0, 10.0), ("v", 2, 10.0, 20.0)], "video string, shot long, s double, e double")
    subs = spark.createDataFrame([("v", 4.0, 6.0, "a"), ("v", 9.0, 13.0, "b"), ("v", 30.0, 31.0, "c")], "video string, s double, e double, text string")
    ocr = spark.createDataFrame([("o1", "v", "v:2")], "ocr_id string, video string, shot_id string")
    return stores.build_mappings(tables.load_metadata(events, shots, subs), ocr)


def test_store_round_trip_and_search(spark, bundle, tmp_path):
    path = str(tmp_path / "store")
    first = stores.save_store(bundle, path)
    got = stores.load_store(spark, path)
    for name, df in bundle.items():
        assert sorted(map(tuple, got[name].collect()), key=str) == sorted(map(tuple, df.collect()), key=str), name
    assert sorted(map(tuple, got["subtitle_shots"].collect())) == [("v:0", "v:0", 0.5), ("v:0", "v:1", 0.5), ("v:1", "v:1", 0.25), ("v:1", "v:2", 0.75)]
    assert [tuple(r) for r in got["ocr"].collect()] == [("o1", "v:2", "v:1", "v")]
    second = stores.save_store({**bundle, "ocr": bundle["ocr"].limit(0)}, path)
    assert stores.load_store(spark, path)["ocr"].count() == 0 and stores.load_store(spark, path, first)["ocr"].count() == 1 and first != second
    # pooling search from the store
    store = stores.load_store(spark, path, first)
    hits = spark.createDataFrame([(1, "event", "v:0", 2), (1, "subtitle", "v:1", 1), (1, "ocr", "o1", 1)], "query_id long, channel string, item_id string, rank int")
    shape = store["shots"].select("shot_id", "event_id", F.col("video").alias("video_id"))
    vectors = spark.createDataFrame([(f"v:{i}", [float(i), 1.0]) for i in range(3)], "item_id string, emb array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, emb array<double>")
    found = pooling.pooled_search(hits, stores.search_edges(store, "event_id"), stores.search_edges(store, "shot_id"), shape, vectors, queries)
    r = {x["event_id"]: (x["rank"], x["top_shots"][0]) for x in found.collect()}
    assert r == {"v:1": (1, "v:2"), "v:0": (2, "v:1")}


def test_dangling_edges_leave_the_manifest(spark, bundle, tmp_path):
    path = str(tmp_path / "store")
    first = stores.save_store(bundle, path)
    lost = bundle["ocr"].withColumn("shot_id", F.lit("v:99"))
    with pytest.raises(ValueError, match="ocr.shot_id leads to rows that shots hasn't got"):
        stores.save_store({**bundle, "ocr": lost}, path)
    assert {r["version"] for r in spark.read.json(f"{path}/manifest").collect()} == {first}
    spark.createDataFrame([("x", 9, "shots", 77)], stores.MANIFEST).write.mode("append").json(f"{path}/manifest")
    bundle["shots"].write.parquet(f"{path}/x/shots")
    with pytest.raises(ValueError, match="77 rows"):
        stores.load_store(spark, path)
    with pytest.raises(ValueError, match="no version"):
        stores.load_store(spark, path, "nothing")


def test_vectors_are_checked(spark, tmp_path):
    schema = "item_id long, emb array<double>"
    good = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], schema)
    assert stores.validated(good) is good
    for bad in ([(1, [1.0]), (2, [1.0, 2.0])], [(1, [1.0]), (1, [2.0])], [(1, [float("nan")])], [(1, None)]):
        with pytest.raises(ValueError, match="vectors"):
            stores.validated(spark.createDataFrame(bad, schema))
    tables.vector_store(good, f"{tmp_path}/v")
    assert sorted(r["item_id"] for r in tables.load_vectors(spark, f"{tmp_path}/v").collect()) == [1, 2]
    good.limit(1).write.mode("append").parquet(f"{tmp_path}/v/vectors")
    with pytest.raises(ValueError, match="2 vectors"):
        tables.load_vectors(spark, f"{tmp_path}/v")


def test_bm25_from_a_store(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["red fox", "red red dog", "blue", None, "fox"])], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "red fox fox"), (2, "nothing")], "query_id long, text string")
    search.bm25_index(docs, f"{tmp_path}/b")
    key = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert key(search.bm25_stored(f"{tmp_path}/b", asked, 3)) == key(search.bm25(docs, asked, 3)) != []


def test_translations(spark):
    items = spark.createDataFrame([(1, " a ", None), (2, "b", "B"), (3, "c", " "), (4, "", None), (5, None, None), (6, "d", None)], "id long, caption string, translated string")
    cache = spark.createDataFrame([("a", "A"), ("a ", "AA"), ("c", "C"), ("d", " "), ("", "never")], "caption string, translated string")
    out, pending = tables.with_translations(items, cache)
    assert sorted((r["id"], r["translated"], r["cached"]) for r in out.collect()) == [(1, "A", True), (2, "B", False), (3, "C", True), (4, None, False), (5, None, False), (6, None, False)]
    assert [r[0] for r in pending.collect()] == ["d"]


def test_query_lists_and_debug_rows(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"query": "a", "video_id": "v", "start_time_sec": 1, "end_time_sec": 2}, {"query_id": 7, "query": "b"}, {"query": "c"}]))
    assert [(r["query_id"], r["query"]) for r in tables.load_queries(spark, str(path), 1).collect()] == [(7, "b"), (2, "c")]
    rows = spark.createDataFrame([("v", i, float(i), i + 1.0) for i in range(4)], "video string, idx long, s double, e double")
    texts = spark.createDataFrame([("v", 0, "zero"), ("v", 1, " "), ("v", 2, "two"), ("v", 3, "three")], "video string, idx long, text string")
    got = {r["idx"]: (r["left_text"], r["right_text"], r["left_items"], r["right_items"]) for r in tables.debug_boundaries(rows, texts, "video", 2, 6).collect()}
    assert got == {0: ("zero", "two", 1, 1), 1: ("zero", "two th", 1, 2), 2: ("two", "three", 1, 1), 3: ("two th", "", 2, 0)}
