"""Shots that name their vectors by id: the same rows as from the vectors themselves, and little that is shuffled."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import boundary, folds, intervals, timeline
from quern.plans import flagship

WEIGHTS = {"visual": 0.3, "subtitle": 0.4, "face": 0.3}


@pytest.fixture(scope="module")
def scene(spark):
    """Shots with gaps and equal starts, subtitles before, between and over many of them, ids without a vector."""
    r = random.Random(4)
    vectors = [(i, [r.gauss(0, 1) for _ in range(5)] if i != 3 else None) for i in range(12)]
    shots, items = [], []
    for video in (1, 2, 3):
        t = 10.0
        for idx in range(40 if video < 3 else 1):
            e = t + r.choice([0.0, 1.0, 5.0, 20.0])
            shots.append((video, idx, t, e, r.choice([None, 50, *range(12)]), r.choice([None, 0, 1, 2])))
            t = e + r.choice([0.0, 0.0, 3.0])
        for sid in range(60 if video == 1 else 8):
            bs = r.uniform(-20.0, t)
            items.append((video, sid, bs, bs + r.choice([0.0, -1.0, 2.0, 15.0, 90.0]), r.choice([50, *range(12)])))
    items += [(2, 60, 40.0, None, 1), (2, 61, None, 20.0, 2), (3, 62, None, None, 4)]  # open ends
    make = spark.createDataFrame
    return make(shots, "video long, idx long, s double, e double, visual long, face long"), make(items, "video long, sid long, bs double, be double, id long"), make(vectors, "id long, emb array<double>")


def test_rows_by_id_equal_those_by_vector(scene):
    shots, items, vectors = scene
    items = items.where("bs is not null and be is not null")
    got = timeline.boundary_rows(shots, items, "video", timeline.Vectors(vectors, "id", "emb"), ["visual"], WEIGHTS)
    seen = shots.join(vectors.select(F.col("id").alias("visual"), F.col("emb").alias("v")), "visual", "left")
    counts = shots.where("face is not null").select("video", "idx", "face", F.lit(1).alias("n"))
    plain = shots.select("video", "idx", "s", "e")
    changes = {
        "visual": boundary.embedding_change(seen, "video", "v"),
        "subtitle": boundary.subtitle_change(plain, items.join(vectors, "id"), "video"),
        "face": boundary.face_change(counts, plain, "video"),
    }
    want = boundary.boundary_rows(plain, changes, intervals.bridge(plain, items, "video"), "video", WEIGHTS)
    names = ["video", "idx", *(f"{m}_{x}" for m in WEIGHTS for x in ("change", "valid", "norm")), "score", "penalty", "threshold", "is_candidate"]
    got, want = (sorted(map(tuple, x.select(names).collect())) for x in (got, want))
    assert len(got) == 78 and any(r[names.index("penalty")] for r in got) and len({r[names.index("subtitle_valid")] for r in got}) == 2
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b, abs=1e-9)


def test_events_by_id(scene):
    """Against the items that overlap each event, one by one."""
    shots, items, vectors = scene
    segments = shots.select("video", F.col("idx").alias("first"), (F.col("idx") + 3).alias("last")).where("first % 4 = 0").withColumn("event", (F.col("first") / 4).cast("long"))
    segments = segments.withColumn("end_score", F.when(F.col("event") > 0, F.col("event") / 2.0))
    got = {(r["video"], r["event"]): r for r in timeline.build_events(segments.repartition("video"), shots, items.repartition("video"), "video", ["visual"], ("end_score",)).collect()}
    assert len(got) == 21
    rows, heard = shots.collect(), items.fillna(-1e9, "bs").fillna(1e9, "be").collect()
    for (video, event), r in got.items():
        own = [x for x in rows if x["video"] == video and x["idx"] // 4 == event]
        s, e = min(x["s"] for x in own), max(x["e"] for x in own)
        assert (r["s"], r["e"], r["n_shots"], r["end_score"]) == (s, e, len(own), event / 2 if event else None)
        assert r["visual"] == [x["visual"] for x in sorted(own, key=lambda x: x["idx"]) if x["visual"] is not None]
        assert sorted(r["heard"]) == sorted(x["id"] for x in heard if x["video"] == video and min(e, x["be"]) - max(s, x["bs"]) > 0)
        faces = sorted(x["face"] for x in own if x["face"] is not None)
        assert r["face_counts"] == ({f: faces.count(f) for f in faces} or None)


def test_spans_of_units_at_one_time(spark):
    """Items over many units that take no time have rows for the others alone."""
    units = spark.range(900).select(F.lit(1).alias("video"), F.col("id").alias("idx"), (F.floor(F.col("id") / 300) * 10.0).alias("s"))
    units = units.withColumn("e", F.when(F.col("idx") % 300 == 299, F.col("s") + 10.0).otherwise(F.col("s")))
    items = spark.createDataFrame([(1, 10.0, 25.0), (1, 3.0, 20.0), (1, 35.0, 36.0)], "video int, bs double, be double")
    got = sorted((r["bs"], r["idx"], r["prev"], r["begins"]) for r in timeline.spanned(items, units, "video").collect())
    assert got == [(3.0, 299, None, True), (3.0, 599, 299, False), (3.0, 899, 599, False), (10.0, 599, 299, True), (10.0, 899, 599, False), (35.0, 899, 599, True)]


def test_pools_by_id(scene, spark):
    vectors = scene[2]
    df = spark.createDataFrame([(0, [1, 5, 5, 3]), (1, [3, 50]), (2, None), (3, []), (4, [7])], "g long, ids array<long>")
    got = {r["g"]: r["p"] for r in df.select("g", timeline.pools(timeline.Vectors(vectors, "id", "emb"), F.col("ids")).alias("p")).collect()}
    rows = df.select("g", F.explode("ids").alias("id")).join(vectors, "id", "left")
    for r in folds.multi_pools(rows, ["g"], ["emb"], 5).collect():
        assert [list(got[r["g"]][p]) if r["has_emb"] else None for p in ("mean", "max", "soft")] == ([pytest.approx(r[f"emb_{p}"]) for p in ("mean", "max", "soft")] if r["has_emb"] else [None] * 3)
    assert got[2]["mean"] is None and got[3]["soft"] is None and got[4]["max"] is not None
    with pytest.raises(ValueError):
        timeline.Vectors(vectors.union(vectors), "id", "emb")
    none = timeline.Vectors(vectors.where("false"), "id", "emb")
    assert all(r[0]["mean"] is None for r in df.select(timeline.pools(none, F.col("ids"))).collect())


def test_fold_over_a_union(spark):
    """Sides that are dealt by the group, one much smaller: a group's rows still meet (before, 500 groups came twice)."""
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        w = Window.partitionBy("g").orderBy("id")
        sides = [spark.range(n).select((F.col("id") % 500).alias("g"), "id").withColumn("x", F.lag("id").over(w)) for n in (3_000_000, 500)]
        got = folds.fold(sides[0].unionByName(sides[1]), ["g"], ["id"], ["id", "x"], lambda p: [(len(p["x"]),)], "n long")
        assert [tuple(r) for r in got.groupBy("n").count().collect()] == [(6001, 500)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_events_shuffle_little(spark):
    """Bytes in the exchanges of a whole run: 3900 an event before, when vectors travelled with every row."""
    def written() -> int:
        sc, seen = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
        stages = seen.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    sf = "/root/testdata/sf0.01"
    before, events = written(), spark.read.parquet(f"{sf}/events.parquet").count()
    flagship.four_modality_events(spark, sf).write.format("noop").mode("overwrite").save()
    assert 0 < written() - before < 400 * events
