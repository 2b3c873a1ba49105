"""Ordered streams give the batch operators' results, however the rows are cut into batches."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import folds, intervals
from quern.streaming import ordered


def streamed(spark, tmp, df, batches, plan):
    """Rows of the plan over a stream of the batches (lists of rows), and of a last row that moves the watermark on."""
    for name, value in ordered.STORE.items():
        spark.conf.set(name, value)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, df.schema).coalesce(1).write.mode("append").parquet(f"{tmp}/in/b{i:03}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp}/in/*")
    query = plan(source).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", f"{tmp}/c").trigger(availableNow=True).start()
    query.awaitTermination(150)
    assert query.exception() is None
    return sorted(map(tuple, spark.table("told").where("video >= 0").collect()))


def cut(rows, seed, parts):
    """Neighbours change places, less than the watermark's delay apart; then batches."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: r[1] + rng.random() * 8)
    at = sorted(rng.sample(range(1, len(rows)), parts - 1))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)], strict=True)]


@pytest.mark.parametrize(("seed", "parts"), [(1, 2), (2, 4)])
def test_sessions(spark, tmp_path, seed, parts):
    rng = random.Random(5)
    rows = [(v, f, float(rng.randint(1, 9))) for v in (1, 2) for f in rng.sample(range(100), 35)]
    rows += [(1, rows[0][1], 2.0), (2, rows[40][1], 1.0)]  # more than one row at a place
    df = spark.createDataFrame(rows, "video long, frame long, score double")
    merged = intervals.gap_sessions(intervals.merge_equal(df, "video", "frame", ["score"]), "video", "frame", 2)
    want = merged.groupBy("video", "session").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("places"), F.sum("score").alias("score"))
    batches = [*cut(rows, seed, parts), [(-1, 10_000, 0.0)], [(1, 3, 99.0), (-1, 10_001, 0.0)], [(-1, 20_000, 0.0)]]  # 3 is late by then: dropped
    got = streamed(spark, tmp_path, df, batches, lambda s: ordered.stream_equal_sessions(s.withColumn("t", F.timestamp_seconds(F.col("frame") + 1)), "video", "t", "10 seconds", "frame", "score", 2, 2000))
    assert got == sorted(map(tuple, want.select("video", "first", "last", "places", "score").collect()))


@pytest.mark.parametrize(("seed", "parts"), [(1, 3)])
def test_clusters(spark, tmp_path, seed, parts):
    rng = random.Random(6)
    rows = []
    for v in (1, 2):
        for f in range(25):
            x = [rng.gauss(0, 1) for _ in range(4)]
            size = sum(c * c for c in x) ** 0.5
            rows.append((v, f, [c / size for c in x]))
    df = spark.createDataFrame(rows, "video long, idx long, emb array<double>")
    want = folds.leader_clusters(df, "video")
    batches = [*cut(rows, seed, parts), [(-1, 10_000, [1.0] * 4)], [(-1, 20_000, [1.0] * 4)]]
    got = streamed(spark, tmp_path, df, batches, lambda s: ordered.stream_leader_clusters(s.withColumn("t", F.timestamp_seconds(F.col("idx") + 1)), "video", "t", "10 seconds"))
    assert got == sorted(map(tuple, want.select("video", "idx", "cluster").collect()))


@pytest.mark.parametrize(("seed", "parts"), [(3, 3)])
def test_runs(spark, tmp_path, seed, parts):
    rng = random.Random(7)
    texts = ["Xin chào", "Xin chao", "Xin chào bạn", "khác hẳn", "khac han", "", "hello there"]
    rows = [(v, f, rng.choice(texts[:3] if f % 20 < 12 else texts)) for v in (1, 2) for f in sorted(rng.sample(range(90), 30))]
    df = spark.createDataFrame(rows, "video long, frame long, text string")
    want = folds.merge_runs(df, "video", gap=4)
    batches = [*cut(rows, seed, parts), [(-1, 10_000, "z")], [(-1, 20_000, "z")]]
    got = streamed(spark, tmp_path, df, batches, lambda s: ordered.stream_merge_runs(s.withColumn("t", F.timestamp_seconds(F.col("frame") + 1)), "video", "t", "10 seconds", 4000, gap=4))
    assert got == sorted(map(tuple, want.select("video", "first", "last", "text").collect()))
