"""Retrieval metrics: Hit@K and mean reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT = (1, 5, 10, 20, 50, 100)


def first_hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    """results (query_id, video, s, e, rank), truth (query_id, video, s, e) -> query_id, first: the rank of the first result
    that is a point in the truth's interval or overlaps it, null if none. Queries are paired by id."""
    t = truth.select("query_id", "video", F.col("s").alias("ts"), F.col("e").alias("te"))
    point = (F.col("s") == F.col("e")) & F.col("s").between(F.col("ts"), F.col("te"))
    over = F.least("e", "te") - F.greatest("s", "ts") > 0
    hits = results.join(t, ["query_id", "video"]).where(point | over).groupBy("query_id").agg(F.min("rank").alias("first"))
    return truth.select("query_id").distinct().join(hits, "query_id", "left")


def summary(first: DataFrame, at: tuple[int, ...] = AT) -> DataFrame:
    """first (query_id, first) -> queries, mrr, hit_at_k for each k."""
    hit = [F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in at]
    return first.agg(F.count("*").alias("queries"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), *hit)


def results_from_json(rows: DataFrame, column: str = "result") -> DataFrame:
    """rows (query_id, rank, result): a single [[video, frame], score], or a chain [[[video, frame], ...], ...] -> its other columns, video, lo, hi (frames).

    What can't be read is dropped; ranks keep their holes.
    """
    single = F.from_json(column, "array<string>")
    key = F.from_json(single[0], "array<string>")
    chain = F.transform(F.from_json(column, "array<array<string>>"), lambda x: F.from_json(x[0], "array<string>"))
    points = F.when(F.try_element_at(key, F.lit(2)).rlike(r"^\d+$"), F.array(key)).otherwise(chain)
    at = F.transform(points, lambda p: F.try_element_at(p, F.lit(2)).try_cast("long"))
    read = rows.where(~F.exists(at, lambda x: x.isNull()))  # one frame that can't be read spoils its chain
    return read.select(*(c for c in rows.columns if c != column), points[0][0].alias("video"), F.array_min(at).alias("lo"), F.array_max(at).alias("hi")).where("video is not null and lo is not null")


def ranks(results: DataFrame, truth: DataFrame) -> DataFrame:
    """results (query_id, video, s, e, rank), truth (query_id, video, s, e) -> query_id, video_rank, first: the ranks of the first result
    of the right video, and of the first that overlaps the truth; null if none.

    Results that can't be read (no video, start or end) go before ranks are counted anew.
    """
    from pyspark.sql import Window

    read = results.where("video is not null and s is not null and e is not null")
    read = read.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    met = read.join(truth.select("query_id", "video", F.col("s").alias("ts"), F.col("e").alias("te")), ["query_id", "video"])
    found = met.groupBy("query_id").agg(F.min("rank").alias("video_rank"), F.min(F.when(F.least("e", "te") > F.greatest("s", "ts"), F.col("rank"))).alias("first"))
    return truth.select("query_id").distinct().join(found, "query_id", "left")


def keyframe_ranks(rows: DataFrame, fps: DataFrame, truth: DataFrame) -> DataFrame:
    """rows (query_id, mode, rank, result: JSON as results_from_json() reads it), fps (video, fps), truth (query_id, video, s, e) -> query_id, video_rank, first.

    Ranks are those of the rows, whatever can't be read. A single keyframe (mode `single-stage`) hits if its time lies in
    the truth, ends included; a chain if its first to last frame overlap it. A keyframe of a video without a frame rate can
    only hit the video; such a chain counts for nothing.
    """
    t = truth.select("query_id", F.col("video").cast("string").alias("video"), F.col("s").alias("ts"), F.col("e").alias("te"))
    single = F.coalesce(F.col("mode"), F.lit("single-stage")) == "single-stage"
    read = results_from_json(rows.select("query_id", "rank", "result", single.alias("single"))).join(fps.select(F.col("video").cast("string").alias("video"), "fps"), "video", "left")
    met = read.where(F.col("single") | F.col("fps").isNotNull()).join(t, ["query_id", "video"])
    s, e = F.col("lo") / F.col("fps"), F.col("hi") / F.col("fps")
    hit = F.when(F.col("single"), s.between(F.col("ts"), F.col("te"))).otherwise(F.least(e, "te") > F.greatest(s, "ts"))
    found = met.groupBy("query_id").agg(F.min("rank").alias("video_rank"), F.min(F.when(hit, F.col("rank"))).alias("first"))
    return truth.select("query_id").distinct().join(found, "query_id", "left")


def fps_map(rows: DataFrame, column: str = "body") -> DataFrame:
    """rows of JSON, a map video -> fps or {"results": [{"video_id", "fps"}]} -> video, fps. What is neither raises."""
    listed = F.from_json(column, "struct<results:array<struct<video_id:string,fps:double>>>")["results"]
    mapped = F.map_entries(F.from_json(column, "map<string,double>"))
    pairs = F.when(listed.isNotNull(), F.transform(listed, lambda x: F.struct(x["video_id"].alias("key"), x["fps"].alias("value")))).otherwise(mapped)
    known = F.when(pairs.isNotNull(), pairs).otherwise(F.raise_error(F.lit("not a map of frame rates")).cast("array<struct<key:string,value:double>>"))
    return rows.select(F.explode(known).alias("p")).select(F.col("p.key").alias("video"), F.col("p.value").alias("fps"))
