"""Interval, as-of and nearest joins within a key.

Overlap joins bin time, so a long video is spread over tasks and the join
stays an equi-join; as-of joins are one window over both sides, sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(start, end) / width)))


def overlap_join(a: DataFrame, b: DataFrame, key: str, width: float = 64.0, closed: bool = False) -> DataFrame:
    """a (key, s, e, ...) x b (key, bs, be, ...): pairs with a positive overlap, or that touch if closed; with `overlap`.

    Both sides are dealt to bins; a pair counts in the bin where the later of its starts lies.
    """
    left = a.withColumn("_bin", _bins(F.col("s"), F.col("e"), width))
    right = b.withColumn("_bin", _bins(F.col("bs"), F.col("be"), width))
    overlap = F.least("e", "be") - F.greatest("s", "bs")
    met = left.join(right, [key, "_bin"]).where(F.col("_bin") == F.floor(F.greatest("s", "bs") / width)).withColumn("overlap", overlap)
    return met.where("overlap >= 0" if closed else "overlap > 0").drop("_bin")


def edge_weights(subtitles: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Share of a subtitle (bs, be) that a target (s, e) covers, where it is positive."""
    met = overlap_join(targets, subtitles, key)
    return met.withColumn("weight", F.col("overlap") / F.greatest(F.col("be") - F.col("bs"), F.lit(1e-6)))


def bridge(shots: DataFrame, subtitles: DataFrame, key: str, cap: float = 0.5, most: float = 0.40) -> DataFrame:
    """For each cut between shots: items that overlap both sides, their summed smaller overlap, penalty."""
    w = Window.partitionBy(key).orderBy("idx")
    cuts = shots.select("*", F.lead("s").over(w).alias("s2"), F.lead("e").over(w).alias("e2")).where("s2 is not null")
    around = cuts.select(key, "idx", F.col("s"), F.col("e2").alias("e"), F.col("e").alias("e1"), "s2")
    met = overlap_join(around, subtitles, key)
    both = met.withColumn("l", F.least("e1", "be") - F.greatest("s", "bs")).withColumn("r", F.least("e", "be") - F.greatest("s2", "bs")).where("l > 0 and r > 0")
    found = both.groupBy(key, "idx").agg(F.count("*").alias("items"), F.sum(F.least("l", "r")).alias("total"))
    out = cuts.select(key, "idx").join(found, [key, "idx"], "left").fillna({"items": 0, "total": 0.0})
    return out.withColumn("penalty", most * F.least(F.lit(1.0), F.col("total") / cap))


def _as_of(points: DataFrame, marks: DataFrame, key: str, t: str, at: str, value: str, later: bool = False) -> DataFrame:
    """points with `value` of the last mark at or before t (or the first at or after it), null if none."""
    columns = points.columns
    a = points.select(*columns, F.col(t).alias("_t"), F.lit(1).alias("_p"), F.lit(None).cast(dict(marks.dtypes)[value]).alias("_v"))
    b = marks.select(key, F.col(at).cast("double").alias("_t"), F.lit(0).alias("_p"), F.col(value).alias("_v"))
    both = b.unionByName(a, allowMissingColumns=True)
    order = [F.desc("_t"), F.asc("_p")] if later else [F.asc("_t"), F.asc("_p")]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_p = 1").select(*columns, "_found")


def point_in_interval(points: DataFrame, shots: DataFrame, key: str) -> DataFrame:
    """points (key, id, t) -> id, idx: the shot with s <= t < e, else the first that ends within 1e-6 of t, else the last one.

    Shots of a key don't overlap.
    """
    value = shots.select(key, "s", F.struct("s", "e", "idx").alias("shot"))
    near = _as_of(points, value, key, "t", "s", "shot").withColumnRenamed("_found", "at")
    last = shots.groupBy(key).agg(F.max_by("idx", "idx").alias("last"))
    ends = (F.col("t") < F.col("at.e")) | (F.abs(F.col("at.e") - F.col("t")) < 1e-6)
    return near.join(last, key).select(key, "id", F.when(ends, F.col("at.idx")).otherwise(F.col("last")).alias("idx"))


def nearest(points: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """points (key, id, t), marks (key, m) -> id, m: the nearest mark; ties go to the later one."""
    low = _as_of(points, marks, key, "t", "m", "m").withColumnRenamed("_found", "low")
    both = _as_of(low, marks, key, "t", "m", "m", later=True).withColumnRenamed("_found", "high")
    pick = F.when(F.col("low").isNull() | (F.col("high") - F.col("t") <= F.col("t") - F.col("low")), F.col("high")).otherwise(F.col("low"))
    return both.select(key, "id", F.coalesce(pick, "low", "high").alias("m"))


def gap_sessions(df: DataFrame, key: str, order: str, gap: float) -> DataFrame:
    """Numbers the runs of rows whose order column steps by at most gap."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.col(order) - F.lag(order).over(w) > gap, 1).otherwise(0)
    return df.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def window_best(df: DataFrame, group: list[str], order: str, score: str, width: int) -> DataFrame:
    """The best positive score within `width` of each row, and its order; the first wins ties."""
    w = Window.partitionBy(*group).orderBy(order).rangeBetween(-width, width)
    best = F.max(F.when(F.col(score) > 0, F.struct(F.col(score).alias("score"), (-F.col(order)).alias("o")))).over(w)
    return df.withColumn("_b", best).withColumn("best_score", F.coalesce("_b.score", F.lit(0.0))).withColumn("best_order", -F.col("_b.o")).drop("_b")


def keyframes_in_range(ranges: DataFrame, marks: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """ranges (key, id, first, last), marks (key, m) -> key, id, m: the marks in first..last, ends included. Ranges are dealt to bins, so the join is an equi-join."""
    binned = ranges.select(key, "id", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor(F.col("last") / width))).alias("_bin"))
    return binned.join(marks.select(key, "m", F.floor(F.col("m") / width).alias("_bin")), [key, "_bin"]).where("m between first and last").select(key, "id", "m")


def expand_hits(hits: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """hits (key, id, first, last) -> key, id, m: the keyframes in the range, else the one nearest to its middle, the later of two. An id is one of its key.

    Bounds the wrong way round are swapped; hits without a bound, or with -1, go.
    """
    live = hits.where("first is not null and last is not null and first <> -1 and last <> -1")
    live = live.select(key, "id", F.least("first", "last").alias("first"), F.greatest("first", "last").alias("last"))
    inside = keyframes_in_range(live, marks, key)
    rest = live.join(inside.select(key, "id").distinct(), [key, "id"], "left_anti").select(key, "id", ((F.col("first") + F.col("last")) / 2).alias("t"))
    low = _as_of(rest, marks, key, "t", "m", "m").withColumnRenamed("_found", "low")
    both = _as_of(low, marks, key, "t", "m", "m", later=True).withColumnRenamed("_found", "high")
    later = F.col("low").isNull() | (F.col("high") - F.col("t") <= F.col("t") - F.col("low"))
    near = both.select(key, "id", F.when(later, F.col("high")).otherwise(F.col("low")).alias("m"), "low")
    return inside.unionByName(near.select(key, "id", F.coalesce("m", "low").alias("m")).where("m is not null"))


def merge_equal(df: DataFrame, key: str, order: str, scores: list[str]) -> DataFrame:
    """Rows at one place of a key become one, with their scores added."""
    return df.groupBy(key, order).agg(*(F.sum(c).alias(c) for c in scores))


def subtitle_features(shots: DataFrame, subtitles: DataFrame, key: str) -> DataFrame:
    """Each shot's subtitles: key, idx, emb (the unit mean of their vectors by overlap; null if there is none), text (in order, repeats once)."""
    from quern.functions.vectors import weighted_mean

    met = overlap_join(shots.select(key, "idx", "s", "e"), subtitles.select(key, "bs", "be", "emb", "text"), key)
    items = F.array_sort(F.collect_list(F.struct("bs", "be", F.col("overlap").alias("w"), F.transform("emb", lambda x: x.cast("double")).alias("v"), "text")))
    found = met.groupBy(key, "idx").agg(items.alias("_i"))
    texts = F.array_distinct(F.filter(F.transform("_i", lambda i: F.trim(i["text"])), lambda t: t != ""))
    felt = found.select(key, "idx", weighted_mean(F.filter("_i", lambda i: i["v"].isNotNull())).alias("emb"), F.array_join(texts, " ").alias("text"))
    return shots.select(key, "idx").join(felt, [key, "idx"], "left").select(key, "idx", "emb", F.coalesce("text", F.lit("")).alias("text"))


def clamp_end(start: Column, end: Column) -> Column:
    """An end that lies before its start becomes the start."""
    return F.greatest(start, end)
