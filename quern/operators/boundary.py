"""Change between neighbouring contexts, fused to boundary scores and candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as vx
from quern.operators.intervals import overlap_join


def embedding_change(shots: DataFrame, key: str, vector: str, width: int = 3) -> DataFrame:
    """1 - cosine of the mean contexts on either side of each cut -> key, idx, change, valid. Null vectors don't count.

    The window gathers whole vectors, at most 2 * width of them, so rows aren't multiplied by components.
    """
    w = Window.partitionBy(key).orderBy("idx")
    v = F.transform(vector, lambda x: x.cast("double"))
    near = lambda a, b: F.collect_list(v).over(w.rowsBetween(a, b))
    both = shots.select(key, "idx", near(1 - width, 0).alias("l"), near(1, width).alias("r"), F.lead("idx").over(w).alias("next")).where("next is not null")
    mean = lambda c: F.aggregate(F.slice(c, 2, 2 * width), F.element_at(c, 1), lambda s, x: F.zip_with(s, x, lambda a, b: a + b), lambda s: F.transform(s, lambda x: x / F.size(c)))
    ok = (F.size("l") > 0) & (F.size("r") > 0)
    both = both.select(key, "idx", ok.alias("valid"), F.when(ok, mean(F.col("l"))).alias("l"), F.when(ok, mean(F.col("r"))).alias("r"))
    cosine = vx.dot(F.col("l"), F.col("r")) / ((vx.norm(F.col("l")) + 1e-8) * (vx.norm(F.col("r")) + 1e-8))
    return both.select(key, "idx", F.when(F.col("valid"), 1 - cosine).otherwise(0.0).alias("change"), "valid")


def subtitle_change(shots: DataFrame, subtitles: DataFrame, key: str, width: int = 3, tau: float = 2.0) -> DataFrame:
    """1 - cosine of the subtitles on either side of each cut -> key, idx, change, valid.

    shots (key, idx, s, e), subtitles (key, bs, be, emb). A subtitle counts by its overlap with the side's range of `width`
    shots, and exp(-distance / tau) of its end (left) or start (right) from the cut.
    """
    w = Window.partitionBy(key).orderBy("idx")
    left, right = w.rowsBetween(1 - width, 0), w.rowsBetween(1, width)
    cuts = shots.select(key, "idx", F.col("e").alias("cut"), F.first("s").over(left).alias("ls"), F.first("s").over(right).alias("rs"), F.last("e").over(right).alias("re")).where("rs is not null")
    sides = cuts.select(key, "idx", "cut", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("ls").alias("s"), F.col("cut").alias("e")), F.struct(F.lit("r").alias("side"), F.col("rs").alias("s"), F.col("re").alias("e")))).alias("x"))
    met = overlap_join(sides.select(key, "idx", "cut", "x.side", "x.s", "x.e"), subtitles.where("emb is not null").select(key, "bs", "be", "emb"), key)
    away = F.when(F.col("side") == "l", F.col("cut") - F.least("be", "cut")).otherwise(F.greatest("bs", "cut") - F.col("cut"))
    weighed = met.withColumn("w", F.col("overlap") * F.exp(-F.greatest(away, F.lit(0.0)) / tau)).where("w > 0")
    items = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("w", F.transform("emb", lambda x: x.cast("double")).alias("v"))))
    means = weighed.groupBy(key, "idx").agg(items("l").alias("l"), items("r").alias("r")).select(key, "idx", vx.weighted_mean(F.col("l")).alias("l"), vx.weighted_mean(F.col("r")).alias("r"))
    cosine = vx.dot(F.col("l"), F.col("r")) / ((vx.norm(F.col("l")) + 1e-8) * (vx.norm(F.col("r")) + 1e-8))
    ok = F.col("l").isNotNull() & F.col("r").isNotNull()
    return cuts.select(key, "idx").join(means, [key, "idx"], "left").select(key, "idx", F.when(ok, 1 - cosine).otherwise(0.0).alias("change"), ok.alias("valid"))


def boundary_rows(shots: DataFrame, changes: dict[str, DataFrame], bridge: DataFrame, key: str, weights: dict[str, float]) -> DataFrame:
    """All modalities of each cut: <m>_change, <m>_valid, <m>_norm (min-max among the key's valid ones), score (weighted mean of the valid), penalty, is_candidate.

    shots (key, idx, s, e); changes by modality (key, idx, change, valid); bridge (key, idx, penalty).
    """
    w = Window.partitionBy(key).orderBy("idx")
    out = shots.select(key, "idx", F.col("e").alias("time"), F.lead("idx").over(w).alias("_next")).where("_next is not null").drop("_next")
    for m, c in changes.items():
        out = out.join(c.select(key, "idx", F.col("change").alias(f"{m}_change"), F.col("valid").alias(f"{m}_valid")), [key, "idx"], "left").fillna({f"{m}_change": 0.0, f"{m}_valid": False})
    out = out.withColumns({f"{m}_norm": min_max(F.col(f"{m}_change"), F.col(f"{m}_valid"), key) for m in changes})
    scored = out.join(bridge.select(key, "idx", "penalty"), [key, "idx"], "left").fillna({"penalty": 0.0}).withColumn("score", fuse(weights))
    return peaks(scored, key)


def _around(counts: DataFrame, key: str, width: int) -> DataFrame:
    """counts (key, idx, face, n) -> a row for each cut that a shot's faces lie around: cut, dist, side."""
    left = counts.select("*", F.explode(F.expr(f"transform(sequence(0, {width - 1}), d -> named_struct('cut', idx + d, 'dist', d, 'side', 'l'))")).alias("a"))
    right = counts.select("*", F.explode(F.expr(f"transform(sequence(1, {width}), d -> named_struct('cut', idx - d, 'dist', d - 1, 'side', 'r'))")).alias("a"))
    return left.unionByName(right).select(key, "face", "n", "a.cut", "a.dist", "a.side")


def face_change(counts: DataFrame, cuts: DataFrame, key: str, width: int = 3, tau: float = 2.0, weighted: bool = True) -> DataFrame:
    """1 - Jaccard overlap of the faces on either side of a cut -> key, idx, change, valid.

    Weighted: histograms of count * exp(-distance / tau). Else sets: no face on both sides is invalid, on one side 0 overlap.
    """
    w = F.col("n") * F.exp(-F.col("dist") / tau) if weighted else F.lit(1.0)
    side = lambda s: F.coalesce((F.sum if weighted else F.max)(F.when(F.col("side") == s, w)), F.lit(0.0)).alias(s)
    hist = _around(counts, key, width).groupBy(key, F.col("cut").alias("idx"), "face").agg(side("l"), side("r"))
    total = hist.groupBy(key, "idx").agg(F.sum(F.least("l", "r")).alias("low"), F.sum(F.greatest("l", "r")).alias("high"), F.sum("l").alias("l"), F.sum("r").alias("r"))
    out = cuts.select(key, "idx").join(total, [key, "idx"], "left")
    ok = (F.col("l") > 1e-8) & (F.col("r") > 1e-8) if weighted else F.coalesce("high", F.lit(0.0)) > 0
    ok = F.coalesce(ok, F.lit(False))
    return out.select(key, "idx", F.when(ok, 1 - F.col("low") / F.col("high")).otherwise(0.0).alias("change"), ok.alias("valid"))


def face_context(faces: DataFrame, key: str, width: int = 3) -> DataFrame:
    """faces (key, idx, face_ids; null or empty: none) -> key, idx, left_ids, right_ids, shared_ids: sorted ids seen on either side of each cut, and on both."""
    w = Window.partitionBy(key).orderBy("idx")
    near = lambda a, b: F.array_sort(F.array_distinct(F.flatten(F.collect_list("face_ids").over(w.rowsBetween(a, b)))))
    both = faces.select(key, "idx", near(1 - width, 0).alias("left_ids"), near(1, width).alias("right_ids"), F.lead("idx").over(w).alias("_next")).where("_next is not null")
    return both.select(key, "idx", "left_ids", "right_ids", F.array_sort(F.array_intersect("left_ids", "right_ids")).alias("shared_ids"))


def used_weights(parts: dict[str, float], valid: str = "{}_valid") -> Column:
    """The share of each valid modality in the score, by name."""
    total = sum((F.when(F.col(valid.format(m)), F.lit(w)).otherwise(0.0) for m, w in parts.items()), F.lit(0.0))
    used = F.filter(F.array(*(F.struct(F.lit(m).alias("key"), F.when(F.col(valid.format(m)), F.lit(w)).alias("value")) for m, w in parts.items())), lambda x: x["value"].isNotNull())
    return F.map_from_entries(F.transform(used, lambda x: F.struct(x["key"], x["value"] / total)))


def min_max(value: Column, valid: Column, key: str) -> Column:
    """Min-max normalised among a key's valid rows; invalid rows get 0."""
    w = Window.partitionBy(key)
    v = F.when(valid, value)
    low, high = F.min(v).over(w), F.max(v).over(w)
    return F.when(valid, (value - low) / F.greatest(high - low, F.lit(1e-8))).otherwise(0.0)


def fuse(parts: dict[str, float], value: str = "{}_norm", valid: str = "{}_valid") -> Column:
    """Weighted mean over the valid modalities, 0 if there is none."""
    total = sum((F.when(F.col(valid.format(m)), w * F.col(value.format(m))).otherwise(0.0) for m, w in parts.items()), F.lit(0.0))
    weight = sum((F.when(F.col(valid.format(m)), F.lit(w)).otherwise(0.0) for m, w in parts.items()), F.lit(0.0))
    return F.when(weight > 1e-8, total / weight).otherwise(0.0)


def peaks(scores: DataFrame, key: str, score: str = "score", q: float = 0.85) -> DataFrame:
    """Marks scores at or over their neighbours' and the key's percentile."""
    w = Window.partitionBy(key).orderBy("idx")
    cut = F.percentile(score, F.lit(q)).over(Window.partitionBy(key))
    near = scores.where(F.col(key).isNotNull()).withColumn("threshold", cut).withColumn("_p", F.lag(score, 1, -1.0).over(w)).withColumn("_n", F.lead(score, 1, -1.0).over(w))
    mark = (F.col(score) >= F.col("_p")) & (F.col(score) >= F.col("_n")) & (F.col(score) >= F.col("threshold"))
    return near.withColumn("is_candidate", mark).drop("_p", "_n")
