"""Shots: normalisation, frames and times, sampling, features, queries by stage, OCR boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: What is not allowed in a text that could be Vietnamese or English.
ODD = r"[^\p{IsLatin}0-9.,!?;:'\"()\[\]\-_/&%$@#+=*…]"


def _first(df: DataFrame, kind: str, *names: str) -> Column:
    return F.coalesce(*(F.col(n).cast(kind) for n in names if n in df.columns), F.lit(None).cast(kind))


def normalise(shots: DataFrame, key: str, place: str | None = None) -> DataFrame:
    """Shots under any of their names -> key, shot_id, s, e, duration, first_frame, last_frame (null if not given), in order.

    A shot without an id takes its place in the given list (column `place`, from 0; without it, its place by start). A given
    duration stays; else it is the end less the start, not negative.
    """
    rows = shots.select(
        key,
        _first(shots, "long", "shot_id", "id").alias("shot_id"),
        _first(shots, "double", "start_time_sec", "start_time", "start").alias("s"),
        _first(shots, "double", "end_time_sec", "end_time", "end").alias("e"),
        _first(shots, "double", "duration_sec").alias("duration"),
        _first(shots, "long", "start_frame").alias("first_frame"),
        _first(shots, "long", "end_frame").alias("last_frame"),
        (F.col(place) if place else F.lit(None)).cast("long").alias("_place"),
    )
    number = F.col("_place") if place else F.row_number().over(Window.partitionBy(key).orderBy("s", "shot_id")) - 1
    known = F.coalesce("duration", F.greatest(F.lit(0.0), F.col("e") - F.col("s")))
    return rows.select(key, F.coalesce("shot_id", number.cast("long")).alias("shot_id"), "s", "e", known.alias("duration"), "first_frame", "last_frame")


def frame_times(first: Column, last: Column, fps: Column, frames: Column) -> Column:
    """Start and end seconds of frames first..last (inclusive), clamped to the video, three decimals."""
    lo, hi = (F.least(F.greatest(x, F.lit(0)), frames - 1) for x in (first, last))
    return F.struct(F.round(lo / fps, 3).alias("s"), F.round((hi + 1) / fps, 3).alias("e"))


def sample_times(s: Column, e: Column, most: int = 5) -> Column:
    """n = min(most, ceil(duration / 2)) times, evenly between margins of min(0.15 * duration, 0.25); the middle for n = 1, none without a duration."""
    d = e - s
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(d / 2).cast("int")))
    margin = F.least(0.15 * d, F.lit(0.25))
    lo, hi = s + margin, e - margin
    return F.when(d <= 0, F.array().cast("array<double>")).when(n == 1, F.array((s + e) / 2)).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: lo + (hi - lo) * i / (n - 1)))


def sample_frames(first: Column, last: Column, step: int, frames: Column) -> Column:
    """Every step-th frame of first..last that lies in the video; if there is none, the middle of first..last, clamped to the video."""
    every = F.when(last >= first, F.filter(F.sequence(first, F.greatest(first, last), F.lit(step).cast("long")), lambda f: (f >= 0) & (f < frames))).otherwise(F.array().cast("array<bigint>"))
    middle = F.least(F.greatest(F.floor((first + last) / 2), F.lit(0)), F.greatest(frames - 1, F.lit(0)))
    return F.when(F.size(every) > 0, every).otherwise(F.array(middle))


def index_window(start: Column, end: Column, lo: Column, hi: Column, count: Column) -> Column:
    """Places [a, b) of a sequence of `count` features over seconds lo..hi that cover start..end: shares of the duration times the count, rounded outwards and clamped; never empty where there is a feature."""
    span = F.greatest(hi - lo, F.lit(1e-3))
    share = lambda t: F.least(F.greatest((t - lo) / span, F.lit(0.0)), F.lit(1.0))
    a = F.least(F.greatest(F.floor(share(start) * count), F.lit(0)), F.greatest(count - 1, F.lit(0)))
    b = F.least(F.greatest(F.ceil(share(end) * count), a + 1), count)
    return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))


def sub_shots(s: Column, e: Column, clip: float) -> Column:
    """ceil(duration / clip) equal ranges."""
    n = F.greatest(F.lit(1), F.ceil((e - s) / clip).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((s + (e - s) * i / n).alias("s"), (s + (e - s) * (i + 1) / n).alias("e")))


def resample(values: Column, n: int) -> Column:
    """n elements at evenly spaced places."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.element_at(values, F.round(i * (F.size(values) - 1) / max(1, n - 1)).cast("int") + 1))


def shot_features(shots: DataFrame, parent: str, norm: float = 10.0) -> DataFrame:
    """Place among the parent's shots, duration over `norm` seconds (1 at most), start and end relative to the parent; shots (parent, idx, s, e)."""
    w = Window.partitionBy(parent)
    lo, hi = F.min("s").over(w), F.max("e").over(w)
    span = F.greatest(hi - lo, F.lit(1e-6))
    position = (F.row_number().over(w.orderBy("idx")) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))
    share = F.least((F.col("e") - F.col("s")) / norm, F.lit(1.0))
    return shots.select(parent, "idx", position.alias("position"), share.alias("duration"), ((F.col("s") - lo) / span).alias("rel_start"), ((F.col("e") - lo) / span).alias("rel_end"))


def keyframe_features(frames: DataFrame, shot: list[str], fps: float, norm: float = 1.0) -> DataFrame:
    """frames (shot, s, e, frame): place among the shot's frames, time relative to the shot's seconds, and seconds to the frames before and after over `norm`, 1 at most."""
    w = Window.partitionBy(*shot)
    o = w.orderBy("frame")
    near = lambda d: F.least(F.coalesce(F.greatest(d, F.lit(0)) / fps, F.lit(0.0)) / max(norm, 1e-6), F.lit(1.0))
    return frames.select(
        *shot,
        "frame",
        ((F.row_number().over(o) - 1) / F.greatest(F.count("*").over(w) - 1, F.lit(1))).alias("rel_pos"),
        ((F.col("frame") / fps - F.col("s")) / F.greatest(F.col("e") - F.col("s"), F.lit(1e-6))).alias("rel_time"),
        near(F.col("frame") - F.lag("frame").over(o)).alias("before"),
        near(F.lead("frame").over(o) - F.col("frame")).alias("after"),
    )


def dataset_events(events: DataFrame, captions: DataFrame, shots: DataFrame, durations: DataFrame, intro: float = 120.0, outro: float = 120.0, least: int = 1, most: int = 64) -> DataFrame:
    """Training samples: events (video, event, s, e, shot_ids) with a caption (video, event, caption), outside intro and outro, of which all of the first `most` shots exist.

    An event of fewer than `least` shots goes, and so does one with a missing shot.
    """
    live = events.join(durations, "video").where((F.col("s") > intro) & (F.col("e") < F.col("duration") - outro) & (F.size("shot_ids") >= least))
    told = captions.where(F.trim("caption") != "").select("video", "event", "caption")
    live = live.join(told, ["video", "event"]).withColumn("shot_ids", F.slice("shot_ids", 1, most))
    each = live.select("video", "event", F.posexplode("shot_ids").alias("pos", "idx")).join(shots.select("video", "idx", F.lit(1).alias("_there")), ["video", "idx"], "left")
    whole = each.groupBy("video", "event").agg(F.count("*").alias("n"), F.count("_there").alias("_found")).where("n = _found").drop("_found")
    return live.join(whole, ["video", "event"]).select("video", "event", "s", "e", "caption", "shot_ids", "n")


def clean_stages(stages: DataFrame) -> DataFrame:
    """stages (query_id, stage, visual, ocr, subtitle[, dialogue]): trimmed, empty channels null, empty stages and repeats of the stage before dropped, numbered anew."""
    clean = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    subtitle = F.coalesce(clean("subtitle"), clean("dialogue")) if "dialogue" in stages.columns else clean("subtitle")
    rows = stages.select("query_id", "stage", clean("visual").alias("visual"), clean("ocr").alias("ocr"), subtitle.alias("subtitle")).where("visual is not null or ocr is not null or subtitle is not null")
    w = Window.partitionBy("query_id").orderBy("stage")
    now = F.struct("visual", "ocr", "subtitle")
    kept = rows.withColumn("_same", now.eqNullSafe(F.lag(now).over(w))).where("not _same")
    return kept.withColumn("stage", (F.row_number().over(w) - 1).cast("long")).drop("_same")


def route_boxes(boxes: DataFrame, roi: tuple[float, float, float, float], most: int = 2, sure: float = 0.75) -> DataFrame:
    """boxes (video, frame, x1, y1, x2, y2, angle, text, score) with `route`: subtitle, scene or null.

    Subtitle: the centre lies in the region, at 8 degrees at most, and the text could be Vietnamese or English: a score of
    `sure` or more, Latin letters, none of other scripts, and 0.7 of its visible characters allowed. What exceeds `most` in
    a frame, by y then x, is scene text, as are other boxes with a score of 0.5 or more.
    """
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = x.between(roi[0], roi[2]) & y.between(roi[1], roi[3]) & (F.abs("angle") <= 8)
    visible = F.regexp_replace("text", r"[\s\p{Z}]", "")
    allowed = F.length(F.regexp_replace(visible, ODD, "")) / F.greatest(F.length(visible), F.lit(1))
    latin = F.col("text").rlike(r"\p{IsLatin}") & ~F.col("text").rlike(r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]") & (allowed >= 0.7) & (F.col("score") >= sure)
    sub = inside & latin
    w = Window.partitionBy("video", "frame", sub).orderBy("y1", "x1", "x2", "y2", "text")
    first = sub & (F.row_number().over(w) <= most)
    return boxes.withColumn("route", F.when(first, "subtitle").when(sub | (F.col("score") >= 0.5), "scene"))


def frame_text(boxes: DataFrame) -> DataFrame:
    """Lines of a frame's text, from top to bottom and left to right."""
    lines = F.array_sort(F.collect_list(F.struct("y1", "x1", "text")))
    return boxes.groupBy("video", "frame").agg(F.array_join(F.transform(lines, lambda b: b["text"]), "\n").alias("text"))


def usable_faces(faces: DataFrame, width: Column, height: Column, score: float = 0.5, size: float = 40) -> DataFrame:
    """faces (x1, y1, x2, y2, det_score) clipped to the frame, with a score and side length that suffice."""
    clip = lambda c, most: F.least(F.greatest(F.col(c), F.lit(0)), most)
    out = faces.withColumns({"x1": clip("x1", width), "x2": clip("x2", width), "y1": clip("y1", height), "y2": clip("y2", height)})
    return out.where((F.col("det_score") >= score) & (F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= size))


def expand_box(x1: Column, y1: Column, x2: Column, y2: Column, by: float, width: Column, height: Column) -> Column:
    """The box scaled about its centre, clipped to the frame."""
    cx, cy, w, h = (x1 + x2) / 2, (y1 + y2) / 2, (x2 - x1) * by / 2, (y2 - y1) * by / 2
    return F.struct(F.greatest(cx - w, F.lit(0)).alias("x1"), F.greatest(cy - h, F.lit(0)).alias("y1"), F.least(cx + w, width).alias("x2"), F.least(cy + h, height).alias("y2"))


def assign_events(segments: DataFrame, shots: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """segments (key, event, first, last), shots (key, idx, ...) -> shots with their event, and its columns in `keep`: that of the last segment that starts at or before them, found by one sorted pass. Shots before the first segment go."""
    w = Window.partitionBy(key).orderBy("idx", "_p").rowsBetween(Window.unboundedPreceding, 0)
    marks = segments.select(key, F.col("first").alias("idx"), F.lit(0).alias("_p"), F.struct("event", *keep).alias("_g"))
    both = shots.withColumn("_p", F.lit(1)).unionByName(marks, allowMissingColumns=True).withColumn("_g", F.last("_g", ignorenulls=True).over(w))
    return both.where("_p = 1 and _g.event is not null").select(*shots.columns, "_g.*")


def face_counts(faces: Column) -> Column:
    """Sorted faces -> their counts by face; null if there is none."""
    counts = F.transform(F.array_distinct(faces), lambda f: F.struct(f, F.size(F.filter(faces, lambda x: x == f)).cast("long")))
    return F.when(F.size(faces) > 0, F.map_from_entries(counts))


def build_events(segments: DataFrame, shots: DataFrame, key: str, ends: tuple[str, ...] = ()) -> DataFrame:
    """segments (key, event, first, last), shots (key, idx, s, e, text, face) -> an event a row with its shots, times, texts in order without repeats, and face counts (by face, in its order; null if there is none).

    ends: columns of shots whose value at an event's last shot is kept.
    """
    both = assign_events(segments, shots, key)
    texts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("idx", "text")))), lambda x: x["text"]))
    last = [F.max_by(c, "idx").alias(c) for c in ends]
    rows = both.groupBy(key, "event").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n_shots"), F.array_sort(F.collect_list("idx")).alias("shot_ids"), F.array_join(texts, " ").alias("text"), F.array_sort(F.collect_list("face")).alias("_f"), *last)
    return rows.withColumn("face_counts", face_counts(F.col("_f"))).drop("_f")


def box_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees of a box's upper edge against the horizontal, within -90..90."""
    angle = F.degrees(F.atan2(y2 - y1, x2 - x1))
    return F.when(angle > 90, angle - 180).when(angle < -90, angle + 180).otherwise(angle)


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, padding: int = 5) -> Column:
    """The box with padding, clipped to the frame; null if nothing is left."""
    box = F.struct(F.greatest(x1 - padding, F.lit(0)).alias("x1"), F.greatest(y1 - padding, F.lit(0)).alias("y1"), F.least(x2 + padding, width).alias("x2"), F.least(y2 + padding, height).alias("y2"))
    return F.when((box["x2"] > box["x1"]) & (box["y2"] > box["y1"]), box)


def stable_faces(detections: DataFrame, key: list[str], least: int = 2) -> DataFrame:
    """detections (key, face) -> key, face_ids (sorted) and face_counts of the faces that a shot shows `least` times or more."""
    seen = detections.where("face is not null").groupBy(*key, "face").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    pairs = F.array_sort(F.collect_list(F.struct("face", "n")))
    return seen.groupBy(*key).agg(F.transform(pairs, lambda p: p["face"]).alias("face_ids"), F.map_from_entries(pairs).alias("face_counts"))


def face_summary(shots: DataFrame, changes: DataFrame, detections: DataFrame) -> DataFrame:
    """shots (key.., face_ids or null), changes (change, valid), detections (face: its cluster) -> one row: shots, with_faces, ratio, faces (all clusters, however rare), boundaries, valid, mean_change over the valid ones, valid_ratio."""
    a = shots.agg(F.count("*").alias("shots"), F.count_if(F.size("face_ids") > 0).alias("with_faces"))
    faces = detections.agg(F.count_distinct("face").alias("faces"))
    b = changes.agg(F.count("*").alias("boundaries"), F.count_if("valid").alias("valid"), F.avg(F.when(F.col("valid"), F.col("change"))).alias("mean_change"))
    both = a.crossJoin(faces).crossJoin(b)  # three tables of one row
    return both.withColumn("ratio", F.col("with_faces") / F.greatest(F.col("shots"), F.lit(1))).withColumn("valid_ratio", F.col("valid") / F.greatest(F.col("boundaries"), F.lit(1)))


def missing_videos(asked: DataFrame, have: DataFrame, key: str = "video") -> DataFrame:
    """asked (key) -> key, found: whether the videos asked for are there."""
    return asked.select(key).distinct().join(have.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").select(key, F.coalesce("_f", F.lit(False)).alias("found"))
