"""Feature files of videos: pickles of vectors, face and subtitle JSON, one file a video.

Files are read by Spark's own readers, so any store that they reach will do; a
file is a row, which a task unpickles without running anything that the file
names: only plain containers and numpy arrays are allowed. With ids, only their
files are read, and a missing one raises.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import normalize
from quern.operators.folds import pools
from quern.sources.ordinals import dense_ordinals

ALLOWED = {("numpy", "ndarray"), ("numpy", "dtype"), ("collections", "OrderedDict")}
ALLOWED |= {(m, n) for m in ("numpy.core.multiarray", "numpy._core.multiarray") for n in ("_reconstruct", "scalar")} | {("numpy._core.numeric", "_frombuffer"), ("numpy.core.numeric", "_frombuffer")}


class PlainUnpickler(pickle.Unpickler):
    def find_class(self, module: str, name: str):
        if (module, name) not in ALLOWED:
            raise pickle.UnpicklingError(f"{module}.{name} isn't allowed in a feature file")
        return super().find_class(module, name)


def read_files(spark: SparkSession, path: str, kind: str = "pkl", ids: list[str] | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Files of a folder, one a video -> video_id (the name), content; those of the ids, or an inclusive slice of the names in order (numbers by value)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load([f"{path}/{i}.{kind}" for i in ids] if ids else path)
    rows = files.select(F.regexp_extract("path", rf"([^/]+)\.{kind}$", 1).alias("video_id"), "content")
    if first is None and last is None:
        return rows
    names = dense_ordinals(rows.select("video_id", F.col("video_id").try_cast("long").alias("_n")), ["_n", "video_id"], "_i")
    most = last if last is not None else (1 << 62)
    return rows.join(names.where(F.col("_i").between(first or 0, most)).select("video_id"), "video_id", "left_semi")


def unpickled(files: DataFrame, each: Callable[[str, object], list[tuple]], schema: str) -> DataFrame:
    """files (video_id, content) -> the tuples of each payload."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, content in zip(batch["video_id"], batch["content"], strict=True):  # one file's rows at a time
                yield pd.DataFrame(each(video, PlainUnpickler(io.BytesIO(content)).load()), columns=names)

    return files.select("video_id", "content").mapInPandas(run, schema)


def _vector(x: object) -> list[float] | None:
    return None if x is None else np.asarray(x, np.float32).reshape(-1).tolist()


def item_vectors(spark: SparkSession, path: str, items: str, ids: list[str] | None = None) -> DataFrame:
    """Pickles {video_id?, events | shots: [{event_id | shot_id, embedding}]} -> index_id, item_id (video:number), video_id, emb; ids in the order of file (numbers by value) and item.

    items: `events` or `shots`. A payload without video_id takes its file's name.
    """
    name = f"{items.removesuffix('s')}_id"

    def each(stem: str, payload: dict) -> list[tuple]:
        video = str(payload.get("video_id", stem))
        return [(stem, i, f"{video}:{item[name]}", video, _vector(item["embedding"])) for i, item in enumerate(payload[items])]

    rows = unpickled(read_files(spark, path, ids=ids), each, "stem string, ord long, item_id string, video_id string, emb array<float>")
    rows = rows.withColumn("_n", F.col("stem").try_cast("long"))
    return dense_ordinals(rows, ["_n", "stem", "ord"]).select("index_id", "item_id", "video_id", "emb")


def visual_features(files: DataFrame, temperature: float = 15.0) -> DataFrame:
    """Pickles {shots: [{shot_id, embedding?, keyframe_embeddings}]} -> video_id, shot_id, emb: a shot's unit vector, else the softmax pool of its keyframes', null without either."""

    def one(shot: dict) -> list[float] | None:
        if shot.get("embedding") is not None:
            x = np.asarray(shot["embedding"], np.float64).reshape(-1)
            return (x / (np.linalg.norm(x) + 1e-8)).tolist()
        found = shot.get("keyframe_embeddings")
        x = np.asarray([] if found is None else found, np.float64)
        return pools(np.atleast_2d(x), temperature)[2] if x.size else None

    return unpickled(files, lambda video, payload: [(video, int(s["shot_id"]), one(s)) for s in payload["shots"]], "video_id string, shot_id long, emb array<double>")


def action_features(files: DataFrame) -> DataFrame:
    """Pickles {shots: [{shot_id, action_feature, num_subshots, pooling}]} -> video_id, shot_id, emb (unit), num_subshots, pooling."""

    def one(video: str, s: dict) -> tuple:
        x = np.asarray(s["action_feature"], np.float64).reshape(-1)
        return video, int(s["shot_id"]), (x / (np.linalg.norm(x) + 1e-8)).tolist(), int(s.get("num_subshots", 1)), s.get("pooling")

    return unpickled(files, lambda video, payload: [one(video, s) for s in payload["shots"]], "video_id string, shot_id long, emb array<double>, num_subshots long, pooling string")


def text_features(files: DataFrame) -> DataFrame:
    """Pickles {subtitles | items | captions: [...], embeddings} -> video_id, ord, s, e, text, emb. Unequal numbers raise."""

    def each(stem: str, payload: dict) -> list[tuple]:
        items = next((payload[k] for k in ("subtitles", "items", "captions") if payload.get(k) is not None), [])
        found = np.asarray(payload["embeddings"], np.float32)
        if len(items) != len(found):
            raise ValueError(f"{stem}: {len(items)} items and {len(found)} vectors")
        number = lambda x: None if x is None else float(x)
        return [(stem, i, number(x.get("start_time_sec")), number(x.get("end_time_sec")), x.get("text", x.get("caption")), v.tolist()) for i, (x, v) in enumerate(zip(items, found, strict=True))]

    return unpickled(files, each, "video_id string, ord long, s double, e double, text string, emb array<float>")


def face_features(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """JSON lists <path>/<video>/shots_with_faces.json -> video_id, shot_id, face_ids, face_counts, detections."""
    kind = "array<struct<shot_id:long,face_ids:array<long>,face_id_counts:map<string,long>,face_detections:array<string>>>"
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text([f"{path}/{i}/shots_with_faces.json" for i in ids] if ids else path)
    rows = files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+\.json$", 1).alias("video_id"), F.explode(F.from_json("value", kind)).alias("x"))
    none = F.array().cast("array<bigint>")
    return rows.select("video_id", "x.shot_id", F.coalesce("x.face_ids", none).alias("face_ids"), F.coalesce("x.face_id_counts", F.create_map().cast("map<string,bigint>")).alias("face_counts"), F.coalesce(F.size("x.face_detections"), F.lit(0)).alias("detections"))


def video_features(spark: SparkSession, path: str, ids: list[str] | None = None) -> dict[str, DataFrame]:
    """The four modalities of videos: visual_embeddings, action_features, subtitle_embeddings (pickles) and face_detection (JSON) under one folder."""
    files = lambda name: read_files(spark, f"{path}/{name}", ids=ids)
    return {"visual": visual_features(files("visual_embeddings")), "action": action_features(files("action_features")), "subtitle": text_features(files("subtitle_embeddings")), "face": face_features(spark, f"{path}/face_detection", ids)}


def subtitle_texts(spark: SparkSession, path: str, index: str = "subtitle") -> DataFrame:
    """JSON lists of {frame_start, frame_end, text}, one file a video -> id (index_video_frame), video, first, last, text (normalised). Blank texts and files that aren't lists go."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    kind = "array<struct<frame_start:long,frame_end:long,text:string>>"
    lists = files.where(F.ltrim("value").startswith("["))
    rows = lists.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("video"), F.explode(F.from_json("value", kind)).alias("x"))
    told = rows.select("video", F.col("x.frame_start").alias("first"), F.col("x.frame_end").alias("last"), normalize(F.coalesce("x.text", F.lit(""))).alias("text")).where("text <> ''")
    return told.select(F.concat_ws("_", F.lit(index), "video", "first").alias("id"), "video", "first", "last", "text")
