"""Retrieval stores: mappings of items to what they touch, built in one pass, checked, and kept in versions.

A version is a folder of tables. Rows are counted while they are written, and
edges are checked against the tables they lead to; only then does the manifest
name the version, so readers see a whole store or the one before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quern.operators.intervals import edge_weights

#: (table, column) that must be found in (table, column).
REFERENCES = [
    (("events", "video"), ("videos", "video")),
    (("shots", "event_id"), ("events", "event_id")),
    (("subtitle_shots", "subtitle_id"), ("subtitles", "subtitle_id")),
    (("subtitle_shots", "shot_id"), ("shots", "shot_id")),
    (("subtitle_events", "event_id"), ("events", "event_id")),
    (("ocr", "shot_id"), ("shots", "shot_id")),
]
MANIFEST = "version string, sequence long, name string, rows long"


def build_mappings(metadata: dict[str, DataFrame], ocr: DataFrame) -> dict[str, DataFrame]:
    """metadata: tables of tables.load_metadata(); ocr (ocr_id, video, shot_id) -> those tables and the edges.

    subtitle_shots and subtitle_events (subtitle_id, target, weight: the share of the subtitle that the target covers), and
    ocr (ocr_id, shot_id, event_id, video).
    """
    subs = metadata["subtitles"].select("video", "subtitle_id", F.col("s").alias("bs"), F.col("e").alias("be"))

    def edges(name: str, target: str) -> DataFrame:
        return edge_weights(subs, metadata[name].select("video", target, "s", "e"), "video").select("subtitle_id", target, "weight")

    placed = ocr.select("ocr_id", "shot_id").join(metadata["shots"].select("shot_id", "event_id", "video"), "shot_id", "left").select("ocr_id", "shot_id", "event_id", "video")
    return {**metadata, "subtitle_shots": edges("shots", "shot_id"), "subtitle_events": edges("events", "event_id"), "ocr": placed}


def search_edges(store: dict[str, DataFrame], target: str) -> DataFrame:
    """A store's edges as pooling.expand() takes them: channel, item_id, target, weight; target: shot_id or event_id."""
    told = store["subtitle_shots" if target == "shot_id" else "subtitle_events"].select(F.lit("subtitle").alias("channel"), F.col("subtitle_id").alias("item_id"), F.col(target).alias("target"), "weight")
    seen = store["ocr"].where(F.col(target).isNotNull()).select(F.lit("ocr").alias("channel"), F.col("ocr_id").alias("item_id"), F.col(target).alias("target"), F.lit(1.0).alias("weight"))
    return told.unionByName(seen)


def validated(vectors: DataFrame, key: str = "item_id") -> DataFrame:
    """vectors (key, emb) as they are; a null or non-finite component, another length than the first's, or an id twice raises before anything is written."""
    bad = F.coalesce(F.exists("emb", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf"))), F.lit(True))
    found = vectors.agg(F.count_if(bad).alias("bad"), F.min(F.size("emb")).alias("least"), F.max(F.size("emb")).alias("most")).first()
    twice = vectors.groupBy(key).count().where("count > 1").limit(1).count()
    if found["bad"] or found["least"] != found["most"] or twice:
        raise ValueError(f"vectors: {found['bad']} not finite, lengths {found['least']} to {found['most']}, {'repeated' if twice else 'unique'} ids")
    return vectors


def save_store(tables: dict[str, DataFrame], path: str, references: list | None = None) -> str:
    """Writes a version, checks it and names it in the manifest -> the version. A dangling edge raises, and the manifest stays as it was."""
    spark, version = next(iter(tables.values())).sparkSession, uuid.uuid4().hex
    counts = []
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{version}/{name}")
        counts.append((name, seen.get["rows"]))
    written = {name: spark.read.schema(df.schema).parquet(f"{path}/{version}/{name}") for name, df in tables.items()}
    for (name, column), (parent, key) in references if references is not None else REFERENCES:
        if name in written and parent in written:
            lost = written[name].select(F.col(column).alias("_k")).join(written[parent].select(F.col(key).alias("_k")), "_k", "left_anti").limit(3).collect()
            if lost:
                raise ValueError(f"{name}.{column} leads to rows that {parent} hasn't got: {[r[0] for r in lost]}")
    try:
        last = spark.read.schema(MANIFEST).json(f"{path}/manifest").agg(F.max("sequence")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = 0
    spark.createDataFrame([(version, last + 1, name, rows) for name, rows in counts], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")
    return version


def load_store(spark: SparkSession, path: str, version: str | None = None) -> dict[str, DataFrame]:
    """The tables of a version, by default the last that the manifest names; a table whose rows aren't as many as were written raises."""
    named = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()  # a row for each table of each version
    wanted = version or max(named, key=lambda r: (r["sequence"], r["version"]))["version"]
    rows = [r for r in named if r["version"] == wanted]
    out = {}
    for r in rows:
        out[r["name"]] = spark.read.parquet(f"{path}/{r['version']}/{r['name']}")
        if out[r["name"]].count() != r["rows"]:
            raise ValueError(f"{r['name']} hasn't got the {r['rows']} rows that were written")
    if not out:
        raise ValueError(f"no version {version} in {path}")
    return out

