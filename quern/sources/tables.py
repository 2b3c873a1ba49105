"""Sources and sinks: the tables of the tests in their roles, files of the stages, stores and preflight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_items(spark: SparkSession, path: str, schema: str, ids: list[str] | None = None) -> DataFrame:
    """JSON files of a folder, one an item, with video_id from the name; ids that have no file raise when read."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    rows = rows.withColumn("video_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1))
    if ids is None:
        return rows
    wanted = spark.createDataFrame([(i,) for i in ids], "video_id string")
    missing = F.raise_error(F.concat(F.lit("no file for "), F.col("video_id")))
    return wanted.join(rows.withColumn("_there", F.lit(True)), "video_id", "left").where(F.when(F.col("_there").isNull(), missing.cast("boolean")).otherwise(True)).drop("_there")


def read_media(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: list[str] | None = None) -> DataFrame:
    """Video files by name: path, video_id, length; those of the ids (a missing one raises), or an inclusive slice of the sorted list, if asked for."""
    from quern.sources.ordinals import dense_ordinals

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load([f"{path}/{i}.mp4" for i in ids] if ids else path)
    rows = files.select("path", F.regexp_extract("path", r"([^/]+)\.mp4$", 1).alias("video_id"), "length")
    if first is None and last is None:
        return rows
    return dense_ordinals(rows, ["video_id", "path"], "_i").where(F.col("_i").between(first or 0, last if last is not None else 1 << 62)).drop("_i")


def text_items(rows: DataFrame) -> DataFrame:
    """rows (video_id, subtitles | items | captions, embeddings) -> video_id, ord, item, emb; unequal counts raise."""
    items = F.coalesce(*(F.col(c) for c in ("subtitles", "items", "captions") if c in rows.columns))
    bad = F.raise_error(F.concat(F.lit("items and vectors differ in number: "), F.col("video_id")))
    zipped = F.when(F.size(items) == F.size("embeddings"), F.arrays_zip(items.alias("item"), F.col("embeddings").alias("emb"))).otherwise(bad.cast(f"array<struct<item:{rows.schema[next(c for c in ('subtitles', 'items', 'captions') if c in rows.columns)].dataType.elementType.simpleString()},emb:array<float>>>"))
    return rows.select("video_id", F.posexplode(zipped).alias("ord", "x")).select("video_id", "ord", F.col("x")["item"].alias("item"), F.col("x")["emb"].alias("emb"))


def ocr_items(rows: DataFrame) -> DataFrame:
    """rows (video_id, body): a list of {frame_id | frame_index, text} or a map frame -> text; blank texts and frame -1 go -> video_id, frame, text."""
    listed = F.from_json("body", "array<struct<frame_id:long,frame_index:long,text:string,text_raw:string>>")
    mapped = F.from_json("body", "map<string,string>")
    a = rows.where("body like '[%'").select("video_id", F.explode(listed).alias("x")).select("video_id", F.coalesce("x.frame_id", "x.frame_index").alias("frame"), F.coalesce("x.text", "x.text_raw").alias("text"))
    b = rows.where("body like '{%'").select("video_id", F.explode(mapped).alias("frame", "text")).withColumn("frame", F.col("frame").cast("long"))
    return a.unionByName(b).where("trim(text) <> '' and frame <> -1")


def write_store(tables: dict[str, DataFrame], path: str, partition: str | None = None) -> DataFrame:
    """Writes each table as Parquet (by partition, which is overwritten alone) and a manifest of row counts, which is returned."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        out = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (out.partitionBy(partition) if partition and partition in df.columns else out).parquet(f"{path}/{name}")
    counts = [spark.read.parquet(f"{path}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name in tables]
    manifest = counts[0]
    for c in counts[1:]:
        manifest = manifest.unionByName(c)
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("name string, rows long").json(f"{path}/manifest")


def pending(items: DataFrame, done: DataFrame, key: str = "video_id") -> DataFrame:
    """Items that have no output yet: a run that is started again does these alone."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def preflight(modalities: dict[str, DataFrame], key: str = "video_id") -> DataFrame:
    """All ids of any modality, with those each lacks."""
    rows = None
    for name, df in modalities.items():
        part = df.select(key).distinct().withColumn("modality", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    have = F.array_sort(F.collect_set("modality"))
    names = F.array(*(F.lit(n) for n in sorted(modalities)))
    return rows.groupBy(key).agg(have.alias("have")).withColumn("missing", F.array_except(names, "have"))


def run_summary(status: DataFrame) -> DataFrame:
    """status (status) -> a row for done, skipped and failed."""
    all_ = status.sparkSession.createDataFrame([(s,) for s in ("done", "skipped", "failed")], "status string")
    return all_.join(status.groupBy("status").agg(F.count("*").alias("n")), "status", "left").fillna(0, ["n"])


def durations(*tables: DataFrame, key: str = "video") -> DataFrame:
    """A video's duration: the largest end (e) over all its tables."""
    rows = tables[0].select(key, "e")
    for t in tables[1:]:
        rows = rows.unionByName(t.select(key, "e"))
    return rows.groupBy(key).agg(F.max("e").alias("duration"))


def load_metadata(events: DataFrame, shots: DataFrame, subtitles: DataFrame) -> dict[str, DataFrame]:
    """events (video, event, s, e, shots), shots (video, shot, s, e), subtitles (video, s, e, text) -> tables videos, events, shots and subtitles with
    surrogate ids (video:number), the order of a shot in its event, and each video's duration."""
    e = events.select(F.concat_ws(":", "video", "event").alias("event_id"), "video", "s", "e", "shots")
    own = e.select("event_id", "video", F.posexplode("shots").alias("shot_order", "shot"))
    sh = shots.join(own, ["video", "shot"]).select(F.concat_ws(":", "video", "shot").alias("shot_id"), "event_id", "video", "shot_order", "s", "e")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("video").orderBy("s", "e", "text")) - 1
    su = subtitles.withColumn("n", number).select(F.concat_ws(":", "video", "n").alias("subtitle_id"), "video", "s", "e", "text")
    return {"videos": durations(e, sh, su), "events": e.drop("shots"), "shots": sh, "subtitles": su}


def vector_store(vectors: DataFrame, path: str, metric: str = "ip") -> None:
    """vectors (item_id, emb) as Parquet in order of item_id, and their number, length and metric as JSON."""
    vectors.repartitionByRange("item_id").sortWithinPartitions("item_id").write.mode("overwrite").parquet(f"{path}/vectors")
    vectors.agg(F.count("*").alias("rows"), F.max(F.size("emb")).alias("dim"), F.lit(metric).alias("metric")).write.mode("overwrite").json(f"{path}/config")


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    """vector_store()'s vectors; a store with another number of rows than its config says raises, and a vector of another length does when read."""
    config = spark.read.schema("rows long, dim int, metric string").json(f"{path}/config").first()
    bad = F.raise_error(F.lit(f"a vector isn't of length {config['dim']}")).cast("boolean")
    vectors = spark.read.parquet(f"{path}/vectors")
    if vectors.count() != config["rows"]:  # from the files' footers
        raise ValueError(f"{path} hasn't got the {config['rows']} vectors that were written")
    return vectors.where(F.when(F.size("emb") == config["dim"], True).otherwise(bad))


def register(stores: dict[str, DataFrame]) -> None:
    """Names for loaded tables: views of the session, which SQL and spark.table() find."""
    for name, df in stores.items():
        df.createOrReplaceTempView(name)


def load_queries(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """A JSON list of queries -> query_id (its place where it has none), query, video_id, start_time_sec, end_time_sec; an inclusive range of places, if asked for."""
    body = spark.read.option("wholetext", True).text(path)
    kind = "array<struct<query_id:long,query:string,video_id:string,start_time_sec:double,end_time_sec:double>>"
    rows = body.select(F.posexplode(F.from_json("value", kind)).alias("i", "q"))
    rows = rows.where(F.col("i").between(first or 0, last if last is not None else (1 << 31) - 1))
    return rows.select(F.coalesce("q.query_id", F.col("i").cast("long")).alias("query_id"), "q.query", "q.video_id", "q.start_time_sec", "q.end_time_sec")


def debug_boundaries(rows: DataFrame, subtitles: DataFrame, key: str, width: int = 3, most: int = 500) -> DataFrame:
    """rows (key, idx, s, e, ...) of boundaries with the texts of the `width` shots before and after, cut to `most` characters, and their numbers; subtitles (key, idx, text)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("idx")
    texts = rows.select(key, "idx").join(subtitles.select(key, "idx", "text"), [key, "idx"], "left")
    side = lambda a, b: F.filter(F.collect_list(F.nullif(F.trim("text"), F.lit(""))).over(w.rowsBetween(a, b)), lambda t: t.isNotNull())
    told = texts.select(key, "idx", side(1 - width, 0).alias("l"), side(1, width).alias("r"))
    return rows.join(told, [key, "idx"]).withColumns({"left_text": F.left(F.array_join("l", " "), F.lit(most)), "right_text": F.left(F.array_join("r", " "), F.lit(most)), "left_items": F.size("l"), "right_items": F.size("r")}).drop("l", "r")


def with_translations(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items (key columns, caption, translated or null), cache (caption, translated) -> items with `translated` from themselves, else from the cache, and `cached`; and the distinct captions that are still to be translated.

    Captions are compared trimmed; blank ones need no translation. The first translation of a caption in the order of texts counts.
    """
    columns = [c for c in items.columns if c not in ("caption", "translated")]
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    known = cache.select(F.trim("caption").alias("caption"), blank(F.col("translated")).alias("_c")).where("_c is not null").groupBy("caption").agg(F.min("_c").alias("_c"))
    rows = items.select(*columns, F.trim(F.coalesce("caption", F.lit(""))).alias("caption"), blank(F.col("translated")).alias("_own")).join(known, "caption", "left")
    out = rows.select(*columns, "caption", F.coalesce("_own", F.when(F.col("caption") != "", F.col("_c"))).alias("translated"), (F.col("_own").isNull() & F.col("_c").isNotNull() & (F.col("caption") != "")).alias("cached"))
    return out, out.where("translated is null and caption <> ''").select("caption").distinct()


def get_many(store: DataFrame, asked: DataFrame, key: str = "item_id") -> DataFrame:
    """Metadata of the ids asked for (key, place): a row each, with nulls where the store has none."""
    return asked.select(key, "place").join(store, key, "left")
