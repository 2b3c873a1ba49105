"""Dense numbers in a global order, and the scans that build search indexes with them.

Rows are dealt to ranges between bounds that are drawn once from a bounded
sample, so that every later pass deals them alike; a range's rows are numbered
within it, after the rows of all ranges before. No pass puts all rows into one
task, and what the driver holds is a number a range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 4096  # rows that the bounds are drawn from, at most


def dense_ordinals(df: DataFrame, order: list[str], name: str = "index_id", ranges: int | None = None) -> DataFrame:
    """df with `name`: 0, 1, ... in the order of the columns (nulls first), which must tell rows apart for reruns to agree."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*(F.struct(F.col(c).isNotNull().alias("there"), F.col(c).alias("value")).alias(f"k{i}") for i, c in enumerate(order)))
    keyed = df.withColumn("_key", key)
    step = max(1, SAMPLE // n)
    sample = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(SAMPLE)
    bounds = sample.agg(F.filter(F.array_sort(F.collect_list("_key")), lambda b, i: i % step == step - 1).alias("_bounds"))  # one row, of about n bounds
    placed = keyed.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col("_key")))).drop("_bounds")
    counts = placed.groupBy("_range").count().collect()  # a row a range
    before, offsets = 0, []
    for r in sorted(counts):
        offsets.append((r["_range"], before))
        before += r["count"]
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    start = F.broadcast(spark.createDataFrame(offsets, "_range int, _start long"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1
    out = placed.withColumn("_place", place).join(start, "_range").withColumn(name, (F.col("_start") + F.col("_place")).cast("long"))
    return out.select(*df.columns, name)


def keyframe_index(features: DataFrame) -> DataFrame:
    """features (video, frames, embeddings: as many) -> index_id, video, frame, emb (unit): ids in the order of video and frame. Unequal numbers and an empty video raise when read."""
    bad = lambda text: F.raise_error(F.concat(F.lit(text), F.coalesce("video", F.lit("")))).cast("boolean")
    ok = F.when(F.coalesce("video", F.lit("")) == "", bad("a row without a video")).when(F.coalesce(F.size("frames") != F.size("embeddings"), F.lit(True)), bad("frames and vectors differ in number: ")).otherwise(True)
    zipped = F.arrays_zip(F.col("frames").alias("frame"), F.col("embeddings").alias("emb"))
    rows = features.where(ok).select("video", F.posexplode(zipped).alias("pos", "x")).select("video", F.col("x.frame").cast("long").alias("frame"), "pos", F.col("x.emb").alias("emb"))
    from quern.functions.vectors import l2_normalize

    return dense_ordinals(rows, ["video", "frame", "pos"]).select("index_id", "video", "frame", l2_normalize(F.col("emb")).alias("emb"))


def subtitle_index(items: DataFrame) -> DataFrame:
    """items (video, ord, first, last, text, emb) of sources.text_items() -> index_id, video, subtitle_id (its place among the video's that stay), first, last, text, emb (unit). Items without a vector or with blank text go."""
    from quern.functions.vectors import l2_normalize

    live = items.where("emb is not null and trim(text) <> ''")
    own = (F.row_number().over(Window.partitionBy("video").orderBy("ord")) - 1).cast("long")
    rows = live.withColumn("subtitle_id", own)
    return dense_ordinals(rows, ["video", "subtitle_id"]).select("index_id", "video", "subtitle_id", "first", "last", "text", l2_normalize(F.col("emb")).alias("emb"))
