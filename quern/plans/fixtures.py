"""The tests' tables in the roles of videos: shots, subtitles, hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.tables import table

#: Common table expressions that say the same in SQL.
SQL = {
    "shots": """shots AS (
  SELECT user_id AS video, (row_number() OVER w - 1)::BIGINT AS idx, epoch_us(ts)::DOUBLE / 3.6e9::DOUBLE AS s,
    coalesce(lead(epoch_us(ts)) OVER w, epoch_us(ts) + 18000000000)::DOUBLE / 3.6e9::DOUBLE AS e, value, event_type AS kind, event_id
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""",
    "subs": """subs AS (
  SELECT user_id AS video, event_id AS sid, epoch_us(ts)::DOUBLE / 3.6e9::DOUBLE AS bs, epoch_us(ts)::DOUBLE / 3.6e9::DOUBLE + value / 10.0::DOUBLE AS be, event_type AS text
  FROM events WHERE event_type = 'purchase')""",
    "hits": """hits AS (
  SELECT event_type AS channel, user_id AS item_id, user_id // 10 AS parent, score, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id) AS rank
  FROM (SELECT event_type, user_id, round(sum(value), 2) AS score FROM events GROUP BY ALL))""",
    "frames": """frames AS (SELECT label::BIGINT AS video, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::BIGINT AS idx, vec_id, embedding AS emb FROM embeddings)""",
}


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by `video` as named here, so that what follows by video needs no further shuffle; times are worked out behind the shuffle, which carries `ts` alone."""
    w = Window.partitionBy("video").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), "ts", "event_id", "value", F.col("event_type").alias("kind"))
    rows = rows.select("*", F.row_number().over(w).alias("_n"), F.lead("ts").over(w).alias("_next"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.select(
        "video",
        (F.col("_n") - 1).cast("long").alias("idx"),
        (us("ts") / F.lit(3.6e9)).alias("s"),
        (F.coalesce(us("_next"), us("ts") + F.lit(18_000_000_000)) / F.lit(3.6e9)).alias("e"),
        "value",
        "kind",
        "event_id",
    )


def subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)
    rows = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return rows.select(F.col("user_id").alias("video"), F.col("event_id").alias("sid"), at.alias("bs"), (at + F.col("value") / 10.0).alias("be"), F.col("event_type").alias("text"))


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("channel"), F.col("user_id").alias("item_id")).agg(F.round(F.sum("value"), 2).alias("score"))
    rank = F.row_number().over(Window.partitionBy("channel").orderBy(F.desc("score"), "item_id"))
    return sums.withColumn("parent", F.floor(F.col("item_id") / 10)).withColumn("rank", rank)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video"), idx.alias("idx"), "vec_id", F.col("embedding").alias("emb"))
