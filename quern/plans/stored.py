"""Registered queries of mapping bundles, translation caches and server ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import search
from quern.plans import fixtures as fx
from quern.plans.queries import query, r6
from quern.sources import stores
from quern.sources import tables as src


def metadata(spark, sf):
    """Four shots an event; every third shot has an OCR text."""
    s = fx.shots(spark, sf).select("video", F.col("idx").alias("shot"), "s", "e", "event_id")
    events = s.groupBy("video", F.floor(F.col("shot") / 4).alias("event")).agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_sort(F.collect_list("shot")).alias("shots"))
    subs = fx.subtitles(spark, sf).select("video", F.col("bs").alias("s"), F.col("be").alias("e"), F.col("sid").cast("string").alias("text"))
    ocr = s.where("event_id % 3 = 0").select(F.concat_ws("-", F.lit("ocr"), "event_id").alias("ocr_id"), "video", F.concat_ws(":", "video", "shot").alias("shot_id"))
    return src.load_metadata(events, s.drop("event_id"), subs), ocr


@query(
    """, ev AS (SELECT video, idx // 4 AS event, min(s) AS s, max(e) AS e FROM shots GROUP BY ALL),
  su AS (SELECT video, row_number() OVER (PARTITION BY video ORDER BY bs, be, sid::VARCHAR) - 1 AS n, bs, be FROM subs)
  SELECT 'subtitle' AS channel, su.video || ':' || n AS item_id, ev.video || ':' || event AS target, round((least(e, be) - greatest(s, bs)) / greatest(be - bs, 1e-6::DOUBLE), 6) AS weight FROM su JOIN ev ON su.video = ev.video AND least(e, be) - greatest(s, bs) > 0
  UNION ALL SELECT 'ocr', 'ocr-' || event_id, video || ':' || (idx // 4), 1.0::DOUBLE FROM shots WHERE event_id % 3 = 0""",
    "shots",
    "subs",
)
def mapping_bundle(spark, sf):
    """The edges of a bundle that searches by events expand their hits by."""
    return stores.search_edges(stores.build_mappings(*metadata(spark, sf)), "event_id").select("channel", "item_id", "target", r6("weight").alias("weight"))


@query(
    """WITH i AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS caption, CASE WHEN turn % 3 = 0 THEN nullif(trim('EN ' || text), '') END AS own FROM conversations),
  c AS (SELECT trim(text) AS caption, min(nullif(trim(role || ' ' || text), '')) AS t FROM conversations WHERE conv_id % 2 = 0 AND text IS NOT NULL AND role IS NOT NULL GROUP BY ALL)
  SELECT conv_id, turn, coalesce(own, CASE WHEN i.caption <> '' THEN t END) AS translated, own IS NULL AND t IS NOT NULL AND i.caption <> '' AS cached FROM i LEFT JOIN c USING (caption)"""
)
def translation_cache(spark, sf):
    c = src.table(spark, sf, "conversations")
    items = c.select("conv_id", "turn", F.col("text").alias("caption"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("EN "), "text")).alias("translated"))
    cache = c.where("conv_id % 2 = 0 and text is not null and role is not null").select(F.col("text").alias("caption"), F.concat_ws(" ", "role", "text").alias("translated"))
    return src.with_translations(items, cache)[0].select("conv_id", "turn", "translated", "cached")


@query("SELECT channel, item_id, round(CASE WHEN item_id % 3 = 0 THEN score ELSE greatest(20 - rank + 1, 1) / 20.0::DOUBLE END, 6) AS score FROM hits", "hits")
def server_ranked(spark, sf):
    own = F.when(F.col("item_id") % 3 == 0, F.col("score"))
    return fx.hits(spark, sf).select("channel", "item_id", r6(search.server_score(own, F.col("rank"), 20)).alias("score"))
