"""Registered queries of searches in stages: keyframes by several channels, shot chains inside pooling search, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import evaluate, search, stages
from quern.plans import fold_sql
from quern.plans.queries import BM25, DOT, query, r6
from quern.plans.retrieval import HITS, _event_edges, _hierarchy, _pool_hits, _shot_edges
from quern.sources import tables as src

# keyframes: fifty vectors a video; a stage asks by vectors (text, image) and by BM25 (OCR texts at keyframes, subtitles over ranges)


def _place(i):
    return (i % 50 * 40 + i % 7).cast("long")


def _asks(spark, sf) -> DataFrame:
    """Every hundredth vector is a query of one to four stages -> query_id, n."""
    v = src.table(spark, sf, "embeddings").where("vec_id % 100 = 0")
    return v.select(F.col("vec_id").alias("query_id"), (1 + F.floor(F.col("vec_id") / 100) % 4).alias("n"))


def _stages(asks: DataFrame) -> DataFrame:
    return asks.select("query_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("stage"))


def _asked(spark, sf) -> DataFrame:
    j = F.col("stage")
    channels = F.array_compact(F.array(F.lit("text"), F.when(j % 2 == 1, F.lit("image")), F.when(j % 2 == 0, F.lit("ocr")), F.when(j % 3 == 0, F.lit("subtitle"))))
    return _stages(_asks(spark, sf)).select("query_id", "stage", F.explode(channels).alias("channel"))


def _keyframe_hits(spark, sf) -> DataFrame:
    v = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("emb"))
    asked, out = _asked(spark, sf), None
    at = lambda i: (F.floor(i / 50).alias("video"), _place(i).alias("place"))
    for channel, shift in (("text", 1), ("image", 2)):
        who = asked.where(F.col("channel") == channel).select((F.col("query_id") * 10 + F.col("stage")).alias("query_id"), (F.col("query_id") + 3 * F.col("stage") + shift).alias("item_id"))
        found = search.knn(v, who.join(v, "item_id").select("query_id", "emb"), 60)
        part = found.select(F.floor(F.col("query_id") / 10).alias("query_id"), (F.col("query_id") % 10).alias("stage"), F.lit(channel).alias("channel"), *at(F.col("item_id")), F.round("score", 9).alias("score"))
        out = part if out is None else out.unionByName(part)
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    texts = src.table(spark, sf, "benchmark").where("item_id < 40").select(F.col("item_id").alias("query_id"), "text")
    told = search.bm25(docs, texts, 50).select(F.col("query_id").cast("long").alias("item"), "doc_id", F.round("score", 6).alias("score"))
    asks = asked.withColumn("item", (F.floor(F.col("query_id") / 100) + F.col("stage")) % 40)
    ocr = asks.where("channel = 'ocr'").join(told, "item").select("query_id", "stage", "channel", *at(F.col("doc_id") % 500), "score")
    subs = docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("sid"), F.floor(F.col("doc_id") % 500 / 50).alias("video"), (F.col("doc_id") % 50 * 40 - 30).alias("first"), (F.col("doc_id") % 50 * 40 - 30 + F.col("doc_id") % 90).alias("last"))
    met = asks.where("channel = 'subtitle'").join(told.withColumnRenamed("doc_id", "sid"), "item").select("query_id", "stage", "sid", "score")
    frames = v.select(*at(F.col("item_id")))
    return out.unionByName(ocr).unionByName(stages.subtitle_places(met, subs, frames))


AT = "{0} // 50 AS video, ({0} % 50 * 40 + {0} % 7) AS place"
FUSED = f"""{BM25.replace("scored AS", "bms AS")},
  told AS (SELECT query_id AS item, doc_id, round(score, 6) AS score FROM bms WHERE score > 0 AND query_id < 40 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bms.score, 9) DESC, doc_id) <= 50),
  asks AS (SELECT vec_id AS query_id, 1 + vec_id // 100 % 4 AS n FROM embeddings WHERE vec_id % 100 = 0), st AS (SELECT query_id, n, j AS stage FROM asks, range(4) r(j) WHERE j < n),
  kf AS (SELECT {AT.format("vec_id")} FROM embeddings), sb AS (SELECT doc_id AS sid, doc_id % 500 // 50 AS video, doc_id % 50 * 40 - 30 AS lo, doc_id % 50 * 40 - 30 + doc_id % 90 AS hi FROM documents WHERE doc_id % 3 = 0),
  rg AS (SELECT sid, video, least(lo, hi) AS a, greatest(lo, hi) AS b FROM sb WHERE lo <> -1 AND hi <> -1), ri AS (SELECT sid, rg.video, place FROM rg JOIN kf ON kf.video = rg.video AND place BETWEEN a AND b),
  rp AS (SELECT * FROM ri UNION ALL SELECT sid, video, place FROM (SELECT sid, rg.video, place, row_number() OVER (PARTITION BY sid ORDER BY abs(place - (a + b) / 2.0::DOUBLE), place DESC) AS i FROM rg JOIN kf ON kf.video = rg.video WHERE sid NOT IN (SELECT sid FROM ri)) WHERE i = 1),
  kh AS (SELECT query_id, stage, 'text' AS channel, video, place, score FROM (SELECT query_id, stage, {AT.format("v.vec_id")}, round({DOT}, 9) AS score FROM st JOIN embeddings q ON q.vec_id = query_id + 3 * stage + 1, embeddings v QUALIFY row_number() OVER (PARTITION BY query_id, stage ORDER BY {DOT} DESC, v.vec_id) <= 60)
    UNION ALL SELECT query_id, stage, 'image', video, place, score FROM (SELECT query_id, stage, {AT.format("v.vec_id")}, round({DOT}, 9) AS score FROM st JOIN embeddings q ON q.vec_id = query_id + 3 * stage + 2, embeddings v WHERE stage % 2 = 1 QUALIFY row_number() OVER (PARTITION BY query_id, stage ORDER BY {DOT} DESC, v.vec_id) <= 60)
    UNION ALL SELECT query_id, stage, 'ocr', {AT.format("(doc_id % 500)")}, score FROM st JOIN told ON item = (query_id // 100 + stage) % 40 WHERE stage % 2 = 0
    UNION ALL SELECT query_id, stage, 'subtitle', video, place, score FROM st JOIN told ON item = (query_id // 100 + stage) % 40 JOIN rp ON sid = doc_id WHERE stage % 3 = 0),
  nm AS (SELECT query_id, stage, channel, video, place, CASE WHEN score = 0 THEN 0.0::DOUBLE WHEN m > 0 THEN score / m ELSE 1.0::DOUBLE END AS x FROM (SELECT *, max(score) OVER (PARTITION BY query_id, stage, channel) AS m FROM (SELECT query_id, stage, channel, video, place, max(score) AS score FROM kh GROUP BY ALL))),
  pv AS (SELECT query_id, stage, video, place, coalesce(max(x) FILTER (channel = 'text'), 0.0::DOUBLE) AS tx, coalesce(max(x) FILTER (channel = 'image'), 0.0::DOUBLE) AS im, coalesce(max(x) FILTER (channel = 'ocr'), 0.0::DOUBLE) AS oc, coalesce(max(x) FILTER (channel = 'subtitle'), 0.0::DOUBLE) AS su FROM nm GROUP BY ALL)"""


def _fused_sql(text: float, image: float, ocr: float, subtitle: float) -> str:
    """Expressions `fs`: places of each stage with their score, by these base weights."""
    i, o, s = f"CASE WHEN stage % 2 = 1 THEN {image}::DOUBLE ELSE 0.0::DOUBLE END", f"CASE WHEN stage % 2 = 0 THEN {ocr}::DOUBLE ELSE 0.0::DOUBLE END", f"CASE WHEN stage % 3 = 0 THEN {subtitle}::DOUBLE ELSE 0.0::DOUBLE END"
    total = f"({text}::DOUBLE + {i} + {o} + {s})"
    return f"""fr AS (SELECT *, {i} / {total} * im + {o} / {total} * oc + {s} / {total} * su + {text}::DOUBLE / {total} * tx AS raw FROM pv),
  fs AS (SELECT query_id, stage, video, place, raw / max(raw) OVER (PARTITION BY query_id, stage) AS score, tx, oc, su FROM fr WHERE raw > 0)"""


@query(
    f"""WITH {FUSED}, {_fused_sql(0.45, 0.0, 0.35, 0.20)} SELECT query_id, stage, video, place, round(score, 6) AS score, round(tx, 6) AS visual, round(oc, 6) AS ocr, round(su, 6) AS subtitle,
    row_number() OVER (PARTITION BY query_id, stage ORDER BY round(score, 9) DESC, video, place) AS rank FROM fs QUALIFY rank <= 20"""
)
def stage_search(spark, sf):
    found = stages.stage_search(_keyframe_hits(spark, sf), _asked(spark, sf), 20)
    return found.select("query_id", "stage", "video", "place", *(r6(c).alias(c) for c in ("score", "visual", "ocr", "subtitle")), F.col("rank").cast("long").alias("rank"))


KEYFRAME_CHAINS = f"""WITH RECURSIVE {FUSED}, {_fused_sql(0.4, 0.15, 0.3, 0.15)}, scored AS (SELECT fs.* FROM fs JOIN asks USING (query_id) WHERE n > 1),
  {fold_sql.stage_supports(4, 1500, 100)}, {fold_sql.stage_chains(4, 30)},
  every AS (SELECT query_id, video, session, score, matched, skipped, chain, total FROM chains UNION ALL SELECT query_id, video, place, score, 1::INT, 0::INT, '0:' || place, score FROM fs JOIN asks USING (query_id) WHERE n = 1),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, round(score, 9) DESC, video, session)::INT AS rank FROM every QUALIFY rank <= 10)"""


def _keyframe_chains(spark, sf) -> DataFrame:
    return stages.temporal_search(_keyframe_hits(spark, sf), _asked(spark, sf), 10)


@query(KEYFRAME_CHAINS + " SELECT query_id, video, round(score, 6) AS score, matched, skipped, chain, round(total, 6) AS total, rank FROM best")
def keyframe_temporal_search(spark, sf):
    hops = F.array_join(F.transform("chain", lambda h: F.concat(h["stage"].cast("string"), F.lit(":"), h["place"].cast("string"))), ">")
    total = F.aggregate("chain", F.lit(0.0), lambda a, h: a + h["score"])
    return _keyframe_chains(spark, sf).select("query_id", "video", r6("score").alias("score"), "matched", "skipped", hops.alias("chain"), r6(total).alias("total"), "rank")


@query(
    KEYFRAME_CHAINS
    + """, hp AS (SELECT query_id, rank, video, CASE WHEN query_id // 100 % 4 = 0 THEN true ELSE false END AS single, min(p) AS lo, max(p) AS hi FROM (SELECT *, split_part(unnest(string_split(chain, '>')), ':', 2)::BIGINT AS p FROM best) GROUP BY ALL),
  tm AS (SELECT query_id, rank, video, single, fps, lo / fps AS s, hi / fps AS e FROM (SELECT *, CASE WHEN video % 7 <> 6 THEN (25 + video % 3)::DOUBLE END AS fps FROM hp)),
  rk AS (SELECT query_id, min(rank) AS video_rank, min(rank) FILTER (CASE WHEN single THEN s BETWEEN 4 AND 30 ELSE least(e, 30.0::DOUBLE) > greatest(s, 4.0::DOUBLE) END) AS first
    FROM tm WHERE (single OR fps IS NOT NULL) AND video = query_id // 50 + query_id // 100 % 2 GROUP BY ALL)
  SELECT query_id, video_rank, first FROM asks LEFT JOIN rk USING (query_id)"""
)
def keyframe_evaluation(spark, sf):
    """The search's results as the JSON that its evaluator reads, with frame rates of most videos, against a truth of one interval a query."""
    hop = lambda h: F.concat(F.lit('[["'), F.col("video").cast("string"), F.lit('",'), h["place"].cast("string"), F.lit("],"))
    single = F.concat(hop(F.col("chain")[0]), F.col("score").cast("string"), F.lit("]"))
    chain = F.concat(F.lit("["), F.array_join(F.transform("chain", lambda h: F.concat(hop(h), F.lit("[[],"), F.col("score").cast("string"), F.lit(","), h["stage"].cast("string"), F.lit("]]"))), ","), F.lit("]"))
    found = _keyframe_chains(spark, sf).join(_asks(spark, sf), "query_id")
    rows = found.select("query_id", "rank", F.when(F.col("n") == 1, "single-stage").otherwise("multi-stage").alias("mode"), F.when(F.col("n") == 1, single).otherwise(chain).alias("result"))
    videos = src.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("video")).distinct().where("video % 7 <> 6")
    fps = evaluate.fps_map(videos.select(F.to_json(F.create_map(F.col("video").cast("string"), (25 + F.col("video") % 3).cast("double"))).alias("body")))
    q = F.col("query_id")
    truth = _asks(spark, sf).select("query_id", (F.floor(q / 50) + F.floor(q / 100) % 2).alias("video"), F.lit(4.0).alias("s"), F.lit(30.0).alias("e"))
    return evaluate.keyframe_ranks(rows, fps, truth).select("query_id", F.col("video_rank").cast("long").alias("video_rank"), F.col("first").cast("long").alias("first"))


# pooling search with chains of shots: a query has two or three stages, each a vector and a share of its texts' hits


def _pool_stages(spark, sf) -> tuple[DataFrame, DataFrame]:
    """asks (query_id, n), and stage_vectors (query_id, stage, emb)."""
    v = src.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("emb"))
    asks = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), (2 + F.floor(F.col("vec_id") / 100) % 2).alias("n"))
    return asks, _stages(asks).withColumn("vec_id", F.col("query_id") + 5 * F.col("stage") + 1).join(v, "vec_id").select("query_id", "stage", "emb")


def _pooled(spark, sf) -> tuple[DataFrame, DataFrame]:
    hits = _pool_hits(spark, sf)
    v = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("emb"))
    asked = v.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "emb")
    asks, vectors = _pool_stages(spark, sf)
    texts = hits.where("channel in ('subtitle', 'ocr')").join(asks, "query_id").select("query_id", (F.col("rank") % F.col("n")).alias("stage"), "channel", "item_id", "rank")
    i = F.col("vec_id")
    order = src.table(spark, sf, "embeddings").select(i.alias("shot_id"), F.floor(i / 5).alias("event_id"), F.floor(i / 50).alias("video"), (i % 50).alias("place"))
    return stages.pooled_search(hits, _event_edges(spark, sf), _shot_edges(spark, sf), _hierarchy(spark, sf), v, asked, asks, vectors, texts, order)


POOLED_CHAINS = (
    HITS.replace("WITH a AS", "WITH RECURSIVE a AS", 1)
    + f""", asks AS (SELECT vec_id AS query_id, 2 + vec_id // 100 % 2 AS n FROM embeddings WHERE vec_id % 100 = 0), st AS (SELECT query_id, n, j AS stage FROM asks, range(3) r(j) WHERE j < n),
  ssv AS (SELECT query_id, stage, shot_id, row_number() OVER (PARTITION BY query_id, stage ORDER BY round({DOT}, 9) DESC, shot_id) AS rank FROM st JOIN al USING (query_id) JOIN embeddings q ON q.vec_id = query_id + 5 * stage + 1 JOIN embeddings v ON v.vec_id = shot_id QUALIFY rank <= 100),
  ssx AS (SELECT query_id, stage, shot_id, 0.45::DOUBLE / (60.0::DOUBLE + rank) AS x FROM ssv UNION ALL SELECT hs.query_id, hs.rank % n, target, CASE c WHEN 2 THEN 0.2::DOUBLE ELSE 0.35::DOUBLE END * w / (60.0::DOUBLE + rank) FROM hs JOIN asks USING (query_id)),
  ssc AS (SELECT query_id, stage, shot_id, round(sum(x), 12) AS score FROM ssx WHERE (query_id, shot_id) IN (SELECT query_id, shot_id FROM al) GROUP BY ALL),
  scored AS (SELECT query_id, stage, shot_id // 50 AS video, shot_id % 50 AS place, score FROM ssc QUALIFY row_number() OVER (PARTITION BY query_id, stage ORDER BY round(score, 9) DESC, shot_id) <= 100),
  {fold_sql.stage_supports(3, 12, 3)}, {fold_sql.stage_chains(3, 1)},
  tc AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, skipped, round(score, 9) DESC, video, session)::INT AS rank FROM chains QUALIFY rank <= 30)"""
)


@query(POOLED_CHAINS + " SELECT query_id, video, round(score, 6) AS score, matched, skipped, chain, rank FROM tc")
def shot_chain_search(spark, sf):
    _, found = _pooled(spark, sf)
    hops = F.array_join(F.transform("chain", lambda h: F.concat(h["stage"].cast("string"), F.lit(":"), h["place"].cast("string"))), ">")
    return found.select("query_id", "video", r6("score").alias("score"), "matched", "skipped", hops.alias("chain"), "rank")


@query(
    POOLED_CHAINS
    + """, sh AS (SELECT query_id, target AS shot_id, target // 5 AS event_id, sum(x) AS x FROM (
    SELECT query_id, shot_id AS target, 0.8::DOUBLE / (60.0::DOUBLE + rank) AS x FROM sv UNION ALL SELECT query_id, target, CASE c WHEN 2 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * w / (60.0::DOUBLE + rank) FROM hs) GROUP BY ALL),
  sp AS (SELECT sh.query_id, shot_id, sh.event_id, x + coalesce(0.2::DOUBLE * ev.score, 0.0::DOUBLE) AS score FROM sh LEFT JOIN ev USING (query_id, event_id)),
  hp AS (SELECT query_id, video, score, unnest(string_split(chain, '>')) AS h FROM tc),
  ch AS (SELECT query_id, (video * 50 + split_part(h, ':', 2)::BIGINT) // 5 AS event_id, sum(score) AS chain FROM hp GROUP BY ALL),
  best AS (SELECT query_id, event_id, max(score) AS score FROM sp GROUP BY ALL),
  al2 AS (SELECT query_id, event_id, coalesce(ev.score, 0.0::DOUBLE) + coalesce(best.score, 0.0::DOUBLE) + coalesce(chain, 0.0::DOUBLE) AS score, chain IS NOT NULL AS in_chain FROM ev FULL JOIN best USING (query_id, event_id) FULL JOIN ch USING (query_id, event_id))
  SELECT query_id, event_id, round(score, 6) AS score, in_chain, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, event_id) AS rank FROM al2 QUALIFY rank <= 30"""
)
def pooled_search_chains(spark, sf):
    """Pooling search whose final events take in the chains of shots that its stages form."""
    events, _ = _pooled(spark, sf)
    return events.select("query_id", "event_id", r6("score").alias("score"), (F.size("chains") > 0).alias("in_chain"), F.col("rank").cast("long").alias("rank"))
