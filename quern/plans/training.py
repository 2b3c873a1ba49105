"""Registered queries of training losses, index scans and searches by several models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import search, training
from quern.plans.queries import query, r6
from quern.sources import ordinals
from quern.sources import tables as src

# a vector is a sample's caption in the batch of its label; its shots are up to four vectors further on, one of five masked


def _samples(spark, sf) -> DataFrame:
    return src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").cast("long").alias("batch"), F.col("embedding").alias("emb"))


def _shots(spark, sf) -> DataFrame:
    s = _samples(spark, sf)
    k = F.explode(F.sequence(F.lit(0), (F.col("sample") % 4).cast("int"))).alias("pos")
    asked = s.select("sample", "batch", k).withColumn("_v", (F.col("sample") * 3 + F.col("pos") * 7) % 500)
    found = asked.join(s.select(F.col("sample").alias("_v"), "emb"), "_v")
    return found.select("sample", "batch", "pos", F.when(F.col("_v") % 5 != 0, F.col("emb")).alias("emb"), (F.col("pos") / 4.0).alias("overlap"))


DOT = "list_inner_product({}::DOUBLE[], {}::DOUBLE[])"
SOFT = f"""sa AS (SELECT vec_id AS sample, label::BIGINT AS batch, embedding AS emb FROM embeddings),
  sh AS (SELECT sa.sample, sa.batch, pos, CASE WHEN v.vec_id % 5 <> 0 THEN v.embedding END AS emb, pos / 4.0::DOUBLE AS overlap FROM sa, range(4) r(pos), embeddings v WHERE pos <= sa.sample % 4 AND v.vec_id = (sa.sample * 3 + pos * 7) % 500),
  lo AS (SELECT sh.sample, pos, CASE WHEN sh.emb IS NOT NULL THEN (0.8::DOUBLE * {DOT.format("sa.emb", "sh.emb")} + 0.2::DOUBLE * overlap) / 0.07::DOUBLE END AS l FROM sh JOIN sa USING (sample)),
  ex AS (SELECT sample, pos, coalesce(exp(l - max(l) OVER (PARTITION BY sample)), 0.0::DOUBLE) AS x FROM lo),
  we AS (SELECT sample, pos, CASE WHEN sum(x) OVER (PARTITION BY sample) > 0 THEN x / sum(x) OVER (PARTITION BY sample) ELSE 0.0::DOUBLE END AS weight FROM ex)"""


def _weights(spark, sf) -> DataFrame:
    return training.soft_positives(_samples(spark, sf), _shots(spark, sf))


@query(f"WITH {SOFT} SELECT sample, pos::INT AS pos, round(weight, 6) AS weight FROM we")
def soft_positive_weights(spark, sf):
    return _weights(spark, sf).select("sample", "pos", r6("weight").alias("weight"))


@query(
    f"""WITH sa AS (SELECT a.vec_id AS id, a.label::BIGINT AS batch, a.embedding AS q, b.embedding AS i FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 3 + 1) % 500),
  s AS (SELECT a.batch, a.id AS q, b.id AS i, {DOT.format("a.q", "b.i")} / 0.07::DOUBLE AS s FROM sa a JOIN sa b ON a.batch = b.batch),
  l AS (SELECT batch, q AS id, ln(sum(exp(s))) - max(s) FILTER (q = i) AS l FROM s GROUP BY batch, q UNION ALL SELECT batch, i, ln(sum(exp(s))) - max(s) FILTER (q = i) FROM s GROUP BY batch, i)
  SELECT batch, count(*) // 2 AS n, round(avg(l), 6) AS loss FROM l GROUP BY batch"""
)
def contrastive_batch_loss(spark, sf):
    s = _samples(spark, sf).withColumnRenamed("sample", "id")
    items = s.select("batch", "id", ((F.col("id") * 3 + 1) % 500).alias("_v")).join(s.select(F.col("id").alias("_v"), "emb"), "_v")
    return training.contrastive_loss(s, items).select("batch", "n", r6("loss").alias("loss"))


@query(
    f"""WITH {SOFT}, li AS (SELECT * FROM sh WHERE emb IS NOT NULL), q AS (SELECT * FROM sa WHERE (batch, sample) IN (SELECT batch, sample FROM li)),
  ls AS (SELECT q.batch, q.sample, ln(sum(exp({DOT.format("q.emb", "li.emb")} / 0.07::DOUBLE))) AS l FROM q JOIN li ON li.batch = q.batch GROUP BY ALL),
  ta AS (SELECT q.batch, q.sample, sum(weight) AS w, sum(weight * {DOT.format("q.emb", "li.emb")} / 0.07::DOUBLE) AS x, avg({DOT.format("q.emb", "li.emb")} / 0.07::DOUBLE) AS m FROM q JOIN li USING (batch, sample) JOIN we USING (sample, pos) GROUP BY ALL)
  SELECT batch, count(*) AS n, round(avg(l - CASE WHEN w > 0 THEN x / w ELSE m END), 6) AS loss FROM ls JOIN ta USING (batch, sample) GROUP BY batch"""
)
def multi_positive_shot_loss(spark, sf):
    return training.shot_loss(_samples(spark, sf), _shots(spark, sf), _weights(spark, sf)).select("batch", "n", r6("loss").alias("loss"))


@query(
    f"""WITH {SOFT}, p AS (SELECT sample, p, sum(weight * emb[p]::DOUBLE) AS y FROM (SELECT * FROM sh JOIN we USING (sample, pos) WHERE emb IS NOT NULL), range(1, 65) r(p) GROUP BY ALL),
  c AS (SELECT sa.batch, sample, sum(emb[p]::DOUBLE * y) / greatest(sqrt(sum(emb[p]::DOUBLE * emb[p]::DOUBLE)) * sqrt(sum(y * y)), 1e-8::DOUBLE) AS c FROM sa JOIN p USING (sample) GROUP BY ALL)
  SELECT sa.batch, round(1 - avg(c), 6) AS loss FROM sa LEFT JOIN c USING (batch, sample) GROUP BY sa.batch"""
)
def event_consistency_loss(spark, sf):
    shots, s = _shots(spark, sf), _samples(spark, sf)
    both = s.join(training.weighted_summary(shots, _weights(spark, sf)), "sample", "left")
    return training.consistency_loss(both, "emb", "summary").select("batch", r6("loss").alias("loss"))


# index scans


@query("SELECT (row_number() OVER (ORDER BY label::VARCHAR, vec_id * 7 % 1000, vec_id) - 1)::BIGINT AS index_id, label::VARCHAR AS video, vec_id * 7 % 1000 AS frame, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings")
def keyframe_index_scan(spark, sf):
    """A file of features a video, from its frames' vectors."""
    rows = src.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("video"), (F.col("vec_id") * 7 % 1000).alias("frame"), "vec_id", "embedding")
    listed = F.array_sort(F.collect_list(F.struct("frame", "vec_id", "embedding")))
    files = rows.groupBy("video").agg(listed.alias("x")).select("video", F.transform("x", lambda r: r["frame"]).alias("frames"), F.transform("x", lambda r: r["embedding"]).alias("embeddings"))
    return ordinals.keyframe_index(files).select("index_id", "video", "frame", F.round(F.col("emb")[0].cast("double"), 5).alias("first"))


@query(
    """WITH i AS (SELECT conv_id AS video, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE trim(text) <> '' AND turn % 4 <> 3)
  SELECT (row_number() OVER (ORDER BY video, n) - 1)::BIGINT AS index_id, video, n AS subtitle_id, turn * 100 AS first, length(text) AS chars FROM i"""
)
def subtitle_index_scan(spark, sf):
    v = src.table(spark, sf, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("e"))
    c = src.table(spark, sf, "conversations").crossJoin(F.broadcast(v))  # one row
    items = c.select(F.col("conv_id").alias("video"), F.col("turn").cast("long").alias("ord"), (F.col("turn") * 100).cast("long").alias("first"), (F.col("turn") * 100 + 90).cast("long").alias("last"), "text", F.when(F.col("turn") % 4 != 3, F.col("e")).alias("emb"))
    return ordinals.subtitle_index(items).select("index_id", "video", "subtitle_id", "first", F.length("text").cast("long").alias("chars"))


# several models: the vectors, and the same reversed for two of three


MODELS = ["a", "b"]
MODEL_HITS = f"""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS a, CASE WHEN vec_id % 3 <> 0 THEN list_reverse(list_transform(embedding::DOUBLE[], lambda x, i: x * (i % 3))) END AS b FROM embeddings),
  q AS (SELECT vec_id AS query_id, a, list_reverse(list_transform(a, lambda x, i: x * (i % 2))) AS b FROM m WHERE vec_id % 100 = 0),
  h AS (SELECT query_id, 'a' AS channel, vec_id AS item_id, list_inner_product(q.a, m.a) AS score FROM q, m UNION ALL SELECT query_id, 'b', vec_id, list_inner_product(q.b, m.b) FROM q, m WHERE m.b IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY score DESC, item_id) AS rank FROM h QUALIFY rank <= 50)"""


def _model_hits(spark, sf) -> DataFrame:
    scaled = lambda by: F.reverse(F.transform("embedding", lambda x, i: x.cast("double") * ((i + 1) % by)))
    e = src.table(spark, sf, "embeddings")
    vectors = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("a"), F.when(F.col("vec_id") % 3 != 0, scaled(3)).alias("b"))
    asked = e.where("vec_id % 100 = 0")
    emb = F.transform("embedding", lambda x: x.cast("double"))
    queries = asked.select(F.col("vec_id").alias("query_id"), F.lit("a").alias("model"), emb.alias("emb")).unionByName(asked.select(F.col("vec_id").alias("query_id"), F.lit("b").alias("model"), scaled(2).alias("emb")))
    return search.model_knn(vectors, queries, MODELS, 50)


@query(MODEL_HITS + " SELECT query_id, channel, item_id, round(score, 6) AS score, rank FROM r")
def model_knn(spark, sf):
    return _model_hits(spark, sf).select("query_id", "channel", "item_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    MODEL_HITS
    + """, f AS (SELECT query_id, item_id, coalesce(max(exp(-0.5::DOUBLE * (rank - 1) / 50.0::DOUBLE)) FILTER (channel = 'a'), exp(-1.0::DOUBLE)) AS a, coalesce(max(exp(-0.5::DOUBLE * (rank - 1) / 50.0::DOUBLE)) FILTER (channel = 'b'), exp(-1.0::DOUBLE)) AS b FROM r GROUP BY ALL)
  SELECT query_id, item_id, round(2 * a * b / (a + b), 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(2 * a * b / (a + b), 9) DESC, item_id) AS rank FROM f QUALIFY rank <= 50"""
)
def model_fusion(spark, sf):
    return search.model_fusion(_model_hits(spark, sf), MODELS, 50).select("query_id", "item_id", r6("fused").alias("fused"), F.col("rank").cast("long").alias("rank"))
