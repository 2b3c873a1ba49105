"""Registered queries over the tests' tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vectors as vx
from quern.operators import boundary, evaluate, folds, fuzzy, intervals, pooling, search, shots
from quern.plans import fixtures as fx
from quern.plans import fold_sql
from quern.plans.fixtures import SQL as CTE
from quern.sources import tables as src

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(CTE[c] for c in ctes)} " if ctes else "") + sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("emb"), "label")


def _asked(v: DataFrame, which: str = "item_id % 100 = 0") -> DataFrame:
    """A search's queries: every hundredth vector, unless told."""
    return v.where(which).select(F.col("item_id").alias("query_id"), "emb")


DOT = "list_inner_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _knn_sql(k: int, where: str = "true", which: str = "q.vec_id % 100 = 0") -> str:
    return f"""SELECT query_id, item_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS item_id, {DOT} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DOT} DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE {which} AND {where}) WHERE rank <= {k}"""


def _ranked(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


# search


@query(_knn_sql(10, which="q.vec_id = 0"))
def vec_knn(spark, sf):
    v = _vectors(spark, sf)
    return _ranked(search.knn(v, _asked(v, "item_id = 0"), 10), "query_id", "item_id")


@query(_knn_sql(5, "v.label IN (1, 2)"))
def vec_subset_knn(spark, sf):
    v = _vectors(spark, sf)
    return _ranked(search.subset_knn(v, _asked(v), v.where("label IN (1, 2)"), 5), "query_id", "item_id")


@query(_knn_sql(20))
def vec_batch_knn(spark, sf):
    v = _vectors(spark, sf)
    return _ranked(search.knn(v, _asked(v), 20), "query_id", "item_id")


SPACE = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
TOKENS = r"[\p{L}\p{N}_\p{M}]+"
BM25 = rf"""d AS (SELECT doc_id, regexp_extract_all(lower(text), '{TOKENS}') AS t FROM documents),
  p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) GROUP BY ALL),
  n AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
  qt AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) AS term FROM benchmark) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
  scored AS (SELECT query_id, doc_id, sum(qf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
    FROM qt JOIN p USING (term) JOIN df USING (term), n GROUP BY ALL)"""


@query(f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10")
def bm25_topk(spark, sf):
    found = search.bm25(src.table(spark, sf, "documents").select("doc_id", "text"), src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 10)
    return _ranked(found, "query_id", "doc_id")


@query(rf"SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{TOKENS}')) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def term_statistics(spark, sf):
    postings, _ = search.term_stats(src.table(spark, sf, "documents").select("doc_id", "text"))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query()
def fuzzy_topk(spark, sf):
    b = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = src.table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")  # pure Python scores: whole documents would take hours
    return _ranked(search.fuzzy_search(docs, b, 5, grams=5, recall=20), "query_id", "doc_id")


@query()
def fuzzy_documents(spark, sf):
    """Every benchmark text whose id is divisible by 100 against all whole documents; a match has a score of 0.8 or more."""
    asked = src.table(spark, sf, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "text")
    return _ranked(fuzzy.fuzzy_best(src.table(spark, sf, "documents").select("doc_id", "text"), asked, 5, at_least=0.8), "query_id", "doc_id")


EVENTS_W = {"click": 1.0, "view": 0.8, "signup": 0.6, "purchase": 0.4}
CASE_E = "CASE channel WHEN 'click' THEN 1.0::DOUBLE WHEN 'view' THEN 0.8::DOUBLE WHEN 'signup' THEN 0.6::DOUBLE WHEN 'purchase' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"SELECT item_id, round(sum({CASE_E} / (60.0::DOUBLE + rank)), 6) AS score FROM hits GROUP BY item_id", "hits")
def rrf_event_fusion(spark, sf):
    return search.accumulate(fx.hits(spark, sf), ["item_id"], EVENTS_W).select("item_id", r6("score").alias("score"))


SHOTS_W = {"view": 0.8, "signup": 0.6, "purchase": 0.4}
CASE_S = "CASE channel WHEN 'view' THEN 0.8::DOUBLE WHEN 'signup' THEN 0.6::DOUBLE WHEN 'purchase' THEN 0.4::DOUBLE ELSE 0.0::DOUBLE END"


@query(
    f""", ev AS (SELECT parent AS event_id, sum({CASE_E} / (60.0::DOUBLE + rank)) AS score FROM (SELECT channel, parent, min(rank) AS rank FROM hits GROUP BY ALL) GROUP BY parent),
  sh AS (SELECT item_id, parent, sum({CASE_S} / (60.0::DOUBLE + rank)) AS score FROM hits GROUP BY ALL)
  SELECT item_id AS shot_id, event_id, round(sh.score + 0.2::DOUBLE * ev.score, 6) AS score FROM sh JOIN ev ON parent = event_id""",
    "hits",
)
def rrf_shot_fusion_with_prior(spark, sf):
    h = fx.hits(spark, sf)
    events = search.accumulate(h.groupBy("channel", "parent").agg(F.min("rank").alias("rank")), ["parent"], EVENTS_W).select(F.col("parent").alias("event_id"), "score")
    touched = search.accumulate(h, ["item_id", "parent"], SHOTS_W).select(F.col("item_id").alias("shot_id"), F.col("parent").alias("event_id"), "score")
    return search.with_prior(touched, events).select("shot_id", "event_id", r6("score").alias("score"))


@query(
    """, n AS (SELECT item_id, channel, score / max(score) OVER (PARTITION BY channel) AS x FROM hits WHERE score > 0),
  f AS (SELECT item_id, sum(x * CASE channel WHEN 'click' THEN 0.4::DOUBLE WHEN 'view' THEN 0.3::DOUBLE WHEN 'signup' THEN 0.15::DOUBLE WHEN 'purchase' THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END) AS fused FROM n GROUP BY item_id)
  SELECT item_id, round(fused / max(fused) OVER (), 6) AS fused FROM f WHERE fused > 0""",
    "hits",
)
def maxnorm_channel_fusion(spark, sf):
    w = search.channel_weights({"click": 0.4, "view": 0.3, "signup": 0.15, "purchase": 0.15}, ["click", "view", "signup", "purchase"])
    return search.max_norm_fusion(fx.hits(spark, sf), w).select("item_id", r6("fused").alias("fused"))


@query(
    """, s AS (SELECT item_id, exp(-0.5::DOUBLE * (rank - 1) / 100.0::DOUBLE) AS s FROM hits WHERE rank <= 100),
  f AS (SELECT item_id, sum(ln(s)) AS l, sum(s) AS t, count(*) AS c FROM s GROUP BY item_id), m AS (SELECT count(DISTINCT channel) AS m FROM hits)
  SELECT item_id, round(m * exp(l + (m - c) * -1.0::DOUBLE) / (t + (m - c) * exp(-1.0::DOUBLE)), 6) AS fused FROM f, m""",
    "hits",
)
def rank_decay_fusion(spark, sf):
    return search.rank_decay_fusion(fx.hits(spark, sf).where("rank <= 100"), 100).select("item_id", r6("fused").alias("fused"))


@query("SELECT parent, round(max(score), 6) AS score, row_number() OVER (ORDER BY max(score) DESC, parent) AS rank FROM hits GROUP BY parent", "hits")
def parent_rollup(spark, sf):
    return _ranked(search.roll_up(fx.hits(spark, sf), "parent"), "parent")


@query(
    """, ev AS (SELECT parent, max(score) AS score FROM hits GROUP BY parent), top AS (SELECT parent FROM ev ORDER BY score DESC, parent LIMIT 3),
  vid AS (SELECT item_id FROM hits WHERE channel = 'click' ORDER BY rank LIMIT 5)
  SELECT DISTINCT event_id AS shot_id FROM events WHERE user_id // 10 IN (SELECT parent FROM top) OR user_id IN (SELECT item_id FROM vid)""",
    "hits",
)
def candidate_shots(spark, sf):
    h = fx.hits(spark, sf)
    top = search.roll_up(h, "parent", 3).select(F.col("parent").alias("event_id"))
    videos = h.where("channel = 'click' AND rank <= 5").select(F.col("item_id").alias("video_id"))
    all_ = src.table(spark, sf, "events").select(F.col("event_id").alias("shot_id"), F.floor(F.col("user_id") / 10).alias("event_id"), F.col("user_id").alias("video_id"))
    return search.candidates(top, videos, all_)


HYBRID = f"""WITH {BM25},
  lex AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored WHERE query_id = 0 AND score > 0 QUALIFY rank <= 200),
  vec AS (SELECT v.vec_id AS item_id, row_number() OVER (ORDER BY {DOT} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id = 0 QUALIFY rank <= 200),
  fused AS (SELECT item_id, sum(s) AS score FROM (SELECT item_id, 1.0::DOUBLE / (60.0::DOUBLE + rank) AS s FROM vec UNION ALL SELECT item_id, 0.6::DOUBLE / (60.0::DOUBLE + rank) FROM lex) GROUP BY item_id),
  up AS (SELECT label::BIGINT AS parent, max(score) AS score FROM fused JOIN embeddings ON item_id = vec_id GROUP BY label)
  SELECT parent, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, parent) AS rank FROM up) WHERE rank <= 10"""


@query(HYBRID)
def hybrid_search(spark, sf):
    """Vector and lexical channels, reciprocal rank fusion, roll-up to parents: the flagship."""
    v = _vectors(spark, sf)
    vec = search.knn(v, _asked(v, "item_id = 0"), 200).select("item_id", F.lit("vector").alias("channel"), "rank")
    one = src.table(spark, sf, "benchmark").where("item_id = 0").select(F.col("item_id").alias("query_id"), "text")
    lex = search.bm25(src.table(spark, sf, "documents").select("doc_id", "text"), one, 200)
    lex = lex.select(F.col("doc_id").alias("item_id"), F.lit("text").alias("channel"), "rank")
    fused = search.accumulate(vec.unionByName(lex), ["item_id"], {"vector": 1.0, "text": 0.6})
    parents = fused.join(v.select("item_id", F.col("label").cast("long").alias("parent")), "item_id")
    return _ranked(search.roll_up(parents, "parent", 10), "parent")


@query(_knn_sql(10))
def vec_knn_all(spark, sf):
    v = _vectors(spark, sf)
    return _ranked(search.knn(v, _asked(v), 10), "query_id", "item_id")


@query(
    f"""WITH {BM25}, asks AS (SELECT vec_id AS query_id, vec_id // 100 AS item FROM embeddings WHERE vec_id % 100 = 0),
  lex AS (SELECT asks.query_id, doc_id AS item_id, row_number() OVER (PARTITION BY asks.query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored JOIN asks ON scored.query_id = item WHERE score > 0 QUALIFY rank <= 200),
  vec AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {DOT} DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 200),
  fused AS (SELECT query_id, item_id, sum(s) AS score FROM (SELECT query_id, item_id, 1.0::DOUBLE / (60.0::DOUBLE + rank) AS s FROM vec UNION ALL SELECT query_id, item_id, 0.6::DOUBLE / (60.0::DOUBLE + rank) FROM lex) GROUP BY ALL),
  up AS (SELECT query_id, label::BIGINT AS parent, max(score) AS score FROM fused JOIN embeddings ON item_id = vec_id GROUP BY ALL)
  SELECT query_id, parent, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, parent) AS rank FROM up QUALIFY rank <= 10"""
)
def hybrid_search_all(spark, sf):
    """hybrid_search for every hundredth vector, each with a text of its own: one plan, one pass over the texts."""
    v = _vectors(spark, sf)
    texts = src.table(spark, sf, "benchmark").select((F.col("item_id") * 100).cast("long").alias("query_id"), "text")
    asked = texts.join(_asked(v).select("query_id"), "query_id", "left_semi")
    vec = search.knn(v, _asked(v), 200).select("query_id", "item_id", F.lit("vector").alias("channel"), "rank")
    lex = search.bm25(src.table(spark, sf, "documents").select("doc_id", "text"), asked, 200).select("query_id", F.col("doc_id").alias("item_id"), F.lit("text").alias("channel"), "rank")
    fused = search.accumulate(vec.unionByName(lex), ["query_id", "item_id"], {"vector": 1.0, "text": 0.6})
    best = fused.join(v.select("item_id", F.col("label").cast("long").alias("parent")), "item_id").groupBy("query_id", "parent").agg(F.max("score").alias("score"))
    return _ranked(pooling.ranked(best, "parent", most=10), "query_id", "parent")


# pools


POOL = """, p AS (SELECT video, unnest(generate_series(0, len(emb) - 1))::BIGINT AS pos, unnest(emb)::DOUBLE AS x, idx FROM frames)"""


def _pooled(df: DataFrame) -> DataFrame:
    return df.select("video", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


def _pool_sql(expr: str) -> str:
    return f"{POOL}, g AS (SELECT video, pos, {expr} AS x FROM p GROUP BY ALL) SELECT video, pos, round(x / (sqrt(sum(x * x) OVER (PARTITION BY video)) + 1e-8::DOUBLE), 6) AS x FROM g"


@query(_pool_sql("avg(x)"), "frames")
def vec_mean_pool(spark, sf):
    return _pooled(vx.pool(fx.frames(spark, sf), "video", "emb"))


@query(_pool_sql("max(x)"), "frames")
def vec_max_pool(spark, sf):
    return _pooled(vx.pool(fx.frames(spark, sf), "video", "emb", "max"))


@query(_pool_sql("sum((1.0::DOUBLE / (1 + idx)) * x) / (sum(1.0::DOUBLE / (1 + idx)) + 1e-8::DOUBLE)"), "frames")
def vec_weighted_pool(spark, sf):
    return _pooled(vx.pool(fx.frames(spark, sf), "video", "emb", "weighted", 1.0 / (1 + F.col("idx"))))


@query(
    POOL
    + """, u AS (SELECT video, idx, pos, x / (sqrt(sum(x * x) OVER (PARTITION BY video, idx)) + 1e-8::DOUBLE) AS x FROM p),
  c0 AS (SELECT video, pos, avg(x) AS c FROM u GROUP BY ALL), c AS (SELECT video, pos, c / (sqrt(sum(c * c) OVER (PARTITION BY video)) + 1e-8::DOUBLE) AS c FROM c0),
  s AS (SELECT video, idx, 15.0::DOUBLE * sum(x * c) AS s FROM u JOIN c USING (video, pos) GROUP BY ALL),
  e AS (SELECT video, idx, exp(s - max(s) OVER (PARTITION BY video)) AS e FROM s), w AS (SELECT video, idx, e / sum(e) OVER (PARTITION BY video) AS w FROM e),
  g AS (SELECT video, pos, sum(w * x) AS x FROM u JOIN w USING (video, idx) GROUP BY ALL)
  SELECT video, pos, round(x / (sqrt(sum(x * x) OVER (PARTITION BY video)) + 1e-8::DOUBLE), 6) AS x FROM g""",
    "frames",
)
def vec_softmax_pool(spark, sf):
    return _pooled(vx.pool(fx.frames(spark, sf), "video", "emb", "softmax"))


# intervals


@query("SELECT video, sid, idx, round((least(e, be) - greatest(s, bs)) / greatest(be - bs, 1e-6::DOUBLE), 6) AS weight FROM shots JOIN subs USING (video) WHERE least(e, be) - greatest(s, bs) > 0", "shots", "subs")
def overlap_join_weights(spark, sf):
    return intervals.edge_weights(fx.subtitles(spark, sf), fx.shots(spark, sf), "video").select("video", "sid", "idx", r6("weight").alias("weight"))


BRIDGE = """, c AS (SELECT video, idx, s, e, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM shots WINDOW w AS (PARTITION BY video ORDER BY idx)),
  m AS (SELECT video, idx, least(e, be) - greatest(s, bs) AS l, least(e2, be) - greatest(s2, bs) AS r FROM c JOIN subs USING (video) WHERE s2 IS NOT NULL),
  b AS (SELECT video, idx, count(*) AS items, sum(least(l, r)) AS total FROM m WHERE l > 0 AND r > 0 GROUP BY ALL),
  bridges AS (SELECT video, idx, coalesce(items, 0) AS items, coalesce(total, 0.0::DOUBLE) AS total, 0.4::DOUBLE * least(1.0::DOUBLE, coalesce(total, 0.0::DOUBLE) / 0.5::DOUBLE) AS penalty FROM c LEFT JOIN b USING (video, idx) WHERE s2 IS NOT NULL)"""


@query(BRIDGE + " SELECT video, idx, items, round(total, 6) AS total, round(penalty, 6) AS penalty FROM bridges", "shots", "subs")
def bridge_penalty(spark, sf):
    b = intervals.bridge(fx.shots(spark, sf), fx.subtitles(spark, sf), "video")
    return b.select("video", "idx", "items", r6("total").alias("total"), r6("penalty").alias("penalty"))


@query("SELECT video, sid, idx, round(greatest(bs - s, 0.0::DOUBLE), 6) AS rel_start FROM shots JOIN subs USING (video) WHERE be >= s AND bs <= e", "shots", "subs")
def closed_overlap(spark, sf):
    met = intervals.overlap_join(fx.shots(spark, sf), fx.subtitles(spark, sf), "video", closed=True)
    return met.select("video", "sid", "idx", r6(F.greatest(F.col("bs") - F.col("s"), F.lit(0.0))).alias("rel_start"))


@query(
    """ SELECT p.video, p.sid AS id, coalesce(min(a.idx) FILTER (WHERE a.s <= p.be AND p.be < a.e), min(a.idx) FILTER (WHERE abs(a.e - p.be) < 1e-6), max(a.idx)) AS idx
  FROM subs p JOIN shots a USING (video) GROUP BY ALL""",
    "shots",
    "subs",
)
def asof_point_in_interval(spark, sf):
    points = fx.subtitles(spark, sf).select("video", F.col("sid").alias("id"), F.col("be").alias("t"))
    return intervals.point_in_interval(points, fx.shots(spark, sf), "video")


@query(
    """ SELECT video, id, m FROM (SELECT p.video, p.sid AS id, floor(a.s)::BIGINT AS m, row_number() OVER (PARTITION BY p.sid ORDER BY abs(floor(a.s)::BIGINT - floor(p.be)::BIGINT), floor(a.s) DESC) AS n
  FROM subs p JOIN shots a USING (video)) WHERE n = 1""",
    "shots",
    "subs",
)
def nearest_keyframe(spark, sf):
    points = fx.subtitles(spark, sf).select("video", F.col("sid").alias("id"), F.floor("be").cast("long").alias("t"))
    return intervals.nearest(points, fx.shots(spark, sf).select("video", F.floor("s").cast("long").alias("m")), "video")


@query("SELECT video, idx, round(least(sum(greatest(0.0::DOUBLE, least(e, be) - greatest(s, bs))) / 4.0::DOUBLE, 1.0::DOUBLE), 6) AS score FROM shots JOIN subs USING (video) WHERE least(e, be) > greatest(s, bs) GROUP BY video, idx", "shots", "subs")
def overlap_score(spark, sf):
    met = intervals.overlap_join(fx.shots(spark, sf), fx.subtitles(spark, sf), "video")
    return met.groupBy("video", "idx").agg(r6(F.least(F.sum("overlap") / 4.0, F.lit(1.0))).alias("score"))


@query("SELECT video, round(max(e), 6) AS duration FROM (SELECT video, e FROM shots UNION ALL SELECT video, be FROM subs) GROUP BY video", "shots", "subs")
def video_durations(spark, sf):
    subs = fx.subtitles(spark, sf).withColumnRenamed("be", "e")
    return src.durations(fx.shots(spark, sf), subs).select("video", r6("duration").alias("duration"))


# boundaries


CHANGE = POOL + """, c AS (SELECT video, idx, pos, avg(x) OVER (PARTITION BY video, pos ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS l,
    avg(x) OVER (PARTITION BY video, pos ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r FROM p),
  k AS (SELECT video, idx, 1 - sum(l * r) / ((sqrt(sum(l * l)) + 1e-8::DOUBLE) * (sqrt(sum(r * r)) + 1e-8::DOUBLE)) AS change FROM c WHERE r IS NOT NULL GROUP BY ALL)"""


@query(CHANGE + " SELECT video, idx, round(change, 6) AS change, true AS valid FROM k", "frames")
def context_change(spark, sf):
    c = boundary.embedding_change(fx.frames(spark, sf), "video", "emb")
    return c.select("video", "idx", r6("change").alias("change"), "valid")


FACES = """, lr AS (SELECT a.video, a.idx, b.kind, sum(CASE WHEN b.idx <= a.idx THEN {l} ELSE 0.0::DOUBLE END) AS l, sum(CASE WHEN b.idx > a.idx THEN {r} ELSE 0.0::DOUBLE END) AS r
    FROM shots a JOIN shots b ON a.video = b.video AND b.idx BETWEEN a.idx - 2 AND a.idx + 3 GROUP BY ALL),
  t AS (SELECT video, idx, sum(least({c}l{d}, {c}r{d})) AS low, sum(greatest({c}l{d}, {c}r{d})) AS high, sum(l) AS l, sum(r) AS r FROM lr GROUP BY ALL)
  SELECT video, idx, round(CASE WHEN {ok} THEN 1 - low / high ELSE 0.0::DOUBLE END, 6) AS change, {ok} AS valid FROM t"""


def _faces(spark, sf, weighted):
    s = fx.shots(spark, sf)
    counts = s.groupBy("video", "idx", F.col("kind").alias("face")).agg(F.count("*").alias("n"))
    c = boundary.face_change(counts, s.select("video", "idx"), "video", weighted=weighted)
    return c.select("video", "idx", r6("change").alias("change"), "valid")


@query(FACES.format(l="exp(-(a.idx - b.idx) / 2.0::DOUBLE)", r="exp(-(b.idx - a.idx - 1) / 2.0::DOUBLE)", c="", d="", ok="(l > 1e-8 AND r > 1e-8)"), "shots")
def face_jaccard_weighted(spark, sf):
    return _faces(spark, sf, True)


@query(FACES.format(l="1.0::DOUBLE", r="1.0::DOUBLE", c="least(", d=", 1.0::DOUBLE)", ok="(high > 0)"), "shots")
def face_jaccard_set(spark, sf):
    return _faces(spark, sf, False)


NORM = """, n AS (SELECT video, idx, s, e, kind, value, (kind <> 'error') AS ok, min(value) FILTER (WHERE kind <> 'error') OVER v AS lo, max(value) FILTER (WHERE kind <> 'error') OVER v AS hi, max(value) OVER v AS top FROM shots WINDOW v AS (PARTITION BY video)),
  m AS (SELECT video, idx, s, e, ok, kind, value / greatest(top, 1e-8::DOUBLE) AS b, CASE WHEN ok THEN (value - lo) / greatest(hi - lo, 1e-8::DOUBLE) ELSE 0.0::DOUBLE END AS a FROM n)"""
FUSED = NORM + """, f AS (SELECT video, idx, s, e, CASE WHEN ok AND kind <> 'click' THEN (0.3::DOUBLE * a + 0.4::DOUBLE * b) / 0.7::DOUBLE WHEN ok THEN a WHEN kind <> 'click' THEN b ELSE 0.0::DOUBLE END AS score FROM m)"""
PEAKS = FUSED + """, q AS (SELECT video, quantile_cont(score, 0.85) AS cut FROM f GROUP BY video),
  k AS (SELECT video, idx, s, e, score, score >= lag(score, 1, -1.0) OVER w AND score >= lead(score, 1, -1.0) OVER w AND score >= cut AS is_candidate FROM f JOIN q USING (video) WINDOW w AS (PARTITION BY video ORDER BY idx))"""


def _normed(spark, sf) -> DataFrame:
    s = fx.shots(spark, sf)
    top = F.max("value").over(Window.partitionBy("video"))
    ok = F.col("kind") != "error"
    return s.withColumns({"a_valid": ok, "b_valid": F.col("kind") != "click", "b_norm": F.col("value") / F.greatest(top, F.lit(1e-8)), "a_norm": boundary.min_max(F.col("value"), ok, "video")})


def _fused(spark, sf) -> DataFrame:
    return _normed(spark, sf).withColumn("score", boundary.fuse({"a": 0.3, "b": 0.4}))


@query(NORM + " SELECT video, idx, round(a, 6) AS norm FROM m", "shots")
def minmax_normalize(spark, sf):
    return _normed(spark, sf).select("video", "idx", r6("a_norm").alias("norm"))


@query(FUSED + " SELECT video, idx, round(score, 6) AS score FROM f", "shots")
def modality_weighted_score(spark, sf):
    return _fused(spark, sf).select("video", "idx", r6("score").alias("score"))


@query(PEAKS + " SELECT video, idx, round(score, 6) AS score, is_candidate FROM k", "shots")
def candidate_peaks(spark, sf):
    return boundary.peaks(_fused(spark, sf), "video").select("video", "idx", r6("score").alias("score"), "is_candidate")


# sequences


SESSIONS = """, g AS (SELECT video, idx, s, value, kind, sum(CASE WHEN s - p > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY s)::BIGINT AS session FROM (SELECT *, lag(s) OVER (PARTITION BY video ORDER BY s) AS p FROM shots))"""


@query(SESSIONS + " SELECT video, session, count(*) AS n, round(max(s) - min(s), 6) AS span FROM g GROUP BY ALL", "shots")
def gap_sessions(spark, sf):
    g = intervals.gap_sessions(fx.shots(spark, sf), "video", "s", 12)
    return g.groupBy("video", "session").agg(F.count("*").alias("n"), r6(F.max("s") - F.min("s")).alias("span"))


@query(
    SESSIONS
    + """ SELECT a.video, a.idx, coalesce(max(b.value), 0.0::DOUBLE) AS best_score, arg_max(b.idx, (b.value, -b.idx)) AS best_order
  FROM g a LEFT JOIN g b ON a.video = b.video AND a.session = b.session AND abs(a.idx - b.idx) <= 3 AND b.value > 0 GROUP BY ALL""",
    "shots",
)
def window_argmax(spark, sf):
    g = intervals.gap_sessions(fx.shots(spark, sf), "video", "s", 12)
    return intervals.window_best(g, ["video", "session"], "idx", "value", 3).select("video", "idx", "best_score", "best_order")


def _rows(spark, sf) -> DataFrame:
    peaks = boundary.peaks(_fused(spark, sf), "video").select("video", "idx", "s", "e", "score", "is_candidate")
    b = intervals.bridge(fx.shots(spark, sf), fx.subtitles(spark, sf), "video").select("video", "idx", "penalty")
    return peaks.join(b, ["video", "idx"], "left")


SEGMENTS = PEAKS + fold_sql.segments(f"SELECT k.*, penalty FROM k LEFT JOIN (WITH {BRIDGE.lstrip(', ')} SELECT * FROM bridges) USING (video, idx)")
CHAINS = fold_sql.chains()


@query(SEGMENTS + " SELECT video, event, first, last FROM segs", "shots", "subs", recursive=True)
def dp_segments(spark, sf):
    return folds.segment_events(_rows(spark, sf), "video")


def _supports(spark, sf) -> DataFrame:
    g = intervals.gap_sessions(fx.shots(spark, sf), "video", "s", 24)
    for i, kind in enumerate(("view", "click", "purchase")):
        g = g.withColumn(f"x{i}", F.when(F.col("kind") == kind, F.col("value")).otherwise(0.0))
        g = intervals.window_best(g, ["video", "session"], "idx", f"x{i}", 3).withColumnsRenamed({"best_score": f"s{i}", "best_order": f"o{i}"})
    return g.select("video", "session", F.col("idx").alias("ord"), *(f"{c}{i}" for i in range(3) for c in "so"))


def _chains(spark, sf) -> DataFrame:
    return folds.temporal_chains(_supports(spark, sf), ["video", "session"], 3).select("video", "session", r6("score").alias("score"), "matched", "skipped", "chain")


@query(CHAINS + " SELECT * FROM chains", "shots", recursive=True)
def temporal_chains(spark, sf):
    return _chains(spark, sf)


@query(CHAINS + " SELECT *, row_number() OVER (ORDER BY matched DESC, skipped, score DESC, video, session)::INT AS rank FROM chains QUALIFY rank <= 30", "shots", recursive=True)
def temporal_search(spark, sf):
    """Chains ranked by stages matched, fewer skips, score; the top 30."""
    order = [F.desc("matched"), F.asc("skipped"), F.desc("score"), F.asc("video"), F.asc("session")]
    top = _chains(spark, sf).orderBy(*order).limit(30)  # each task keeps 30
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


@query(
    f""", ch AS (WITH RECURSIVE {CHAINS.lstrip(", ")} SELECT * FROM chains), se AS (WITH RECURSIVE {SEGMENTS.lstrip(", ")} SELECT * FROM segs),
  sp AS (SELECT video, split_part(split_part(chain, '>', 1), ':', 2)::BIGINT AS first, split_part(split_part(chain, '>', -1), ':', 2)::BIGINT AS last, score FROM ch UNION ALL SELECT video, first, last, 0.0::DOUBLE FROM se WHERE (SELECT count(*) FROM ch) = 0)
  SELECT video, first, last, score FROM sp ORDER BY score DESC, video, first LIMIT 30""",
    "shots",
    "subs",
    recursive=True,
)
def segment_extraction(spark, sf):
    """Spans of the best chains, first to last shot; the best events where there is no chain; 30 at most."""
    at = F.transform(F.split("chain", ">"), lambda c: F.split(c, ":")[1].cast("long"))
    chains = _chains(spark, sf).select("video", at[0].alias("first"), F.element_at(at, -1).alias("last"), "score", F.lit(0).alias("kind"))
    events = folds.segment_events(_rows(spark, sf), "video").select("video", "first", "last", F.lit(0.0).alias("score"), F.lit(1).alias("kind"))
    least = chains.agg(F.when(F.count("*") > 0, 0).otherwise(1).alias("_least"))  # one row
    return chains.unionByName(events).crossJoin(F.broadcast(least)).where("kind = _least").orderBy(F.desc("score"), "video", "first").limit(30).select("video", "first", "last", "score")


@query(fold_sql.KEYFRAMES, "frames", recursive=True)
def greedy_keyframes(spark, sf):
    return folds.greedy_keyframes(fx.frames(spark, sf), "video")


@query(fold_sql.CLUSTERS, "frames", recursive=True)
def leader_clusters(spark, sf):
    return folds.leader_clusters(fx.frames(spark, sf), "video")


@query(fold_sql.LOGOS)
def logo_positions(spark, sf):
    boxes = src.table(spark, sf, "events").select(F.col("user_id").alias("video"), F.floor(F.col("event_id") / 4).cast("long").alias("frame"), F.col("event_id").alias("idx"), F.col("value").alias("x"), (F.col("value") / 2).alias("y"))
    return folds.position_clusters(boxes, "video", ratio=0.05).select("video", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "frames")


@query()
def run_merge(spark, sf):
    c = src.table(spark, sf, "conversations").where("text IS NOT NULL")
    return folds.merge_runs(c.select(F.col("conv_id").alias("video"), F.col("turn").alias("frame"), "text"), "video", near=0.5)


@query(
    SEGMENTS
    + """, j AS (SELECT g.video, g.event, h.idx, h.s, h.e, h.kind FROM segs g JOIN shots h ON h.video = g.video AND h.idx BETWEEN g.first AND g.last),
  kn AS (SELECT video, event, kind, count(*) AS n, min(idx) AS i FROM j WHERE kind IS NOT NULL GROUP BY ALL),
  kt AS (SELECT video, event, string_agg(kind, ' ' ORDER BY i) FILTER (kind <> '') AS text, '{' || string_agg('"' || kind || '":' || n, ',' ORDER BY kind) || '}' AS face_counts FROM kn GROUP BY ALL)
  SELECT video, event, round(s, 6) AS s, round(e, 6) AS e, n_shots, coalesce(text, '') AS text, face_counts FROM (SELECT video, event, min(s) AS s, max(e) AS e, count(*) AS n_shots FROM j GROUP BY ALL) LEFT JOIN kt USING (video, event)""",
    "shots",
    "subs",
    recursive=True,
)
def event_build(spark, sf):
    s = fx.shots(spark, sf).select("video", "idx", "s", "e", F.col("kind").alias("text"), F.col("kind").alias("face"))
    built = shots.build_events(folds.segment_events(_rows(spark, sf), "video"), s, "video")
    return built.select("video", "event", r6("s").alias("s"), r6("e").alias("e"), "n_shots", "text", F.to_json("face_counts").alias("face_counts"))


# sets, features, text


@query(
    """ SELECT video, array_to_string(list_sort(list(kind)), ',') AS have, array_to_string(list_filter(['click', 'purchase', 'signup'], lambda x: NOT list_contains(list(kind), x)), ',') AS missing
  FROM (SELECT DISTINCT video, kind FROM shots WHERE kind IN ('click', 'purchase', 'signup') AND value > 60) GROUP BY video""",
    "shots",
)
def set_ops_preflight(spark, sf):
    s = fx.shots(spark, sf).where("value > 60")
    p = src.preflight({k: s.where(F.col("kind") == k) for k in ("click", "signup", "purchase")}, "video")
    return p.select("video", F.array_join("have", ",").alias("have"), F.array_join("missing", ",").alias("missing"))


@query(
    """ SELECT video, idx, round((idx - min(idx) OVER v)::DOUBLE / greatest(count(*) OVER v - 1, 1), 6) AS position, round(least((e - s) / 10.0::DOUBLE, 1.0::DOUBLE), 6) AS duration,
    round((s - min(s) OVER v) / greatest(max(e) OVER v - min(s) OVER v, 1e-6::DOUBLE), 6) AS rel_start, round((e - min(s) OVER v) / greatest(max(e) OVER v - min(s) OVER v, 1e-6::DOUBLE), 6) AS rel_end
  FROM shots WINDOW v AS (PARTITION BY video)""",
    "shots",
)
def shot_features(spark, sf):
    f = shots.shot_features(fx.shots(spark, sf), "video")
    return f.select("video", "idx", *(r6(c).alias(c) for c in ("position", "duration", "rel_start", "rel_end")))


@query(
    """, k AS (SELECT DISTINCT video, idx, s, e, floor(s + (e - s) * j / 3.0::DOUBLE)::BIGINT AS frame FROM shots, range(3) r(j))
  SELECT video, idx, frame, round((row_number() OVER o - 1)::DOUBLE / greatest(count(*) OVER v - 1, 1), 6) AS rel_pos, round((frame / 2.0::DOUBLE - s) / greatest(e - s, 1e-6::DOUBLE), 6) AS rel_time,
    round(least(coalesce((frame - lag(frame) OVER o) / 2.0::DOUBLE, 0.0::DOUBLE) / 4.0::DOUBLE, 1.0::DOUBLE), 6) AS before, round(least(coalesce((lead(frame) OVER o - frame) / 2.0::DOUBLE, 0.0::DOUBLE) / 4.0::DOUBLE, 1.0::DOUBLE), 6) AS after
  FROM k WINDOW v AS (PARTITION BY video, idx), o AS (PARTITION BY video, idx ORDER BY frame)""",
    "shots",
)
def keyframe_features(spark, sf):
    third = F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda j: F.floor(F.col("s") + (F.col("e") - F.col("s")) * j / 3.0).cast("long"))).alias("frame")
    k = fx.shots(spark, sf).select("video", "idx", "s", "e", third).distinct()
    f = shots.keyframe_features(k, ["video", "idx"], 2.0, 4.0)
    return f.select("video", "idx", "frame", *(r6(c).alias(c) for c in ("rel_pos", "rel_time", "before", "after")))


@query(" SELECT video, idx, count(*) AS n, round(sum(t), 6) AS total FROM (SELECT video, idx, CASE WHEN n = 1 THEN (s + e) / 2 ELSE s + m + ((e - m) - (s + m)) * i / (n - 1) END AS t FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (SELECT video, idx, s, e, least(5, greatest(1, ceil((e - s) / 2)::INT)) AS n, least(0.15::DOUBLE * (e - s), 0.25::DOUBLE) AS m FROM shots WHERE e > s))) GROUP BY ALL", "shots")
def sample_times(spark, sf):
    t = fx.shots(spark, sf).select("video", "idx", F.explode(shots.sample_times(F.col("s"), F.col("e"))).alias("t"))
    return t.groupBy("video", "idx").agg(F.count("*").alias("n"), r6(F.sum("t")).alias("total"))


@query(" SELECT video, idx, i::BIGINT AS part, round(s + (e - s) * i / n, 6) AS s, round(s + (e - s) * (i + 1) / n, 6) AS e FROM (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM (SELECT video, idx, s, e, greatest(1, ceil((e - s) / 4.0::DOUBLE)::INT) AS n FROM shots))", "shots")
def sub_shot_split(spark, sf):
    t = fx.shots(spark, sf).select("video", "idx", F.posexplode(shots.sub_shots(F.col("s"), F.col("e"), 4.0)).alias("part", "r"))
    return t.select("video", "idx", F.col("part").cast("long").alias("part"), r6("r.s").alias("s"), r6("r.e").alias("e"))


@query(rf"SELECT conv_id, turn, lower(trim(regexp_replace(text, '{SPACE}', ' ', 'g'))) AS text FROM conversations")
def text_normalize(spark, sf):
    return src.table(spark, sf, "conversations").select("conv_id", "turn", tx.normalize(F.col("text")).alias("text"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\p{M}\s]', ' ', 'g'), '" + SPACE + r"', ' ', 'g')) AS text FROM conversations")
def text_match_form(spark, sf):
    return src.table(spark, sf, "conversations").select("conv_id", "turn", tx.match_form(F.col("text")).alias("text"))


@query(rf"SELECT gram, count(*) AS n FROM (SELECT unnest(list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM (SELECT regexp_extract_all(lower(text), '{TOKENS}') AS t FROM conversations) WHERE len(t) > 1) GROUP BY gram")
def ngram_counts(spark, sf):
    t = src.table(spark, sf, "conversations").select(F.explode(tx.ngrams(tx.tokenize(F.col("text")), 2)).alias("gram"))
    return t.groupBy("gram").agg(F.count("*").alias("n"))


QUALITY = r"""SELECT conv_id, turn, round(1.5::DOUBLE * length(regexp_replace(raw, '[^""" + tx.BOTH + r"""]', '', 'g')) + 2.0::DOUBLE * len(words) + 0.05::DOUBLE * length(form) - 2.0::DOUBLE * length(regexp_replace(raw, '[\p{L}\p{N}_\p{M}\s.,!?;:''"()\-]', '', 'g'))
    - 0.5::DOUBLE * coalesce(list_sum(list_transform(words, lambda w: greatest(length(w) - 8, 0))), 0), 6) AS quality%s
  FROM (SELECT *, list_filter(string_split(form, ' '), lambda w: w <> '') AS words FROM (SELECT conv_id, turn, text, trim(text) AS raw, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\p{M}\s]', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS form FROM conversations))"""


@query(QUALITY % f", translate(text, '{tx.BOTH}', '{tx.PLAIN}') AS folded")
def text_quality(spark, sf):
    return src.table(spark, sf, "conversations").select("conv_id", "turn", r6(tx.quality(F.col("text"))).alias("quality"), tx.fold(F.col("text")).alias("folded"))


@query(r"SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g'), '_'), ''), 'empty_id') AS safe, CASE WHEN length(url) <= 20 THEN url ELSE left(url, 20) || '…' END AS preview FROM pages")
def safe_ids(spark, sf):
    return src.table(spark, sf, "pages").select("page_id", tx.safe_id(F.col("url")).alias("safe"), tx.preview(F.col("url"), 20).alias("preview"))


@query("SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code FROM (SELECT event_id, floor(value * 1000)::BIGINT AS ms FROM events)")
def timecodes(spark, sf):
    return src.table(spark, sf, "events").select("event_id", tx.timecode(F.col("value"), ",").alias("code"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_fields(spark, sf):
    body = tx.json_payload(F.concat(F.lit("<think>{}</think>```json\n"), F.col("props"), F.lit("\n```")))
    return src.table(spark, sf, "events").select("event_id", F.from_json(body, "k long")["k"].alias("k"))


@query(
    """, st AS (SELECT video AS query_id, idx AS stage, kind FROM shots WHERE kind <> 'error'), d AS (SELECT *, lag(kind) OVER (PARTITION BY query_id ORDER BY stage) AS p FROM st)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY stage) - 1 AS stage, kind AS visual FROM d WHERE p IS NULL OR p <> kind""",
    "shots",
)
def clean_stages(spark, sf):
    visual = F.when(F.col("kind") != "error", F.concat(F.lit(" "), "kind")).otherwise(" ")
    s = fx.shots(spark, sf).select(F.col("video").alias("query_id"), F.col("idx").alias("stage"), visual.alias("visual"), F.lit("").alias("ocr"), F.lit(None).cast("string").alias("subtitle"))
    return shots.clean_stages(s).select("query_id", "stage", "visual")


# evaluation


@query(
    """, top AS (SELECT channel, item_id, rank FROM hits), first AS (SELECT t.video AS query_id, min(h.rank) AS first FROM (SELECT DISTINCT video FROM shots) t LEFT JOIN top h ON h.item_id = t.video AND h.channel = 'click' GROUP BY ALL)
  SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / first, 0.0::DOUBLE)), 6) AS mrr, """
    + ", ".join(f"round(avg(CASE WHEN first <= {k} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hit_at_{k}" for k in evaluate.AT)
    + " FROM first",
    "shots",
    "hits",
)
def hit_at_k_mrr(spark, sf):
    truth = fx.shots(spark, sf).groupBy(F.col("video").alias("query_id")).agg(F.min("video").alias("video"), F.lit(0.0).alias("s"), F.lit(10.0).alias("e"))
    found = fx.hits(spark, sf).where("channel = 'click'").select(F.col("item_id").alias("query_id"), F.col("item_id").alias("video"), F.lit(5.0).alias("s"), F.lit(5.0).alias("e"), "rank")
    m = evaluate.summary(evaluate.first_hits(found, truth))
    return m.select("queries", *(r6(c).alias(c) for c in m.columns[1:]))
