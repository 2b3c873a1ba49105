"""More registered queries: pooling search, stages, subtitle modality, datasets, faces, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions import vectors as vx
from quern.operators import boundary, evaluate, intervals, pooling, search, shots
from quern.plans import fixtures as fx
from quern.plans.queries import BRIDGE, DOT, FACES, QUALITY, query, r6
from quern.sources import tables as src

# pooling search: a vector is a shot, five an event, fifty a video


CHANNELS = ("event", "caption", "subtitle", "ocr")


def _pool_hits(spark, sf) -> DataFrame:
    """Each channel asks the vectors whose id leaves its number modulo 5; events and captions are hit themselves, subtitles and OCR by their own id."""
    v = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("emb"))
    asked = v.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "emb")
    out = None
    for i, channel in enumerate(CHANNELS):
        found = search.knn(v.where(F.col("item_id") % 5 == i), asked, 20)
        item = F.floor(F.col("item_id") / 5) if i < 2 else F.col("item_id")
        part = found.select("query_id", F.lit(channel).alias("channel"), item.cast("long").alias("item_id"), "rank")
        out = part if out is None else out.unionByName(part)
    return out


def _edges(spark, sf, to) -> DataFrame:
    """A subtitle touches the next shot or event as well, at a quarter; OCR its own."""
    v = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"))
    last = v.agg(F.max("item_id").alias("m"))
    sub = v.where("item_id % 5 = 2").select("item_id", F.explode(F.array(F.struct(F.lit(0).alias("o"), F.lit(0.75).alias("w")), F.struct(F.lit(1).alias("o"), F.lit(0.25).alias("w")))).alias("x"))
    sub = sub.crossJoin(F.broadcast(last)).select(F.lit("subtitle").alias("channel"), "item_id", to(F.col("item_id"), F.col("x.o"), F.col("m")).cast("long").alias("target"), F.col("x.w").alias("weight"))
    ocr = v.where("item_id % 5 = 3").select(F.lit("ocr").alias("channel"), "item_id", to(F.col("item_id"), F.lit(0), F.col("item_id")).cast("long").alias("target"), F.lit(1.0).alias("weight"))
    return sub.unionByName(ocr)


def _event_edges(spark, sf) -> DataFrame:
    return _edges(spark, sf, lambda i, o, m: F.least(F.floor(i / 5) + o, F.floor(m / 5)))


def _shot_edges(spark, sf) -> DataFrame:
    return _edges(spark, sf, lambda i, o, m: F.least(i + o, m))


def _hierarchy(spark, sf) -> DataFrame:
    i = F.col("vec_id")
    return src.table(spark, sf, "embeddings").select(i.alias("shot_id"), F.floor(i / 5).alias("event_id"), F.floor(i / 50).alias("video_id"))


HITS = f"""WITH a AS (SELECT q.vec_id AS query_id, v.vec_id AS item_id, v.vec_id % 5 AS c, row_number() OVER (PARTITION BY q.vec_id, v.vec_id % 5 ORDER BY {DOT} DESC, v.vec_id) AS rank
    FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 AND v.vec_id % 5 < 4 QUALIFY rank <= 20),
  top AS (SELECT max(vec_id) AS m FROM embeddings),
  he AS (SELECT query_id, c, item_id // 5 AS target, rank, 1.0::DOUBLE AS w FROM a WHERE c <> 2 UNION ALL SELECT query_id, c, least(item_id // 5 + o, m // 5), rank, CASE o WHEN 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END FROM a, range(2) r(o), top WHERE c = 2),
  hs AS (SELECT query_id, c, item_id AS target, rank, 1.0::DOUBLE AS w FROM a WHERE c = 3 UNION ALL SELECT query_id, c, least(item_id + o, m), rank, CASE o WHEN 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END FROM a, range(2) r(o), top WHERE c = 2),
  ev AS (SELECT query_id, target AS event_id, sum(CASE c WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * w / (60.0::DOUBLE + rank)) AS score FROM he GROUP BY ALL),
  te AS (SELECT query_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, event_id) <= 100),
  tv AS (SELECT * FROM (SELECT query_id, event_id // 10 AS video_id, max(score) AS score FROM ev GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, video_id) <= 30),
  al AS (SELECT query_id, vec_id AS shot_id FROM te JOIN embeddings ON vec_id // 5 = event_id UNION SELECT query_id, vec_id FROM tv JOIN embeddings ON vec_id // 50 = video_id),
  sv AS (SELECT query_id, shot_id, row_number() OVER (PARTITION BY query_id ORDER BY round({DOT}, 9) DESC, shot_id) AS rank FROM al JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = shot_id QUALIFY rank <= 100)"""


@query(
    HITS
    + """, sh AS (SELECT query_id, target AS shot_id, target // 5 AS event_id, sum(x) AS x FROM (
    SELECT query_id, shot_id AS target, 0.8::DOUBLE / (60.0::DOUBLE + rank) AS x FROM sv UNION ALL SELECT query_id, target, CASE c WHEN 2 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END * w / (60.0::DOUBLE + rank) FROM hs) GROUP BY ALL),
  sp AS (SELECT sh.query_id, shot_id, sh.event_id, x + coalesce(0.2::DOUBLE * ev.score, 0.0::DOUBLE) AS score FROM sh LEFT JOIN ev USING (query_id, event_id)),
  ch AS (SELECT query_id, event_id, sum(total) AS chain FROM (SELECT query_id, event_id, sum(score) OVER (PARTITION BY query_id) AS total FROM (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, shot_id) <= 3)) GROUP BY ALL),
  best AS (SELECT query_id, event_id, max(score) AS score FROM sp GROUP BY ALL),
  al2 AS (SELECT query_id, event_id, coalesce(ev.score, 0.0::DOUBLE) + coalesce(best.score, 0.0::DOUBLE) + coalesce(chain, 0.0::DOUBLE) AS score FROM ev FULL JOIN best USING (query_id, event_id) FULL JOIN ch USING (query_id, event_id))
  SELECT query_id, event_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, event_id) AS rank FROM al2 QUALIFY rank <= 30""",
)
def pooled_search(spark, sf):
    """End to end, with one chain a query: its three best shots, which each give their event the chain's score."""

    def chains(found: DataFrame) -> DataFrame:
        best = pooling.ranked(found, "shot_id", most=3)
        return best.select("query_id", "event_id", F.sum("score").over(Window.partitionBy("query_id")).alias("score"))

    v = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("emb"))
    asked = v.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "emb")
    out = pooling.pooled_search(_pool_hits(spark, sf), _event_edges(spark, sf), _shot_edges(spark, sf), _hierarchy(spark, sf), v, asked, chains)
    return out.select("query_id", "event_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    HITS
    + """ SELECT query_id, shot_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, shot_id) AS rank FROM (
    SELECT query_id, target AS shot_id, sum(x) AS score FROM (SELECT query_id, shot_id AS target, 0.45::DOUBLE / (60.0::DOUBLE + rank) AS x FROM sv UNION ALL
      SELECT query_id, target, CASE c WHEN 2 THEN 0.2::DOUBLE ELSE 0.35::DOUBLE END * w / (60.0::DOUBLE + rank) FROM hs) WHERE (query_id, target) IN (SELECT query_id, shot_id FROM al) GROUP BY ALL) QUALIFY rank <= 10""",
)
def stage_fusion(spark, sf):
    hits = _pool_hits(spark, sf)
    c = pooling.Config()
    events = pooling.fuse(pooling.expand(hits, _event_edges(spark, sf)), c.event_weights)
    allowed = pooling.candidate_shots(events, _hierarchy(spark, sf), c)
    v = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("emb"))
    asked = v.where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), "emb")
    found = pooling.shot_hits(allowed, v, asked, c.shots).unionByName(hits.where("channel in ('subtitle', 'ocr')"))
    return pooling.stage_fusion(found, _shot_edges(spark, sf), allowed, c, 10).select("query_id", "shot_id", r6("score").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("SELECT item_id AS query_id, coalesce(nullif(trim(CASE WHEN item_id % 3 = 0 THEN ' ' ELSE 'EN ' || text END), ''), nullif(trim(text), '')) AS visual, coalesce(nullif(trim(CASE WHEN item_id % 2 = 0 THEN 'sign' END), ''), nullif(trim(text), '')) AS ocr FROM benchmark")
def query_routing(spark, sf):
    b = src.table(spark, sf, "benchmark")
    q = b.select(F.col("item_id").alias("query_id"), F.col("text").alias("raw"), F.when(F.col("item_id") % 3 == 0, " ").otherwise(F.concat(F.lit("EN "), "text")).alias("translated"), F.lit("").alias("subtitle"), F.when(F.col("item_id") % 2 == 0, "sign").alias("ocr"))
    return pooling.route(q).select("query_id", "visual", "ocr")


@query("SELECT channel, item_id, rank FROM hits WHERE (channel = 'click' AND rank <= 20) OR (channel = 'view' AND rank <= 10)", "hits")
def payload_truncation(spark, sf):
    return pooling.truncated(fx.hits(spark, sf), {"click": 20, "view": 10}, "channel").select("channel", "item_id", F.col("rank").cast("long").alias("rank"))


# subtitles


VECTOR = "(SELECT video, sid, bs, be, text, embedding AS emb FROM subs JOIN embeddings ON vec_id = sid % 500)"


def _told(spark, sf) -> DataFrame:
    v = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("emb"))
    s = fx.subtitles(spark, sf).withColumn("v", F.col("sid") % 500)
    return s.join(v, "v").drop("v")


SUBTITLE = f""", cu AS (SELECT video, idx, e AS cut, first(s) OVER l AS ls, first(s) OVER r AS rs, last(e) OVER r AS re FROM shots
    WINDOW l AS (PARTITION BY video ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), r AS (PARTITION BY video ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
  sd AS (SELECT video, idx, cut, 'l' AS side, ls AS s, cut AS e FROM cu WHERE rs IS NOT NULL UNION ALL SELECT video, idx, cut, 'r', rs, re FROM cu WHERE rs IS NOT NULL),
  sw AS (SELECT sd.video, sd.idx, side, emb, (least(e, be) - greatest(s, bs)) * exp(-greatest(CASE side WHEN 'l' THEN cut - least(be, cut) ELSE greatest(bs, cut) - cut END, 0.0::DOUBLE) / 2.0::DOUBLE) AS w
    FROM sd JOIN {VECTOR} u ON sd.video = u.video AND least(e, be) - greatest(s, bs) > 0),
  sp AS (SELECT video, idx, side, unnest(generate_series(1, 64)) AS p, emb, w FROM sw WHERE w > 0),
  sm AS (SELECT video, idx, side, p, sum(w * emb[p]::DOUBLE) / (sum(w) + 1e-8::DOUBLE) AS x FROM sp GROUP BY ALL),
  su AS (SELECT video, idx, side, p, x / (sqrt(sum(x * x) OVER (PARTITION BY video, idx, side)) + 1e-8::DOUBLE) AS x FROM sm),
  sn AS (SELECT video, idx, p, max(x) FILTER (side = 'l') AS l, max(x) FILTER (side = 'r') AS r FROM su GROUP BY ALL),
  subtitle AS (SELECT cu.video, cu.idx, coalesce(change, 0.0::DOUBLE) AS change, change IS NOT NULL AS valid FROM cu LEFT JOIN (
    SELECT video, idx, CASE WHEN count(l) > 0 AND count(r) > 0 THEN 1 - sum(l * r) / ((sqrt(sum(l * l)) + 1e-8::DOUBLE) * (sqrt(sum(r * r)) + 1e-8::DOUBLE)) END AS change FROM sn GROUP BY ALL) k ON cu.video = k.video AND cu.idx = k.idx WHERE rs IS NOT NULL)"""


@query(SUBTITLE + " SELECT video, idx, round(change, 5) + 0.0::DOUBLE AS change, valid FROM subtitle", "shots", "subs")
def subtitle_change(spark, sf):
    c = boundary.subtitle_change(fx.shots(spark, sf), _told(spark, sf), "video")
    return c.select("video", "idx", (F.round("change", 5) + 0.0).alias("change"), "valid")


@query(
    FACES.format(l="exp(-(a.idx - b.idx) / 2.0::DOUBLE)", r="exp(-(b.idx - a.idx - 1) / 2.0::DOUBLE)", c="", d="", ok="(l > 1e-8 AND r > 1e-8)").rsplit(" SELECT video, idx, round", 1)[0].rstrip()
    + """, face AS (SELECT video, idx, CASE WHEN l > 1e-8 AND r > 1e-8 THEN 1 - low / high ELSE 0.0::DOUBLE END AS change, (l > 1e-8 AND r > 1e-8) AS valid FROM t)"""
    + BRIDGE
    + SUBTITLE
    + """, bo AS (SELECT u.video, u.idx, f.change AS fc, f.valid AS fv, u.change AS sc, u.valid AS sv FROM subtitle u JOIN face f ON u.video = f.video AND u.idx = f.idx),
  bn AS (SELECT *, CASE WHEN fv THEN (fc - min(fc) FILTER (fv) OVER v) / greatest(max(fc) FILTER (fv) OVER v - min(fc) FILTER (fv) OVER v, 1e-8::DOUBLE) ELSE 0.0::DOUBLE END AS fn,
    CASE WHEN sv THEN (sc - min(sc) FILTER (sv) OVER v) / greatest(max(sc) FILTER (sv) OVER v - min(sc) FILTER (sv) OVER v, 1e-8::DOUBLE) ELSE 0.0::DOUBLE END AS sn2 FROM bo WINDOW v AS (PARTITION BY video))
  SELECT bn.video, bn.idx, round(fn, 5) AS face_norm, round(sn2, 4) AS subtitle_norm, round(CASE WHEN fv AND sv THEN (0.15::DOUBLE * fn + 0.4::DOUBLE * sn2) / 0.55::DOUBLE WHEN fv THEN fn WHEN sv THEN sn2 ELSE 0.0::DOUBLE END, 4) AS score, round(penalty, 6) AS penalty
  FROM bn JOIN bridges b ON bn.video = b.video AND bn.idx = b.idx""",
    "shots",
    "subs",
)
def boundary_assembly(spark, sf):
    s = fx.shots(spark, sf)
    counts = s.groupBy("video", "idx", F.col("kind").alias("face")).agg(F.count("*").alias("n"))
    changes = {"face": boundary.face_change(counts, s.select("video", "idx"), "video"), "subtitle": boundary.subtitle_change(s, _told(spark, sf), "video")}
    rows = boundary.boundary_rows(s, changes, intervals.bridge(s, fx.subtitles(spark, sf), "video"), "video", {"face": 0.15, "subtitle": 0.4})
    return rows.select("video", "idx", F.round("face_norm", 5).alias("face_norm"), F.round("subtitle_norm", 4).alias("subtitle_norm"), F.round("score", 4).alias("score"), r6("penalty").alias("penalty"))


@query(
    f""", m AS (SELECT a.video, a.idx, least(e, be) - greatest(s, bs) AS w, emb FROM shots a JOIN {VECTOR} u ON a.video = u.video AND least(e, be) - greatest(s, bs) > 0),
  p AS (SELECT video, idx, p, sum(w * emb[p]::DOUBLE) AS x FROM (SELECT *, unnest(generate_series(1, 64)) AS p FROM m) GROUP BY ALL)
  SELECT video, idx, round(x / n, 5) AS first FROM (SELECT video, idx, p, x, sqrt(sum(x * x) OVER (PARTITION BY video, idx)) AS n FROM p) WHERE p = 1""",
    "shots",
    "subs",
)
def subtitle_features(spark, sf):
    f = intervals.subtitle_features(fx.shots(spark, sf), _told(spark, sf), "video")
    return f.where("emb is not null").select("video", "idx", F.round(F.col("emb")[0], 5).alias("first"))


@query("SELECT event_id, greatest(value, 100.0::DOUBLE - value) AS e FROM events")
def clamped_ends(spark, sf):
    return src.table(spark, sf, "events").select("event_id", intervals.clamp_end(F.col("value"), 100.0 - F.col("value")).alias("e"))


@query(
    """SELECT conv_id, '[' || string_agg('{"relative_time":"' || printf('%.3fs', 4.0::DOUBLE * turn) || ' - ' || printf('%.3fs', 4.0::DOUBLE * turn + 3.5::DOUBLE) || '","text":"' || role || '"}', ',' ORDER BY turn) || ']' AS block
  FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL GROUP BY conv_id"""
)
def subtitle_json(spark, sf):
    t = src.table(spark, sf, "conversations").where("text is not null and role is not null")
    items = F.array_sort(F.collect_list(F.struct((F.col("turn") * 4.0).alias("start"), (F.col("turn") * 4.0 + 3.5).alias("end"), F.col("role").alias("text"))))
    return t.groupBy("conv_id").agg(items.alias("i")).select("conv_id", tx.subtitle_block(F.col("i")).alias("block"))


@query("SELECT page_id, regexp_replace(trim(url), '[\\s]+', ' ', 'g') AS text FROM pages")
def translation_cleanup(spark, sf):
    """Urls dressed as a model's answer come back as they were."""
    return src.table(spark, sf, "pages").select("page_id", tx.clean_translation(F.concat(F.lit("```text\nOutput: translation:  "), "url", F.lit(" \n```"))).alias("text"))


# keyframes


@query(
    """, k AS (SELECT DISTINCT video, floor(s / 4)::BIGINT AS m FROM shots), h AS (SELECT video, sid AS id, least(floor(bs / 4), floor(be / 4) - 1)::BIGINT AS first, greatest(floor(bs / 4), floor(be / 4) - 1)::BIGINT AS last FROM subs),
  i AS (SELECT h.video, id, m FROM h JOIN k ON h.video = k.video AND m BETWEEN first AND last)
  SELECT * FROM i UNION ALL
  SELECT video, id, m FROM (SELECT h.video, id, m, row_number() OVER (PARTITION BY id ORDER BY abs(m - (first + last) / 2.0::DOUBLE), m DESC) AS n FROM h JOIN k ON h.video = k.video WHERE id NOT IN (SELECT id FROM i)) WHERE n = 1""",
    "shots",
    "subs",
)
def hit_expansion(spark, sf):
    marks = fx.shots(spark, sf).select("video", F.floor(F.col("s") / 4).cast("long").alias("m")).distinct()
    hits = fx.subtitles(spark, sf).select("video", F.col("sid").alias("id"), F.floor(F.col("bs") / 4).cast("long").alias("first"), (F.floor(F.col("be") / 4) - 1).cast("long").alias("last"))
    return intervals.expand_hits(hits, marks, "video")


@query(
    """, k AS (SELECT video, floor(s)::BIGINT AS frame, sum(value) AS value FROM shots GROUP BY ALL),
  g AS (SELECT *, sum(CASE WHEN frame - p > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame)::BIGINT AS session FROM (SELECT *, lag(frame) OVER (PARTITION BY video ORDER BY frame) AS p FROM k))
  SELECT video, session, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY ALL""",
    "shots",
)
def equal_frame_sessions(spark, sf):
    k = fx.shots(spark, sf).select("video", F.floor("s").cast("long").alias("frame"), "value")
    g = intervals.gap_sessions(intervals.merge_equal(k, "video", "frame", ["value"]), "video", "frame", 12)
    return g.groupBy("video", "session").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    """, w AS (SELECT video, idx, least(greatest((x - 0.5::DOUBLE) / 20.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS s, least(greatest((x + value / 10.0::DOUBLE - 0.5::DOUBLE) / 20.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) AS e FROM (SELECT *, s - floor(s / 24) * 24 - 1 AS x FROM shots))
  SELECT video, idx, a, least(greatest(ceil(e * 40)::BIGINT, a + 1), 40) AS b FROM (SELECT *, least(greatest(floor(s * 40)::BIGINT, 0), 39) AS a FROM w)""",
    "shots",
)
def index_window(spark, sf):
    """Windows in a sequence of 40 features over seconds 0.5 to 20.5."""
    x = F.col("s") - F.floor(F.col("s") / 24) * 24 - 1
    w = shots.index_window(x, x + F.col("value") / 10.0, F.lit(0.5), F.lit(20.5), F.lit(40))
    return fx.shots(spark, sf).select("video", "idx", w["a"].alias("a"), w["b"].alias("b"))


# datasets and faces


@query(
    """, d AS (SELECT video, min(s) AS lo, max(e) AS hi FROM shots GROUP BY video), v AS (SELECT video, idx // 4 AS event, min(s) - lo AS s, max(e) - lo AS e, list(idx ORDER BY idx) AS ids, hi - lo AS duration FROM shots JOIN d USING (video) GROUP BY video, idx // 4, lo, hi)
  SELECT video, event, least(len(ids), 3) AS n, conv_text AS caption FROM (SELECT v.*, c.text AS conv_text FROM v JOIN conversations c ON c.conv_id = video AND c.turn = event)
  WHERE s > 120 AND e < duration - 120 AND len(ids) >= 2 AND trim(conv_text) <> '' AND NOT list_has_any(ids[1:3], (SELECT list(idx) FROM (SELECT DISTINCT idx FROM shots WHERE idx % 17 = 16)))""",
    "shots",
)
def dataset_events(spark, sf):
    s = fx.shots(spark, sf)
    d = s.groupBy("video").agg(F.min("s").alias("lo"), (F.max("e") - F.min("s")).alias("duration"))
    v = s.join(d, "video").groupBy("video", F.floor(F.col("idx") / 4).alias("event"), "lo").agg((F.min("s") - F.col("lo")).alias("s"), (F.max("e") - F.col("lo")).alias("e"), F.array_sort(F.collect_list("idx")).alias("shot_ids"))
    told = src.table(spark, sf, "conversations").where("text is not null").select(F.col("conv_id").alias("video"), F.col("turn").cast("long").alias("event"), F.col("text").alias("caption"))
    out = shots.dataset_events(v, told, s.where("idx % 17 <> 16"), d.select("video", "duration"), least=2, most=3)
    return out.select("video", "event", F.col("n").cast("long").alias("n"), "caption")


@query("SELECT video, part, array_to_string(list(kind ORDER BY kind), ',') AS faces, sum(n)::BIGINT AS n FROM (SELECT video, idx // 6 AS part, kind, count(*) AS n FROM shots GROUP BY ALL HAVING count(*) >= 2) GROUP BY video, part", "shots")
def stable_faces(spark, sf):
    d = fx.shots(spark, sf).select("video", F.floor(F.col("idx") / 6).alias("part"), F.col("kind").alias("face"))
    f = shots.stable_faces(d, ["video", "part"], 2)
    return f.select("video", "part", F.array_join("face_ids", ",").alias("faces"), F.aggregate(F.map_values("face_counts"), F.lit(0).cast("long"), lambda a, b: a + b).alias("n"))


@query(
    """, g AS (SELECT video, idx // 6 AS part, kind, count(*) AS n FROM shots GROUP BY ALL), p AS (SELECT video, part, count(*) FILTER (n >= 2) AS f FROM g GROUP BY ALL)
  SELECT (SELECT count(*) FROM p) AS shots, (SELECT count(*) FROM p WHERE f > 0) AS with_faces, round((SELECT count(*) FROM p WHERE f > 0) / (SELECT count(*) FROM p)::DOUBLE, 6) AS ratio, (SELECT count(DISTINCT kind) FROM g) AS faces,
    (SELECT count(*) FROM shots) AS boundaries, (SELECT count(*) FROM shots WHERE kind <> 'error') AS valid, (SELECT round(avg(value), 6) FROM shots WHERE kind <> 'error') AS mean_change""",
    "shots",
)
def face_summary(spark, sf):
    s = fx.shots(spark, sf)
    parts = s.select("video", F.floor(F.col("idx") / 6).alias("part"), F.col("kind").alias("face"))
    faces = parts.select("video", "part").distinct().join(shots.stable_faces(parts, ["video", "part"], 2), ["video", "part"], "left")
    out = shots.face_summary(faces, s.select(F.col("value").alias("change"), (F.col("kind") != "error").alias("valid")), parts)
    return out.select("shots", "with_faces", r6("ratio").alias("ratio"), "faces", "boundaries", "valid", r6("mean_change").alias("mean_change"))


@query("SELECT doc_id AS video, doc_id IN (SELECT doc_id FROM labels) AS found FROM (SELECT DISTINCT doc_id FROM documents)")
def missing_videos(spark, sf):
    return shots.missing_videos(src.table(spark, sf, "documents").select(F.col("doc_id").alias("video")), src.table(spark, sf, "labels").select(F.col("doc_id").alias("video")))


ROUTE = """, b AS (SELECT video, idx // 5 AS frame, idx % 7 * 10.0::DOUBLE AS x1, idx % 5 * 8.0::DOUBLE AS y1, idx AS i, (idx % 3 - 1) * 9.0::DOUBLE AS angle, CASE idx % 4 WHEN 0 THEN kind WHEN 1 THEN '日本語' WHEN 2 THEN kind || ' ~~~~ ^^^^ \u00a0 ~~~~~~~~' ELSE ' ' || kind END AS text, value / 100.0::DOUBLE AS score FROM shots),
  c AS (SELECT *, (idx_in AND regexp_matches(text, '\\p{Latin}') AND NOT regexp_matches(text, '[\\p{Han}\\p{Hangul}\\p{Hiragana}\\p{Katakana}]') AND score >= 0.75
    AND length(regexp_replace(vis, '[~^]', '', 'g')) / greatest(length(vis), 1) >= 0.7) AS sub FROM (SELECT *, x1 + 5 BETWEEN 0 AND 60 AND y1 + 2 BETWEEN 0 AND 40 AND abs(angle) <= 8 AS idx_in, regexp_replace(text, '[\\s\\p{Z}]', '', 'g') AS vis FROM b))"""


@query(ROUTE + """ SELECT video, i AS idx, CASE WHEN sub AND row_number() OVER (PARTITION BY video, frame, sub ORDER BY y1, x1, i) <= 2 THEN 'subtitle' WHEN sub OR score >= 0.5 THEN 'scene' END AS route FROM c""", "shots")
def box_routing(spark, sf):
    k, i = F.col("kind"), F.col("idx")
    text = F.when(i % 4 == 0, k).when(i % 4 == 1, "日本語").when(i % 4 == 2, F.concat(k, F.lit(" ~~~~ ^^^^ \u00a0 ~~~~~~~~"))).otherwise(F.concat(F.lit(" "), k))
    b = fx.shots(spark, sf).select("video", F.floor(i / 5).alias("frame"), "idx", (i % 7 * 10.0).alias("x1"), (i % 5 * 8.0).alias("y1"), ((i % 3 - 1) * 9.0).alias("angle"), text.alias("text"), (F.col("value") / 100.0).alias("score"))
    b = b.withColumns({"x2": F.col("x1") + 10, "y2": F.col("y1") + 4})
    return shots.route_boxes(b, (0, 0, 60, 40)).select("video", "idx", "route")


@query("SELECT event_id, round(CASE WHEN a > 90 THEN a - 180 WHEN a < -90 THEN a + 180 ELSE a END, 6) AS angle FROM (SELECT event_id, degrees(atan2(value - 50, event_id % 11 - 5)) AS a FROM events)")
def box_angles(spark, sf):
    a = shots.box_angle(F.lit(0.0), F.lit(50.0), (F.col("event_id") % 11 - 5).cast("double"), F.col("value"))
    return src.table(spark, sf, "events").select("event_id", r6(a).alias("angle"))


@query(
    """, p AS (SELECT video, unnest(generate_series(1, 64)) AS p, emb FROM frames WHERE video % 2 = 0), g AS (SELECT video, p, avg(emb[p]::DOUBLE) AS a, max(emb[p]::DOUBLE) AS m FROM p GROUP BY ALL),
  n AS (SELECT video, p, a / (sqrt(sum(a * a) OVER v) + 1e-8::DOUBLE) AS a, m / (sqrt(sum(m * m) OVER v) + 1e-8::DOUBLE) AS m FROM g WINDOW v AS (PARTITION BY video))
  SELECT v.video, n.video IS NOT NULL AS has, round(coalesce(a, 0.0::DOUBLE), 6) AS mean_first, round(coalesce(m, 0.0::DOUBLE), 6) AS max_first FROM (SELECT DISTINCT video FROM frames) v LEFT JOIN n ON v.video = n.video AND p = 1""",
    "frames",
)
def vec_multi_pool(spark, sf):
    f = fx.frames(spark, sf)
    m = vx.multi_pool(f.where("video % 2 = 0"), f, "video", "emb", 64, ("mean", "max"))
    return m.select("video", "has", r6(F.col("mean")[0]).alias("mean_first"), r6(F.col("max")[0]).alias("max_first"))


# evaluation


@query(
    """, r AS (SELECT video AS query_id, CASE WHEN idx % 5 = 0 THEN NULL ELSE (video + idx % 3) END AS video, (idx * 7 % 50)::DOUBLE AS s, (idx * 7 % 50 + 4)::DOUBLE AS e, idx + 1 AS rank FROM shots),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS k FROM r WHERE video IS NOT NULL)
  SELECT t.query_id, min(k.k) FILTER (k.video = t.query_id) AS video_rank, min(k.k) FILTER (k.video = t.query_id AND least(e, 30.0) > greatest(s, 20.0)) AS first FROM (SELECT DISTINCT query_id FROM r) t LEFT JOIN k USING (query_id) GROUP BY t.query_id""",
    "shots",
)
def evaluation_ranks(spark, sf):
    s = fx.shots(spark, sf)
    results = s.select(F.col("video").alias("query_id"), F.when(F.col("idx") % 5 != 0, F.col("video") + F.col("idx") % 3).alias("video"), (F.col("idx") * 7 % 50).cast("double").alias("s"), (F.col("idx") * 7 % 50 + 4).cast("double").alias("e"), (F.col("idx") + 1).alias("rank"))
    truth = s.select(F.col("video").alias("query_id"), "video", F.lit(20.0).alias("s"), F.lit(30.0).alias("e")).distinct()
    return evaluate.ranks(results, truth).select("query_id", F.col("video_rank").cast("long").alias("video_rank"), F.col("first").cast("long").alias("first"))


@query(QUALITY % "")
def text_quality_score(spark, sf):
    return src.table(spark, sf, "conversations").select("conv_id", "turn", r6(tx.quality(F.col("text"))).alias("quality"))


# shots, frames and boxes one by one


@query(
    """, r AS (SELECT video, CASE WHEN idx % 3 > 0 THEN idx + 1000 END AS id, max(idx) OVER (PARTITION BY video) - idx AS place, s, s + value - 20 AS e, CASE WHEN idx % 4 = 0 THEN value END AS d FROM shots)
  SELECT video, coalesce(id, place) AS shot_id, round(s, 6) AS s, round(coalesce(d, greatest(0.0::DOUBLE, e - s)), 6) AS duration FROM r""",
    "shots",
)
def shot_normalise(spark, sf):
    """Shots whose columns have other names, from lists in falling order: some without an id, some with a duration, some that end before they start."""
    place = F.max("idx").over(Window.partitionBy("video")) - F.col("idx")
    r = fx.shots(spark, sf).select("video", F.when(F.col("idx") % 3 > 0, F.col("idx") + 1000).alias("id"), place.alias("place"), F.col("s").alias("start"), (F.col("s") + F.col("value") - 20).alias("end"), F.when(F.col("idx") % 4 == 0, F.col("value")).alias("duration_sec"))
    return shots.normalise(r, "video", "place").select("video", "shot_id", r6("s").alias("s"), r6("duration").alias("duration"))


@query("SELECT video, idx, round(least(greatest(idx * 7 - 5, 0), 499) / 25.0::DOUBLE, 3) AS s, round((least(greatest(idx * 7 + floor(value)::BIGINT, 0), 499) + 1) / 25.0::DOUBLE, 3) AS e FROM shots", "shots")
def frame_times(spark, sf):
    t = shots.frame_times(F.col("idx") * 7 - 5, F.col("idx") * 7 + F.floor("value").cast("long"), F.lit(25.0), F.lit(500))
    return fx.shots(spark, sf).select("video", "idx", t["s"].alias("s"), t["e"].alias("e"))


@query(
    """, r AS (SELECT video, idx, idx - 2 AS a, idx + floor(value / 10)::BIGINT - 5 AS b FROM shots),
  v AS (SELECT video, idx, a, b, list_filter(generate_series(a, b, 3), lambda f: f BETWEEN 0 AND 39) AS g FROM r),
  l AS (SELECT video, idx, CASE WHEN len(g) > 0 THEN g ELSE [least(greatest(floor((a + b) / 2.0::DOUBLE)::BIGINT, 0), 39)] END AS f FROM v)
  SELECT video, idx, len(f) AS n, list_sum(f)::BIGINT AS total FROM l""",
    "shots",
)
def step_sampling(spark, sf):
    a, b = F.col("idx") - 2, F.col("idx") + F.floor(F.col("value") / 10).cast("long") - 5
    f = fx.shots(spark, sf).select("video", "idx", shots.sample_frames(a, b, 3, F.lit(40).cast("long")).alias("f"))
    return f.select("video", "idx", F.size("f").cast("long").alias("n"), F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT vec_id, i::INT AS place, round(embedding[round(i * 63 / 15.0::DOUBLE)::INT + 1]::DOUBLE, 6) AS x FROM embeddings, range(16) r(i)")
def linspace_resample(spark, sf):
    v = src.table(spark, sf, "embeddings").select("vec_id", F.posexplode(shots.resample(F.col("embedding"), 16)).alias("place", "x"))
    return v.select("vec_id", "place", r6(F.col("x").cast("double")).alias("x"))


BOXES = """, b AS (SELECT video, idx, value - 15 AS x1, (idx % 9 * 7.0)::DOUBLE AS y1, value - 15 + 38 + idx % 12 AS x2, idx % 9 * 7.0::DOUBLE + 36 + idx % 17 AS y2, kind, value / 100.0::DOUBLE AS det_score FROM shots)"""


def _boxes(spark, sf) -> DataFrame:
    i, v = F.col("idx"), F.col("value")
    return fx.shots(spark, sf).select("video", "idx", (v - 15).alias("x1"), (i % 9 * 7.0).alias("y1"), (v - 15 + 38 + i % 12).alias("x2"), (i % 9 * 7.0 + 36 + i % 17).alias("y2"), "kind", (v / 100.0).alias("det_score"))


@query(
    BOXES
    + """, c AS (SELECT video, idx, det_score, least(greatest(x1, 0.0::DOUBLE), 100.0::DOUBLE) AS x1, least(greatest(x2, 0.0::DOUBLE), 100.0::DOUBLE) AS x2, least(greatest(y1, 0.0::DOUBLE), 80.0::DOUBLE) AS y1, least(greatest(y2, 0.0::DOUBLE), 80.0::DOUBLE) AS y2 FROM b)
  SELECT video, idx, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM c WHERE det_score >= 0.5 AND least(x2 - x1, y2 - y1) >= 40""",
    "shots",
)
def face_filter(spark, sf):
    f = shots.usable_faces(_boxes(spark, sf), F.lit(100.0), F.lit(80.0))
    return f.select("video", "idx", *(r6(c).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(
    BOXES
    + """ SELECT video, idx, round(greatest((x1 + x2) / 2 - (x2 - x1) * 1.25::DOUBLE / 2, 0.0::DOUBLE), 6) AS wide_x1, round(least((y1 + y2) / 2 + (y2 - y1) * 1.25::DOUBLE / 2, 80.0::DOUBLE), 6) AS wide_y2,
    CASE WHEN least(x2 + 5, 100.0::DOUBLE) > greatest(x1 - 5, 0.0::DOUBLE) AND least(y2 + 5, 80.0::DOUBLE) > greatest(y1 - 5, 0.0::DOUBLE) THEN round(greatest(x1 - 5, 0.0::DOUBLE), 6) END AS crop_x1 FROM b""",
    "shots",
)
def box_padding(spark, sf):
    at, most = [F.col(c) for c in ("x1", "y1", "x2", "y2")], (F.lit(100.0), F.lit(80.0))
    b = _boxes(spark, sf).select("video", "idx", shots.expand_box(*at, 1.25, *most).alias("w"), shots.crop_box(*at, *most).alias("c"))
    return b.select("video", "idx", r6("w.x1").alias("wide_x1"), r6("w.y2").alias("wide_y2"), r6("c.x1").alias("crop_x1"))


@query(BOXES + " SELECT video, idx // 6 AS frame, string_agg(kind, chr(10) ORDER BY y1, x1, kind) AS text FROM b GROUP BY ALL", "shots")
def frame_text(spark, sf):
    b = _boxes(spark, sf).select("video", F.floor(F.col("idx") / 6).cast("long").alias("frame"), "x1", "y1", F.col("kind").alias("text"))
    return shots.frame_text(b)


@query("SELECT item_id, b.item_id * 3 AS place, d.lang, d.source FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 7 - 20")
def metadata_lookup(spark, sf):
    store = src.table(spark, sf, "documents").select(((F.col("doc_id") + 20) / 7).alias("item_id"), "lang", "source").where("item_id = floor(item_id)").withColumn("item_id", F.col("item_id").cast("long"))
    asked = src.table(spark, sf, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), (F.col("item_id") * 3).cast("long").alias("place"))
    return src.get_many(store, asked)
