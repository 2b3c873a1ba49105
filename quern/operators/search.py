"""Vector and lexical search, and fusion of ranked channels."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import TOKEN, fuzzy, ngrams_of, tokenize

QUERIES = 4096  # queries whose vectors are broadcast at once
ITEMS = 1024  # items whose scores a task holds at once
PAIRS = 1 << 20  # scores of a term, a document and a query that a task holds at once


def best_of(scores: np.ndarray, items: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """scores (item, query) -> places (item, query) of each query's k best; ties to the smaller item."""
    least = np.partition(scores, len(scores) - k, axis=0)[len(scores) - k] if len(scores) > k else np.full(scores.shape[1], -np.inf)
    row, query = np.nonzero(scores >= least)
    order = np.lexsort((items[row], -scores[row, query], query))
    row, query = row[order], query[order]
    first = np.searchsorted(query, np.arange(scores.shape[1]))
    kept = np.arange(len(query)) - first[query] < k
    return row[kept], query[kept]


def knn(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors (item_id, emb), queries (query_id, emb): exact top k by inner product -> query_id, item_id, score, rank.

    Queries go to the workers in blocks of QUERIES, which bounds the broadcast;
    each task multiplies its batches by a block and keeps its own best k.
    """
    spark = vectors.sparkSession
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")

    def block(ids: list, matrix: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array(ids), matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, q = sent.value
            held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]  # query, item and score of the task's best so far
            for batch in batches:
                items = np.asarray(batch.column(0))
                x = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(items), -1)
                for at in range(0, len(items), ITEMS):
                    some = items[at : at + ITEMS]
                    s = x[at : at + ITEMS] @ q.T
                    row, who = best_of(s, some, k)
                    held = [np.concatenate(c) for c in zip(held, (who, some[row], s[row, who]), strict=True)]
                    order = np.lexsort((held[1], -held[2], held[0]))
                    held = [c[order] for c in held]
                    kept = np.arange(len(order)) - np.searchsorted(held[0], held[0]) < k
                    held = [c[kept] for c in held]
            for at in range(0, len(held[0]), 1 << 16):
                who, item, score = (c[at : at + (1 << 16)] for c in held)
                yield pa.record_batch([pa.array(keys[who]), pa.array(item), pa.array(score)], ["query_id", "item_id", "score"])

        best = vectors.where("emb is not null").select(F.col("item_id").cast("long"), "emb").mapInArrow(run, "query_id long, item_id long, score double")
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    out, ids, rows = None, [], []
    for r in queries.where("emb is not null").select("query_id", "emb").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == QUERIES:
            b = block(ids, np.array(rows, np.float64))
            out, ids, rows = b if out is None else out.unionByName(b), [], []
    if ids or out is None:
        b = block(ids, np.array(rows, np.float64).reshape(len(ids), -1)) if ids else spark.createDataFrame([], "query_id long, item_id long, score double, rank int")
        out = b if out is None else out.unionByName(b)
    return out


def model_knn(vectors: DataFrame, queries: DataFrame, models: list[str], k: int) -> DataFrame:
    """vectors (item_id and a vector a model, null: none), queries (query_id, model, emb) -> query_id, channel (the model), item_id, score, rank: exact top k of each model, by one scan for all of them.

    A task scores its batch's vectors of each model against that model's queries and keeps each one's best. Queries are
    broadcast in blocks of QUERIES, over all models.
    """
    spark = vectors.sparkSession
    w = Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "item_id")

    def block(asked: list) -> DataFrame:
        by = {m: ([r[0] for r in asked if r[1] == m], np.array([r[2] for r in asked if r[1] == m], np.float64)) for m in models}
        sent = spark.sparkContext.broadcast({m: (np.array(ids), q) for m, (ids, q) in by.items() if ids})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for m, (keys, q) in sent.value.items():
                    column = batch.column(1 + models.index(m))
                    live = np.nonzero(np.asarray(column.is_valid()))[0]
                    items = np.asarray(batch.column(0))[live]
                    x = np.asarray(column.drop_null().flatten(), np.float64).reshape(len(items), -1)
                    for at in range(0, len(items), ITEMS):
                        some = items[at : at + ITEMS]
                        s = x[at : at + ITEMS] @ q.T
                        row, who = best_of(s, some, k)
                        yield pa.record_batch([pa.array(keys[who]), pa.array([m] * len(row), pa.string()), pa.array(some[row]), pa.array(s[row, who])], ["query_id", "channel", "item_id", "score"])

        best = vectors.select(F.col("item_id").cast("long"), *models).mapInArrow(run, "query_id long, channel string, item_id long, score double")
        return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    out, held = None, []
    for r in queries.where("emb is not null").where(F.col("model").isin(models)).select("query_id", "model", "emb").toLocalIterator():
        held.append(r)
        if len(held) == QUERIES:
            out, held = block(held) if out is None else out.unionByName(block(held)), []
    if held or out is None:
        out = block(held) if out is None else out.unionByName(block(held))
    return out


def model_fusion(hits: DataFrame, models: list[str], k: int, beta: float = 0.5) -> DataFrame:
    """model_knn()'s rows -> query_id, item_id, fused, rank: exp(-beta * rank0 / k) of each model, rank 2k where one misses an item; models * product / sum. With one model, its own order and scores."""
    w = Window.partitionBy("query_id").orderBy(F.round("fused", 9).desc(), "item_id")
    if len(models) == 1:
        return hits.select("query_id", "item_id", F.col("score").alias("fused")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    own = F.exp(-beta * (F.col("rank") - 1) / float(k))
    by = hits.groupBy("query_id", "item_id").agg(F.map_from_entries(F.collect_list(F.struct("channel", own))).alias("_m"))
    scores = F.array(*(F.coalesce(F.col("_m")[m], F.exp(F.lit(-beta * 2.0))) for m in models))
    fused = by.select("query_id", "item_id", scores.alias("_s")).withColumn("fused", len(models) * F.aggregate("_s", F.lit(1.0), lambda a, x: a * x) / F.aggregate("_s", F.lit(0.0), lambda a, x: a + x)).drop("_s")
    return fused.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def subset_knn(vectors: DataFrame, queries: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """kNN among the allowed item_ids."""
    return knn(vectors.join(allowed.select("item_id").distinct(), "item_id", "left_semi"), queries, k)


def term_stats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc_id, text) -> postings (doc_id, term, tf, dl), and one row of n, avgdl."""
    tokens = docs.select("doc_id", tokenize(F.col("text")).alias("t")).withColumn("dl", F.size("t"))
    postings = tokens.select("doc_id", "dl", F.explode("t").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    lengths = docs.select(F.regexp_count(F.lower("text"), F.lit(TOKEN)).alias("dl"))
    return postings, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """docs (doc_id, text) of unique ids, queries (query_id, text): top k documents -> query_id, doc_id, score, rank. A query's repeated tokens count repeatedly.

    Two scans for each block of QUERIES queries: the first counts the documents
    of each query term, the second scores. A task scores its own documents
    against all queries of the block and keeps each one's best k, so that
    neither postings nor pairs of query and document are shuffled. Scores equal
    to nine places tie, as sums differ in their last bits.
    """
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), tokenize(F.col("text")).alias("t"))
    spark, out, held = docs.sparkSession, None, []
    for r in queries.select(F.col("query_id").cast("long").alias("query_id"), tokenize(F.col("text")).alias("t")).where("size(t) > 0").toLocalIterator():
        held.append(r)
        if len(held) == QUERIES:
            out, held = _bm25_block(tokens, held, k, k1, b) if out is None else out.unionByName(_bm25_block(tokens, held, k, k1, b)), []
    if held:
        out = _bm25_block(tokens, held, k, k1, b) if out is None else out.unionByName(_bm25_block(tokens, held, k, k1, b))
    return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int") if out is None else out


def _term_counts(tokens: pa.ListArray, terms: pa.Array) -> tuple[np.ndarray, ...]:
    """Lists of tokens -> their lengths, and list, place in `terms` and count of each list's tokens that are among the terms."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0)).astype(np.int64)
    place = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=terms), -1)).astype(np.int64)
    own = np.repeat(np.arange(len(sizes)), sizes)
    keys, tf = np.unique((own * max(1, len(terms)) + place)[place >= 0], return_counts=True)
    return sizes, keys // max(1, len(terms)), keys % max(1, len(terms)), tf


def _bm25_block(tokens: DataFrame, asked: list, k: int, k1: float, b: float) -> DataFrame:
    """bm25() for queries (query_id, t) held here; tokens (doc_id, t)."""
    spark = tokens.sparkSession
    names = sorted({t for r in asked for t in r["t"]})
    place = {t: i for i, t in enumerate(names)}
    uses = Counter((place[t], q) for q, r in enumerate(asked) for t in r["t"])
    term, query, qf = np.array([(t, q, n) for (t, q), n in sorted(uses.items())], np.int64).T
    first = np.searchsorted(term, np.arange(len(names) + 1))  # a term's queries
    terms = spark.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms.value)
        df = np.zeros(len(known) + 3, np.int64)  # then documents, those with a text, their tokens
        for batch in batches:
            sizes, _, found, _ = _term_counts(batch.column(0), known)
            df += np.append(np.bincount(found, minlength=len(known)), [len(sizes), len(sizes) - batch.column(0).null_count, sizes.sum()])
        live = np.nonzero(df)[0]
        yield pa.record_batch([pa.array(live), pa.array(df[live])], ["term", "n"])

    counted = tokens.select("t").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = np.zeros(len(names) + 3)
    for r in counted.toLocalIterator():  # a row a query term
        df[r["term"]] = r["n"]
    df, (n, texts, length) = df[:-3], df[-3:]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    sent = spark.sparkContext.broadcast((np.array([r["query_id"] for r in asked]), first, query, qf * idf[term], length / texts if length else 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(terms.value)
        ids, first, query, weight, mean = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, ITEMS):
                part = batch.slice(at, ITEMS)
                items = np.asarray(part.column(0))
                sizes, doc, found, tf = _term_counts(part.column(1), known)
                value = tf * (k1 + 1) / (tf + k1 * (1 - b + b * sizes[doc] / mean))
                uses = first[found + 1] - first[found]
                scores, ends = np.zeros(len(items) * len(ids)), np.cumsum(uses)
                lo = 0
                while lo < len(found):  # so many postings that their uses by queries are at most PAIRS, or one
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
                    n = uses[lo:hi]
                    which = np.repeat(first[found[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    scores += np.bincount(np.repeat(doc[lo:hi], n) * len(ids) + query[which], np.repeat(value[lo:hi], n) * weight[which], len(scores))
                    lo = hi
                scores = scores.reshape(len(items), len(ids))
                row, who = best_of(np.round(scores, 9), items, k)
                live = scores[row, who] > 0
                row, who = row[live], who[live]
                yield pa.record_batch([pa.array(ids[who]), pa.array(items[row]), pa.array(scores[row, who])], ["query_id", "doc_id", "score"])

    best = tokens.mapInArrow(run, "query_id long, doc_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_index(docs: DataFrame, path: str) -> None:
    """docs (doc_id, text) -> a store of postings (doc_id, term, tf, dl) by term, and of totals: documents are tokenised once for all queries."""
    postings, totals = term_stats(docs)
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    totals.write.mode("overwrite").parquet(f"{path}/totals")


def bm25_stored(path: str, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """bm25() over a store of bm25_index()."""
    spark = queries.sparkSession
    asked = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    live = spark.read.parquet(f"{path}/postings").join(asked.select("term").distinct(), "term", "left_semi")
    return scored_postings(live, spark.read.parquet(f"{path}/totals"), asked, k, k1, b)


def scored_postings(live: DataFrame, totals: DataFrame, asked: DataFrame, k: int, k1: float, b: float) -> DataFrame:
    """Postings of query terms -> query_id, doc_id, score, rank."""
    df = live.groupBy("term").agg(F.count("*").alias("df"))
    one = F.broadcast(totals.select("n", F.coalesce("avgdl", F.lit(1.0)).alias("avgdl")))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = live.join(df, "term").join(asked, "term").crossJoin(one).groupBy("query_id", "doc_id").agg(F.sum(part).alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuzzy_search(docs: DataFrame, queries: DataFrame, k: int, grams: int = 3, recall: int = 500) -> DataFrame:
    """Recall by shared grams of characters, then exact fuzzy scores; top k positive scores.

    Grams are of the text without spaces, so misread words and a query inside a longer token are candidates; a text of
    fewer characters is one gram. The `recall` documents that share most of a query's grams are scored, ties by id: the
    two steps, and the limit between them, are the operator's definition.
    """
    keys = lambda df, key: df.select(key, F.explode(ngrams_of(F.col("text"), grams)).alias("gram"))
    asked = keys(queries, "query_id")
    shared = keys(docs, "doc_id").join(asked, "gram").groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "doc_id"))
    pairs = shared.withColumn("_r", first).where(F.col("_r") <= recall).select("query_id", "doc_id")
    tasks = docs.sparkSession.sparkContext.defaultParallelism  # few rows, much work each: they are dealt to all cores
    scored = pairs.join(queries.select("query_id", F.col("text").alias("q")), "query_id").join(docs.select("doc_id", F.col("text").alias("d")), "doc_id")
    scored = scored.repartition(tasks, "query_id", "doc_id").select("query_id", "doc_id", fuzzy("q", "d").alias("score")).where("score > 0")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def rrf(rank: Column, weight: Column | float = 1.0, k: float = 60.0) -> Column:
    return (F.lit(weight) if isinstance(weight, (int, float)) else weight) / (F.lit(float(k)) + F.greatest(rank, F.lit(1)))


def server_score(score: Column, rank: Column, k: int) -> Column:
    """A server's own score; where it gives none, its order: max(k - rank + 1, 1) / max(k, 1)."""
    return F.coalesce(score, F.greatest(k - rank + 1, F.lit(1)) / float(max(k, 1)))


def accumulate(hits: DataFrame, key: list[str], weights: dict[str, float], edge: Column | float = 1.0) -> DataFrame:
    """Sums weighted reciprocal ranks of channels by item, with the evidence by channel.

    hits: the key columns, channel, rank (and what `edge` needs).
    """
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")], F.lit(0.0))
    scored = hits.withColumn("_s", rrf(F.col("rank"), weight * edge))
    by = scored.groupBy(*key, "channel").agg(F.sum("_s").alias("_s"), F.min("rank").alias("_r"))
    evidence = F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", F.struct(F.col("_r").alias("rank"), F.col("_s").alias("score"))))))
    return by.groupBy(*key).agg(F.sum("_s").alias("score"), evidence.alias("evidence"))


def with_prior(shots: DataFrame, events: DataFrame, prior: float = 0.2) -> DataFrame:
    """Adds prior * the parent event's score (event_id, score) to touched shots (shot_id, event_id, score)."""
    parent = events.select("event_id", F.col("score").alias("_e"))
    return shots.join(parent, "event_id", "left").withColumn("score", F.col("score") + F.coalesce(F.when(F.col("_e") > 0, prior * F.col("_e")), F.lit(0.0))).drop("_e")


def channel_weights(base: dict[str, float], active: list[str]) -> dict[str, float]:
    """Base weights, not negative, over the active channels, summing to 1; equal if all are 0."""
    w = {c: max(0.0, base.get(c, 0.0)) for c in active}
    total = sum(w.values())
    return {c: x / total for c, x in w.items()} if total else {c: 1 / len(active) for c in active}


def max_norm_fusion(hits: DataFrame, weights: dict[str, float], key: str = "item_id") -> DataFrame:
    """Raw scores over their channel's largest, weighted, positive sums over the largest sum. Repeats of an item count once, at their best."""
    best = hits.groupBy(key, "channel").agg(F.max("score").alias("score")).where("score > 0")
    top = best.groupBy("channel").agg(F.max("score").alias("top"))
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")], F.lit(0.0))
    fused = best.join(F.broadcast(top), "channel").groupBy(key).agg(F.sum(weight * F.col("score") / F.col("top")).alias("fused")).where("fused > 0")
    most = fused.agg(F.max("fused").alias("_most"))  # one row, combined on the map side
    return fused.crossJoin(F.broadcast(most)).withColumn("fused", F.col("fused") / F.col("_most")).drop("_most")


def rank_decay_fusion(hits: DataFrame, k: int, beta: float = 0.5, key: str = "item_id") -> DataFrame:
    """exp(-beta * rank0 / k) by model, rank 2k where a model misses an item: models * product / sum. A single model keeps its own scores."""
    models = hits.agg(F.count_distinct("channel")).first()[0]
    missing = F.exp(F.lit(-beta * 2.0))
    score = F.exp(-beta * (F.col("rank") - 1) / float(k))
    by = hits.groupBy(key, "channel").agg(F.max(score).alias("s"))
    both = by.groupBy(key).agg(F.sum(F.log("s")).alias("l"), F.sum("s").alias("t"), F.count("*").alias("c"))
    if models <= 1:
        return both.select(key, F.col("t").alias("fused"))
    gap = models - F.col("c")
    return both.select(key, (models * F.exp(F.col("l") + gap * F.log(missing)) / (F.col("t") + gap * missing)).alias("fused"))


def roll_up(items: DataFrame, parent: str, most: int | None = None) -> DataFrame:
    """A parent's score is its best item's; parents are ranked. With `most`, tasks keep that many each before the one that ranks them."""
    best = items.groupBy(parent).agg(F.max("score").alias("score"))
    if most:
        best = best.orderBy(F.desc("score"), parent).limit(most)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), parent)))


def candidates(top_events: DataFrame, top_videos: DataFrame, shots: DataFrame) -> DataFrame:
    """Shots of the top events or of the top videos."""
    a = shots.join(top_events.select("event_id"), "event_id", "left_semi").select("shot_id")
    b = shots.join(top_videos.select("video_id"), "video_id", "left_semi").select("shot_id")
    return a.union(b).distinct()
