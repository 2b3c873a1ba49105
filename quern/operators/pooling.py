"""Pooling search: channels of hits fused to events, then shots of the best events and videos, then final events.

Everything is by query_id, so a batch of queries is one plan. hits: query_id,
channel, item_id, rank. Edges lead from an item of a channel (a subtitle, an
OCR text) to what it touches, with a weight; a channel without edges hits its
target itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import vectors as vx
from quern.operators.search import rrf


@dataclass(frozen=True)
class Config:
    """Weights of channels and numbers of candidates."""

    event_weights: dict[str, float] = field(default_factory=lambda: {"event": 1.0, "caption": 0.8, "subtitle": 0.6, "ocr": 0.4})
    shot_weights: dict[str, float] = field(default_factory=lambda: {"shot": 0.8, "subtitle": 0.6, "ocr": 0.4})
    stage_weights: dict[str, float] = field(default_factory=lambda: {"shot": 0.45, "ocr": 0.35, "subtitle": 0.20})
    prior: float = 0.2
    rrf_k: float = 60.0
    events: int = 100
    videos: int = 30
    shots: int = 100
    final: int = 30


def route(queries: DataFrame) -> DataFrame:
    """queries (query_id, raw, translated, subtitle, ocr) -> query_id, visual, caption, subtitle, ocr: what each channel asks, null if nothing.

    Pictures are asked by the translation, else the raw text; OCR by its own text, else the raw one.
    """
    clean = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    return queries.select("query_id", F.coalesce(clean("translated"), clean("raw")).alias("visual"), clean("raw").alias("caption"), clean("subtitle").alias("subtitle"), F.coalesce(clean("ocr"), clean("raw")).alias("ocr"))


def expand(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits and edges (channel, item_id, target, weight) -> query_id, channel, target, rank, weight. Channels without edges hit their items with weight 1."""
    direct = hits.join(edges.select("channel").distinct(), "channel", "left_anti")
    met = hits.join(edges, ["channel", "item_id"]).select("query_id", "channel", "target", "rank", "weight")
    return direct.select("query_id", "channel", F.col("item_id").alias("target"), "rank", F.lit(1.0).alias("weight")).unionByName(met)


def fuse(touched: DataFrame, weights: dict[str, float], k: float = 60.0) -> DataFrame:
    """expand()'s rows -> query_id, target, score: weighted reciprocal ranks, summed."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")], F.lit(0.0))
    return touched.groupBy("query_id", "target").agg(F.sum(rrf(F.col("rank"), weight * F.col("weight"), k)).alias("score"))


def ranked(scores: DataFrame, *order: Column | str, most: int | None = None) -> DataFrame:
    """scores with their rank in the query, by score to nine places and then `order`."""
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), *order)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= most) if most else out


def candidate_shots(events: DataFrame, hierarchy: DataFrame, c: Config) -> DataFrame:
    """events (query_id, target, score) -> query_id, shot_id: shots of the query's best events and of the best videos, whose score is their best event's."""
    parents = hierarchy.select(F.col("event_id").alias("target"), "video_id").distinct()
    top = ranked(events, "target", most=c.events)
    videos = events.join(parents, "target").groupBy("query_id", "video_id").agg(F.max("score").alias("score"))
    videos = ranked(videos, "video_id", most=c.videos).select("query_id", "video_id")
    a = top.select("query_id", F.col("target").alias("event_id")).join(hierarchy, "event_id").select("query_id", "shot_id")
    return a.unionByName(videos.join(hierarchy, "video_id").select("query_id", "shot_id")).distinct()


def shot_hits(allowed: DataFrame, vectors: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """allowed (query_id, shot_id), vectors (item_id, emb), queries (query_id, emb) -> the best `most` allowed shots by inner product, as hits of channel `shot`."""
    v, q = vectors.select(F.col("item_id").alias("shot_id"), "emb"), queries.select("query_id", F.col("emb").alias("_q"))
    scored = allowed.join(v, "shot_id").join(q, "query_id").select("query_id", F.col("shot_id").alias("item_id"), vx.dot(F.col("_q"), F.col("emb")).alias("score"))
    return ranked(scored, "item_id", most=most).select("query_id", F.lit("shot").alias("channel"), "item_id", "rank")


def shot_fusion(hits: DataFrame, edges: DataFrame, events: DataFrame, hierarchy: DataFrame, c: Config) -> DataFrame:
    """hits of shots, subtitles and OCR, with edges to shots -> query_id, shot_id, event_id, score, the parent event's prior included."""
    fused = fuse(expand(hits, edges), c.shot_weights, c.rrf_k).withColumnRenamed("target", "shot_id")
    prior = events.select("query_id", F.col("target").alias("event_id"), F.col("score").alias("_e"))
    out = fused.join(hierarchy.select("shot_id", "event_id"), "shot_id").join(prior, ["query_id", "event_id"], "left")
    return out.select("query_id", "shot_id", "event_id", (F.col("score") + F.coalesce(F.when(F.col("_e") > 0, c.prior * F.col("_e")), F.lit(0.0))).alias("score"))


def stage_fusion(hits: DataFrame, edges: DataFrame, allowed: DataFrame, c: Config, most: int = 100) -> DataFrame:
    """A stage's hits fused on allowed shots alone (query_id, shot_id) -> query_id, shot_id, score, rank."""
    touched = expand(hits, edges).join(allowed.select("query_id", F.col("shot_id").alias("target")), ["query_id", "target"], "left_semi")
    return ranked(fuse(touched, c.stage_weights, c.rrf_k), "target", most=most).withColumnRenamed("target", "shot_id")


def final_events(events: DataFrame, shots: DataFrame, chains: DataFrame | None, c: Config) -> DataFrame:
    """events (query_id, target, score), shots (query_id, shot_id, event_id, score), chains (query_id, event_id, score: a row for each item of a chain)
    -> query_id, event_id, score, rank, top_shots (five): an event's score, its best shot's, and the scores of the chains for each item of theirs in it."""
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("score"), "shot_id")))
    by_shot = shots.groupBy("query_id", "event_id").agg(F.max("score").alias("_s"), F.slice(F.transform(best, lambda x: x["shot_id"]), 1, 5).alias("top_shots"))
    out = events.select("query_id", F.col("target").alias("event_id"), "score").join(by_shot, ["query_id", "event_id"], "full")
    total = F.coalesce("score", F.lit(0.0)) + F.coalesce("_s", F.lit(0.0))
    if chains is not None:
        out = out.join(chains.groupBy("query_id", "event_id").agg(F.sum("score").alias("_c")), ["query_id", "event_id"], "full")
        total = total + F.coalesce("_c", F.lit(0.0))
    return ranked(out.select("query_id", "event_id", total.alias("score"), "top_shots"), "event_id", most=c.final)


def pooled_search(hits: DataFrame, event_edges: DataFrame, shot_edges: DataFrame, hierarchy: DataFrame, vectors: DataFrame, queries: DataFrame, chains_of=None, c: Config | None = None) -> DataFrame:
    """End to end: events from hits, candidates, shots by vector and edges, chains_of(shots) if given, final events."""
    c = c or Config()
    events = fuse(expand(hits, event_edges), c.event_weights, c.rrf_k)
    found = shot_hits(candidate_shots(events, hierarchy, c), vectors, queries, c.shots)
    texts = hits.where(F.col("channel").isin("subtitle", "ocr")).select("query_id", "channel", "item_id", "rank")
    shots = shot_fusion(found.unionByName(texts), shot_edges, events, hierarchy, c)
    return final_events(events, shots, chains_of(shots) if chains_of else None, c)


def truncated(results: DataFrame, most: dict[str, int], kind: str = "kind") -> DataFrame:
    """Payloads: of each query and kind of row the first `most[kind]` by rank; kinds not named go."""
    limit = F.create_map(*[F.lit(x) for kv in most.items() for x in kv])[F.col(kind)]
    return results.where(F.col("rank") <= F.coalesce(limit, F.lit(0)))
