"""Searches in stages: each query asks for things that follow each other, each stage by several channels.

A stage's channels are fused to one score a place (a keyframe, a shot); a
query's stages, as many as it has, become one vector of scores a place; the
vectors of a video's neighbouring places are walked by a dynamic programme that
finds the best chain of stages. Batches of queries are one plan.

asked: query_id, stage (from 0, without gaps), channel: what each stage asks.
hits: query_id, stage, channel, video, place, score.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import pooling
from quern.operators.folds import fold
from quern.operators.intervals import expand_hits

#: Weights of a search by keyframes, and of a single stage.
KEYFRAME_WEIGHTS = {"text": 0.4, "ocr": 0.3, "subtitle": 0.15, "image": 0.15}
STAGE_WEIGHTS = {"text": 0.45, "ocr": 0.35, "subtitle": 0.20, "image": 0.0}

HOPS = "chain array<struct<stage:int,place:long,score:double,scores:array<double>>>"


@dataclass(frozen=True)
class Chaining:
    """gap: places that part two groups; window: places around each in which a stage finds its best; apart: least distance of two stages; skip: discount of a stage left out."""

    gap: int = 1500
    window: int = 100
    apart: int = 30
    skip: float = 0.7


SHOTS = Chaining(gap=12, window=3, apart=1)


def stage_weights(asked: DataFrame, base: dict[str, float]) -> DataFrame:
    """asked with `weight`: base weights, not negative, shared among what a stage asks so that they sum to 1; equal if all are 0."""
    w = Window.partitionBy("query_id", "stage")
    own = F.greatest(F.coalesce(F.create_map(*[F.lit(x) for kv in base.items() for x in kv])[F.col("channel")], F.lit(0.0)), F.lit(0.0))
    rows = asked.select("query_id", "stage", "channel").distinct().withColumn("_own", own)
    total = F.sum("_own").over(w)
    return rows.withColumn("weight", F.when(total > 0, F.col("_own") / total).otherwise(1.0 / F.count("*").over(w))).drop("_own")


def subtitle_places(hits: DataFrame, subtitles: DataFrame, keyframes: DataFrame) -> DataFrame:
    """hits (query_id, stage, sid, score), subtitles (sid, video, first, last), keyframes (video, place) -> hits by place, a row for each keyframe that a subtitle covers (else the nearest)."""
    ranges = subtitles.join(hits.select("sid").distinct(), "sid", "left_semi").select("video", F.col("sid").alias("id"), "first", "last")
    met = expand_hits(ranges, keyframes.select("video", F.col("place").alias("m")).distinct(), "video")
    return hits.join(met.withColumnRenamed("id", "sid"), "sid").select("query_id", "stage", F.lit("subtitle").alias("channel"), "video", F.col("m").alias("place"), "score")


def fused(hits: DataFrame, weights: DataFrame) -> DataFrame:
    """hits, stage_weights() -> query_id, stage, video, place, score, channels (normalised scores by channel): each stage's best is 1.

    A channel's scores are divided by its largest in the stage (where that isn't positive, scores other than 0 count 1);
    a place counts once a channel, at its best. Places whose weighted sum isn't positive go.
    """
    key = ["query_id", "stage"]
    best = hits.where("score is not null").groupBy(*key, "channel", "video", "place").agg(F.max("score").alias("score"))
    best = best.withColumn("score", F.when(F.col("channel").isin("ocr", "subtitle"), F.greatest("score", F.lit(0.0))).otherwise(F.col("score")))  # texts are never less than no hit
    top = best.groupBy(*key, "channel").agg(F.max("score").alias("top"))  # a row for each channel of each stage
    norm = F.when(F.col("score") == 0, 0.0).when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(1.0)
    known = top.join(weights, [*key, "channel"])
    parts = best.join(known, [*key, "channel"]).withColumn("norm", norm)
    entries = F.array_sort(F.collect_list(F.struct("channel", "norm", "weight")))  # at most one a channel; sums go in this order, so reruns agree
    sums = parts.groupBy(*key, "video", "place").agg(entries.alias("_e"))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x["weight"] * x["norm"])
    channels = F.map_from_entries(F.transform("_e", lambda x: F.struct(x["channel"], x["norm"])))
    sums = sums.select(*key, "video", "place", total.alias("score"), channels.alias("channels")).where("score > 0")
    most = sums.groupBy(*key).agg(F.max("score").alias("_most"))
    return sums.join(most, key).withColumn("score", F.col("score") / F.col("_most")).drop("_most")


def stage_search(hits: DataFrame, asked: DataFrame, k: int, base: dict[str, float] | None = None) -> DataFrame:
    """The k best places of each stage -> query_id, stage, video, place, score, visual, ocr, subtitle (normalised), rank."""
    found = fused(hits, stage_weights(asked, base or STAGE_WEIGHTS))
    w = Window.partitionBy("query_id", "stage").orderBy(F.round("score", 9).desc(), "video", "place")
    part = lambda c: F.coalesce(F.col("channels")[c], F.lit(0.0))
    out = found.select("query_id", "stage", "video", "place", "score", part("text").alias("visual"), part("ocr").alias("ocr"), part("subtitle").alias("subtitle"), F.row_number().over(w).alias("rank"))
    return out.where(F.col("rank") <= k)


def timelines(scored: DataFrame, stages: DataFrame, gap: int) -> DataFrame:
    """scored (query_id, stage, video, place, score), stages (query_id, n) -> query_id, video, session, place, scores (a number for each of n stages, 0 where it has none).

    Sessions are runs of places at most `gap` apart. A place's best score of a stage counts.
    """
    best = scored.groupBy("query_id", "video", "place", "stage").agg(F.max("score").alias("score"))
    by = best.groupBy("query_id", "video", "place").agg(F.map_from_entries(F.collect_list(F.struct(F.col("stage").cast("int").alias("stage"), "score"))).alias("_m"))
    at = F.transform(F.sequence(F.lit(0), F.col("n").cast("int") - 1), lambda i: F.coalesce(F.col("_m")[i], F.lit(0.0)))
    rows = by.join(stages, "query_id").select("query_id", "video", "place", at.alias("scores"))
    w = Window.partitionBy("query_id", "video").orderBy("place")
    new = F.when(F.col("place") - F.lag("place").over(w) > gap, 1).otherwise(0)
    return rows.withColumn("session", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def supports(place: np.ndarray, scores: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """place (ascending), scores (time, stage) -> each stage's best positive score within `window` of each time, and its time (-1: none); the first of equals.

    Each stage keeps the falling maxima of the window, so the work is times x stages.
    """
    times, stages = scores.shape
    best, at = np.zeros((times, stages)), np.full((times, stages), -1)
    ends = np.searchsorted(place, place + window, side="right")
    starts = np.searchsorted(place, place - window, side="left")
    for s in range(stages):
        column, held, taken = scores[:, s].tolist(), deque(), 0
        for t in range(times):
            while taken < ends[t]:
                if column[taken] > 0:
                    while held and column[held[-1]] < column[taken]:
                        held.pop()
                    held.append(taken)
                taken += 1
            while held and held[0] < starts[t]:
                held.popleft()
            if held:
                best[t, s], at[t, s] = column[held[0]], held[0]
    return best, at


def best_chain(place: np.ndarray, scores: np.ndarray, c: Chaining) -> tuple[float, list[tuple[int, int, float, list[float]]], int] | None:
    """The best chain over one timeline -> score, hops (stage, place, score, all stages' scores there), stages skipped; None if there is no valid one.

    A state (time, stage) starts anew, is carried, continues the stage before, or skips this stage at a discount; the first
    of them wins ties. The best state of any time and stage ends the chain. Two hops of one place, or less than `apart`
    from each other, make it invalid. Only the states of the time before and each stage's best are kept, each with its way back.
    """
    best, at = supports(place, scores, c.window)
    stages = scores.shape[1]
    empty = (0.0, 0, None, 0)  # score, last place, (hop, the hops before), skipped
    before, top, final = [empty] * stages, [empty] * stages, empty
    for t in range(len(place)):
        now = []
        for s in range(stages):
            x, where = best[t, s], at[t, s]
            here = int(place[where]) if where >= 0 else 0
            state = (x, here, ((s, here, t), None), 0) if x > 0 else empty
            if t and before[s][0] > state[0]:
                state = before[s]
            if t and s and x > 0:
                was = before[s - 1]
                if was[0] > 0 and here - was[1] >= c.apart and was[0] + x > state[0]:
                    state = (was[0] + x, here, ((s, here, t), was[2]), was[3])
            if s and c.skip * top[s - 1][0] > state[0]:
                was = top[s - 1]
                state = (c.skip * was[0], was[1], was[2], was[3] + 1)
            if state[0] > top[s][0]:
                top[s] = state
            if state[0] > final[0]:
                final = state
            now.append(state)
        before = now
    hops, link = [], final[2]
    while link:
        s, here, t = link[0]
        hops.append((s, here, float(best[t, s]), best[t].tolist()))
        link = link[1]
    hops.reverse()
    apart = all(b[1] - a[1] >= c.apart and b[1] != a[1] for a, b in zip(hops, hops[1:], strict=False))
    return (float(final[0]), hops, final[3]) if hops and apart else None


def chains(lines: DataFrame, c: Chaining, singles: bool = False) -> DataFrame:
    """timelines() -> query_id, video, session, score, matched, skipped, chain (structs stage, place, score, scores).

    Of a query of one stage, every place is a chain of one if `singles`.
    """

    def each(p: dict[str, np.ndarray]) -> list[tuple]:
        place, scores = p["place"].astype(np.int64), np.stack(p["scores"]).astype(float)
        if singles and scores.shape[1] == 1:
            return [(x, 1, 0, [{"stage": 0, "place": o, "score": x, "scores": [x]}]) for o, x in zip(place.tolist(), scores[:, 0].tolist(), strict=True)]
        found = best_chain(place, scores, c)
        if not found:
            return []
        score, hops, skipped = found
        return [(score, len(hops), skipped, [{"stage": s, "place": o, "score": x, "scores": v} for s, o, x, v in hops])]

    return fold(lines, ["query_id", "video", "session"], ["place"], ["place", "scores"], each, f"score double, matched int, skipped int, {HOPS}")


def ranked_chains(found: DataFrame, k: int, skips: bool = False) -> DataFrame:
    """A query's k best chains: by stages matched (then the fewest skipped, if `skips`), then score; ties by video, session and first place -> with rank."""
    order = [F.desc("matched"), *([F.asc("skipped")] if skips else []), F.round("score", 9).desc(), "video", "session", F.col("chain")[0]["place"]]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def temporal_search(hits: DataFrame, asked: DataFrame, k: int, base: dict[str, float] | None = None, c: Chaining | None = None) -> DataFrame:
    """Keyframe search in stages -> query_id, video, session, score, matched, skipped, chain, rank.

    A query of one stage has its best places as results, each a chain of one; others have the best chains of their stages.
    """
    c = c or Chaining()
    scored = fused(hits, stage_weights(asked, base or KEYFRAME_WEIGHTS)).drop("channels")
    stages = asked.groupBy("query_id").agg((F.max("stage") + 1).alias("n"))
    return ranked_chains(chains(timelines(scored, stages, c.gap), c, singles=True), k)


def shot_chains(scored: DataFrame, shots: DataFrame, stages: DataFrame, k: int = 30, c: Chaining = SHOTS) -> DataFrame:
    """Shot search in stages: scored (query_id, stage, shot_id, score), shots (shot_id, event_id, video, place) -> temporal_search()'s columns, with hops (stage, shot_id, event_id, place, score)."""
    lines = timelines(scored.join(shots.select("shot_id", "video", "place"), "shot_id"), stages, c.gap)
    best = ranked_chains(chains(lines, c), k, skips=True)
    each = best.select("query_id", "video", "session", "score", "matched", "skipped", "rank", F.posexplode("chain").alias("_i", "h")).withColumn("place", F.col("h.place"))
    named = each.join(shots.select("video", "place", "shot_id", "event_id"), ["video", "place"])
    hop = F.struct("_i", F.col("h.stage").alias("stage"), "shot_id", "event_id", "place", F.col("h.score").alias("score"))
    listed = F.transform(F.array_sort(F.collect_list(hop)), lambda x: x.dropFields("_i"))
    return named.groupBy("query_id", "video", "session", "score", "matched", "skipped", "rank").agg(listed.alias("chain"))


def pooled_search(
    hits: DataFrame, event_edges: DataFrame, shot_edges: DataFrame, hierarchy: DataFrame, vectors: DataFrame, queries: DataFrame, stages: DataFrame, stage_vectors: DataFrame, stage_texts: DataFrame, shots: DataFrame, c: pooling.Config | None = None, k: int = 30
) -> tuple[DataFrame, DataFrame]:
    """Pooling search with stages -> final events with `chains`, the ranks of the three best chains that pass through each; and the chains.

    The first seven arguments are pooling.pooled_search()'s; stages (query_id, n), stage_vectors (query_id, stage, emb),
    stage_texts (query_id, stage, channel, item_id, rank), shots (shot_id, event_id, video, place). Each stage is searched
    among the query's candidate shots alone. A stage's key is a struct, so the steps for queries serve stages as well.
    """
    c = c or pooling.Config()
    events = pooling.fuse(pooling.expand(hits, event_edges), c.event_weights, c.rrf_k)
    allowed = pooling.candidate_shots(events, hierarchy, c)
    keyed = F.struct("query_id", F.col("stage").cast("int").alias("stage")).alias("query_id")
    each = stages.select("query_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("stage"))
    own = allowed.join(each, "query_id").select(keyed, "shot_id")
    met = pooling.shot_hits(own, vectors, stage_vectors.select(keyed, "emb"), c.shots).unionByName(stage_texts.select(keyed, "channel", "item_id", "rank"))
    scored = pooling.stage_fusion(met, shot_edges, own, c, c.shots).select("query_id.query_id", "query_id.stage", "shot_id", F.round("score", 12).alias("score"))
    found = shot_chains(scored, shots, stages, k)
    texts = hits.where(F.col("channel").isin("subtitle", "ocr")).select("query_id", "channel", "item_id", "rank")
    fused_shots = pooling.shot_fusion(pooling.shot_hits(allowed, vectors, queries, c.shots).unionByName(texts), shot_edges, events, hierarchy, c)
    hops = found.select("query_id", "rank", "score", F.explode("chain").alias("h")).select("query_id", F.col("h.event_id").alias("event_id"), "rank", "score")
    final = pooling.final_events(events, fused_shots, hops.select("query_id", "event_id", "score"), c)
    evidence = hops.groupBy("query_id", "event_id").agg(F.slice(F.array_sort(F.collect_set("rank")), 1, 3).alias("chains"))
    return final.join(evidence, ["query_id", "event_id"], "left").withColumn("chains", F.coalesce("chains", F.array().cast("array<int>"))), found
