"""Order-dependent folds: one group (a video, or a query's session) at a time.

Rows are dealt by group and sorted, by a window; a task then walks
batches of many groups and holds back the last one, which may go on. So small
groups cost no call each, and a task's memory is bounded by its largest group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import quality_score, similarity


def fold(rows: DataFrame, group: list[str], order: list[str], columns: list[str], each: Callable[[dict[str, np.ndarray]], list[tuple]], out: str) -> DataFrame:
    """Each group's rows in order, as arrays by column -> tuples, which follow the group's columns; out: their schema."""
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), out])
    names = [*group, *(f.split()[0] for f in out.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # parts of the group that may go on; they are put together once, when it ends

        def made(whole: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
            arrays, out = {c: whole[c].to_numpy() for c in {*group, *columns}}, []
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                key = tuple(arrays[g][a] for g in group)
                out += [(*key, *row) for row in each({c: arrays[c][a:b] for c in columns})]
            return pd.DataFrame(out, columns=names)

        def ended() -> pd.DataFrame:
            whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            return made(whole, np.array([0, len(whole)]))

        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), bool)
            for g in group:  # null is a key like others
                key, none = batch[g].to_numpy(), batch[g].isna().to_numpy()
                new[1:] |= (key[1:] != key[:-1]) & ~(none[1:] & none[:-1])
                if held:
                    last = held[-1][g].iloc[-1]
                    new[0] |= bool(key[0] != last) and not (none[0] and pd.isna(last))
            starts = np.nonzero(new)[0] if held else np.append(0, np.nonzero(new[1:])[0] + 1)
            if held and len(starts):
                if starts[0]:
                    held.append(batch.iloc[: starts[0]])
                yield ended()
                held = []
            if len(starts):
                yield made(batch, starts)
                held = [batch.iloc[starts[-1] :]]
            else:
                held.append(batch)
        if held:
            yield ended()

    # a window, not repartition(): Spark drops a repartition over a union dealt by the group, and may then coalesce the union's sides each its own way
    w = Window.partitionBy(*group).orderBy(*(order or group))
    dealt = rows.select(*dict.fromkeys([*group, *order, *columns]), F.row_number().over(w).alias("_n"))
    return dealt.mapInPandas(run, schema)


def cut_events(duration: np.ndarray, starts: np.ndarray, ends: np.ndarray, reward: np.ndarray, low: float, high: float) -> list[tuple[int, int]] | None:
    """Segments [a, b) of low..high seconds with the largest sum of rewards at inner cuts; ties keep the earliest start. None: impossible.

    reward[i]: of a cut after shot i. A segment's start is bounded by its duration, so the work is shots x segment length.
    """
    n = len(starts)
    best, back = np.full(n + 1, -np.inf), np.full(n + 1, -1)
    best[0], first = 0.0, 0
    for end in range(1, n + 1):
        while first < end - 1 and ends[end - 1] - starts[first] > high:
            first += 1
        span = ends[end - 1] - starts[first:end]
        gain = np.where((span >= low) & (span <= high), best[first:end], -np.inf)
        a = int(np.argmax(gain))
        if gain[a] > -np.inf:
            best[end], back[end] = gain[a] + (reward[end - 1] if end < n else 0.0), first + a
    if back[n] < 0:
        return None
    out, at = [], n
    while at:
        out.append((int(back[at]), at))
        at = int(back[at])
    return out[::-1]


def segments(starts: np.ndarray, ends: np.ndarray, reward: np.ndarray, low: float = 3.0, high: float = 30.0) -> list[tuple[int, int]]:
    """Whole timelines: a shot over `high` seconds is an event of its own; what is too short before or after it joins a neighbour.

    A stretch without valid cuts is one event.
    """
    n, out, at, held = len(starts), [], 0, None

    def stretch(a: int, b: int) -> None:
        found = cut_events(ends[a:b] - starts[a:b], starts[a:b], ends[a:b], reward[a:b], low, high)
        out.extend((a + i, a + j) for i, j in found or [(0, b - a)])

    for long in [*np.nonzero(ends - starts > high)[0].tolist(), n]:
        if at < long:
            if ends[long - 1] - starts[at] >= low or (long == n and not out):
                stretch(at, long)
            elif out:
                out[-1] = (out[-1][0], long)
            else:
                held = at
        if long < n:
            out.append((long if held is None else held, long + 1))
            held = None
        at = long + 1
    return out


def segment_events(boundaries: DataFrame, key: str, cut_penalty: float = 0.55, other_penalty: float = 0.25, low: float = 3.0, high: float = 30.0, ends: bool = False) -> DataFrame:
    """boundaries (key, idx, s, e, score, is_candidate, penalty), a row a shot -> key, event, first, last (inclusive); with `ends` also end_score and end_is_candidate, those of the last shot's cut (null if it has none)."""

    def each(p: dict[str, np.ndarray]) -> list[tuple]:
        free = np.where(pd.isna(p["is_candidate"]), False, p["is_candidate"]).astype(bool)
        reward = np.nan_to_num(p["score"].astype(float)) - cut_penalty - np.where(free, 0, other_penalty) - np.nan_to_num(p["penalty"].astype(float))
        cut = lambda b: tuple(None if pd.isna(p[c][b - 1]) else p[c][b - 1] for c in ("score", "is_candidate")) if ends else ()
        return [(i, int(p["idx"][a]), int(p["idx"][b - 1]), *cut(b)) for i, (a, b) in enumerate(segments(p["s"], p["e"], reward, low, high))]

    out = "event long, first long, last long" + (", end_score double, end_is_candidate boolean" if ends else "")
    return fold(boundaries, [key], ["idx"], ["idx", "s", "e", "score", "is_candidate", "penalty"], each, out)


def chain(score: np.ndarray, order: np.ndarray, gap: int, skip: float) -> tuple[float, list[tuple[int, int]], int]:
    """Best chain of stages over a timeline: (score, [(stage, order)], skipped).

    score, order: (time, stage), each stage's support near a time. A state starts anew, is carried, continues the stage
    before if `gap` apart, or skips the stage at a discount; the first of them wins ties. The best state of any time and stage ends the chain. Only the states of the time
    before and each stage's best so far are needed, so a state holds its own way back.
    """
    stages = score.shape[1]
    empty = (0.0, -1, None, 0)  # score, last order, (hop, the hops before), skipped
    before, top, final = [empty] * stages, [empty] * stages, empty
    for t, (support, places) in enumerate(zip(score.tolist(), order.tolist(), strict=True)):
        now = []
        for s, (x, o) in enumerate(zip(support, places, strict=True)):
            state = (x, o, ((s, o), None), 0) if x > 0 else empty
            if t:
                if before[s][0] > state[0]:
                    state = before[s]
                if s and x > 0:
                    was = before[s - 1]
                    if was[0] > 0 and o - was[1] >= gap and was[0] + x > state[0]:
                        state = (was[0] + x, o, ((s, o), was[2]), was[3])
            if s and skip * top[s - 1][0] > state[0]:
                was = top[s - 1]
                state = (skip * was[0], was[1], was[2], was[3] + 1)
            if state[0] > top[s][0]:
                top[s] = state
            if state[0] > final[0]:
                final = state
            now.append(state)
        before = now
    total, _, link, skipped = final
    hops = []
    while link:
        hops.append(link[0])
        link = link[1]
    return total, hops[::-1], skipped if hops else 0


def temporal_chains(supports: DataFrame, group: list[str], stages: int, gap: int = 1, skip: float = 0.7) -> DataFrame:
    """supports (group, ord, s0.., o0..) -> group, score, matched, skipped, chain ("stage:order" joined by '>'). Invalid chains go."""
    scores, orders = [f"s{i}" for i in range(stages)], [f"o{i}" for i in range(stages)]

    def each(p: dict[str, np.ndarray]) -> list[tuple]:
        score = np.nan_to_num(np.stack([p[c].astype(float) for c in scores], 1))
        order = np.nan_to_num(np.stack([p[c].astype(float) for c in orders], 1), nan=-1).astype(np.int64)
        total, hops, skipped = chain(score, order, gap, skip)
        at = [o for _, o in hops]
        ok = hops and all(b - a >= gap for a, b in zip(at, at[1:], strict=False))
        return [(total, len(hops), skipped, ">".join(f"{s}:{o}" for s, o in hops))] if ok else []

    return fold(supports, group, ["ord"], [*scores, *orders], each, "score double, matched int, skipped int, chain string")


def greedy_keyframes(frames: DataFrame, key: str, threshold: float = 0.9) -> DataFrame:
    """frames (key, idx, emb) -> key, idx of those whose cosine to the last kept one is below the threshold."""

    def each(p: dict[str, np.ndarray]) -> list[tuple]:
        x = np.stack(p["emb"]).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]
        kept = [0]
        for i in range(1, len(x)):
            if x[kept[-1]] @ x[i] < threshold:
                kept.append(i)
        return [(int(i),) for i in p["idx"][kept]]

    return fold(frames, [key], ["idx"], ["idx", "emb"], each, "idx long")


def pools(x: np.ndarray, temperature: float) -> tuple[list[float], list[float], list[float]]:
    """Unit mean, unit maximum, and softmax around the centre of the unit vectors."""
    unit = lambda v: v / (np.linalg.norm(v, axis=-1, keepdims=True) + 1e-8)
    u = unit(x)
    score = temperature * (u @ unit(u.mean(0)))
    weight = np.exp(score - score.max())
    return unit(x.mean(0)).tolist(), unit(x.max(0)).tolist(), unit(weight @ u / weight.sum()).tolist()


def multi_pools(rows: DataFrame, group: list[str], vectors: list[str], d: int, temperature: float = 15.0) -> DataFrame:
    """rows (group, vectors, null: none) -> group and, for each kind of vector v, has_v, v_mean, v_max, v_soft: zeros of length d where a group has none. All kinds in one pass; for groups that fit a task, such as events."""
    empty = ([0.0] * d,) * 3

    def each(p: dict[str, np.ndarray]) -> list[tuple]:
        out: list = []
        for v in vectors:
            live = [x for x in p[v] if x is not None]
            out += [bool(live), *(pools(np.stack(live).astype(float), temperature) if live else empty)]
        return [tuple(out)]

    schema = ", ".join(f"has_{v} boolean, {v}_mean array<double>, {v}_max array<double>, {v}_soft array<double>" for v in vectors)
    return fold(rows, group, [], vectors, each, schema)


def leader_clusters(items: DataFrame, key: str, threshold: float = 0.45) -> DataFrame:
    """items (key, idx, emb) in order -> key, idx, cluster: the nearest centroid if near enough, else a new one."""

    def each(p: dict[str, np.ndarray]) -> list[tuple]:
        x = np.stack(p["emb"]).astype(float)
        sums, centres, counts, out = np.empty_like(x), np.empty_like(x), 0, []
        for i, v in zip(p["idx"].tolist(), x, strict=True):
            near = centres[:counts] @ v
            c = int(np.argmax(near)) if counts else -1
            if counts and near[c] >= threshold:
                sums[c] += v
                centres[c] = sums[c] / max(np.linalg.norm(sums[c]), 1e-12)  # the mean's length drops out
            else:
                c, counts = counts, counts + 1
                sums[c] = centres[c] = v
            out.append((i, c))
        return out

    return fold(items, [key], ["idx"], ["idx", "emb"], each, "idx long, cluster long")


def position_clusters(boxes: DataFrame, key: str, radius: float = 30.0, ratio: float = 0.3) -> DataFrame:
    """boxes (key, frame, idx, x, y): a position within `radius` of a cluster's centre moves it by its distance over the cluster's frames, itself counted; clusters in `ratio` of the frames stay -> key, x, y, frames."""

    def each(p: dict[str, np.ndarray]) -> list[tuple]:
        found: list[list] = []
        for frame, x, y in zip(p["frame"].tolist(), p["x"].tolist(), p["y"].tolist(), strict=True):
            near = next((c for c in found if math.hypot(c[0] - x, c[1] - y) <= radius), None)
            if near is None:
                found.append([x, y, {frame}])
            else:
                near[2].add(frame)
                near[0] += (x - near[0]) / len(near[2])
                near[1] += (y - near[1]) / len(near[2])
        total = len(set(p["frame"].tolist()))
        return [(x, y, len(f)) for x, y, f in found if len(f) >= ratio * total]

    return fold(boxes, [key], ["frame", "idx"], ["frame", "x", "y"], each, "x double, y double, frames long")


def without_logos(boxes: DataFrame, logos: DataFrame, key: str, radius: float = 30.0) -> DataFrame:
    """boxes (key, x, y, ...) that lie further than `radius` from all of the key's logo positions (key, x, y)."""
    columns = boxes.columns
    centres = logos.groupBy(key).agg(F.collect_list(F.struct("x", "y")).alias("_logos"))
    near = F.exists(F.col("_logos"), lambda c: F.hypot(c["x"] - F.col("x"), c["y"] - F.col("y")) <= radius)
    return boxes.join(centres, key, "left").where(~F.coalesce(near, F.lit(False))).select(*columns)


def merge_runs(texts: DataFrame, key: str, near: float = 0.8, gap: int = 12) -> DataFrame:
    """texts (key, frame, text): a run goes on while a text is like its best one so far and the frames are near -> key, first, last, text."""

    def each(p: dict[str, np.ndarray]) -> list[tuple]:
        out: list[list] = []
        for frame, text in zip(p["frame"].tolist(), p["text"], strict=True):
            if out and frame - out[-1][1] <= gap and similarity(out[-1][2], text) >= near:
                out[-1][1] = frame
                if (quality_score(text), len(text)) > (quality_score(out[-1][2]), len(out[-1][2])):
                    out[-1][2] = text
            else:
                out.append([frame, frame, text])
        return [tuple(r) for r in out]

    return fold(texts, [key], ["frame"], ["frame", "text"], each, "first long, last long, text string")
