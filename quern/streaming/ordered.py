"""Ordered operators over append streams: rows wait until the watermark has passed them, so any cut of the input into batches gives the batch operators' results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from quern.functions.text import quality_score, similarity

#: The state store that these operators need; set it on the session.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

Step = Callable[[tuple | None, tuple], tuple[tuple | None, list[tuple]]]


class Ordered(StatefulProcessor):
    """Walks a key's rows in order with a carried state.

    step(state, row) -> state, rows that are done. due(state): the millisecond from which no row that can still come
    changes it; close(state) then gives its last rows, and the state goes. Only rows that the watermark hasn't passed are held.
    """

    def __init__(self, columns: int, held: str, carried: str, out: list[str], step: Step, due: Callable[[tuple], int] | None = None, close: Callable[[tuple], list[tuple]] | None = None) -> None:
        self.columns, self.held, self.carried, self.out = columns, held, carried, out
        self.step, self.due, self.close_state = step, due, close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)
        self.state = handle.getValueState("state", self.carried)

    def close(self) -> None:
        pass

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            new = list(part.iloc[:, -self.columns :].itertuples(index=False, name=None))  # columns come without their names
            if new:
                self.rows.appendList([plain(r) for r in new])
                least = min(r[0] for r in new)
                first = least if first is None else min(first, least)
        if first is not None:
            self.handle.registerTimer(int(first))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        rows = sorted((tuple(r) for r in self.rows.get()), key=lambda r: r[:2])
        ready = [r for r in rows if r[0] <= passed]
        later = rows[len(ready) :]
        state, done = tuple(self.state.get()) if self.state.exists() else None, []
        for row in ready:
            state, some = self.step(state, row)
            done += some
        if state is not None and self.due and self.due(state) <= passed:
            done += self.close_state(state)
            state = None
        if ready:
            self.rows.clear()
            if later:
                self.rows.put(later)
        if later:
            self.handle.registerTimer(int(later[0][0]))
        if state is None:
            self.state.clear()
        else:
            self.state.update(plain(state))
            if self.due:
                self.handle.registerTimer(int(self.due(state)))
        if done:
            yield pd.DataFrame([(*key, *r) for r in done], columns=self.out)


def plain(row: tuple) -> tuple:
    """Values as the state store takes them."""

    def value(x: Any) -> Any:
        if isinstance(x, np.ndarray):
            return [value(v) for v in x]
        return x.item() if isinstance(x, np.generic) else x

    return tuple(value(x) for x in row)


def ordered(df: DataFrame, key: str, time: str, late: str, place: str, columns: list[str], carried: str, out: str, step: Step, due: Callable[[tuple], int] | None = None, close: Callable[[tuple], list[tuple]] | None = None) -> DataFrame:
    """Each key's rows by time, then place, through step, as (time in ms, place, columns). Rows without key, time or place are left out, and rows that come once the watermark (`late` behind the newest time, and the epoch at first) has reached them are dropped."""
    kinds = dict(df.dtypes)
    taken = [place, *columns]
    ms = f"cast(ceil(unix_micros({time}) / 1000) as bigint) as _ms"  # a row isn't taken before the watermark has passed all of it
    rows = df.where(f"{key} is not null and {time} is not null and {place} is not null").withWatermark(time, late).selectExpr(key, time, ms, *(f"{c} as _{i}" for i, c in enumerate(taken)))
    held = ", ".join(["ms bigint", *(f"c{i} {kinds[c]}" for i, c in enumerate(taken))])
    schema = StructType.fromDDL(f"{key} {kinds[key]}, {out}")
    processor = Ordered(1 + len(taken), held, carried, schema.names, step, due, close)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def stream_equal_sessions(hits: DataFrame, key: str, time: str, late: str, place: str, score: str, gap: int, hold_ms: int) -> DataFrame:
    """intervals.merge_equal(), then gap_sessions() -> key, first, last, places, score: a session is told once it is closed.

    Places step by at most `gap` in a session. `hold_ms` is the time after which no row can continue it: the longest that a step of `gap` takes.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        ms, at, s = row
        s = 0.0 if s is None or s != s else float(s)
        if state and at - state[2] <= gap:
            return (ms, state[1], at, state[3] + (at != state[2]), state[4] + s), []
        return (ms, at, at, 1, s), [state[1:]] if state else []

    return ordered(
        hits, key, time, late, place, [score], "ms bigint, first bigint, last bigint, places bigint, score double",
        "first bigint, last bigint, places bigint, score double", step, lambda s: s[0] + hold_ms, lambda s: [s[1:]],
    )


def stream_leader_clusters(items: DataFrame, key: str, time: str, late: str, threshold: float = 0.45) -> DataFrame:
    """folds.leader_clusters() of items (key, idx, time, emb), in order of time, then idx -> key, idx, cluster, told once the watermark has passed an item. A key's clusters stay."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        _, idx, emb = row
        v, sums = np.array(emb, float), np.array(state[0], float) if state else np.zeros((0, len(emb)))
        near = (sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]) @ v if state else np.zeros(0)
        best = int(near.argmax()) if state else -1
        if state and near[best] >= threshold:
            sums[best] += v
        else:
            best, sums = len(sums), np.vstack([sums, v])
        return (sums.tolist(),), [(idx, best)]

    return ordered(items.where("emb is not null"), key, time, late, "idx", ["emb"], "sums array<array<double>>", "idx bigint, cluster bigint", step)


def stream_merge_runs(texts: DataFrame, key: str, time: str, late: str, hold_ms: int, near: float = 0.8, gap: int = 12) -> DataFrame:
    """folds.merge_runs() of texts (key, frame, time, text), in order of time, then frame -> key, first, last, text, told once a run is closed; hold_ms: the longest that `gap` frames take. A null text is empty."""

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        ms, frame, text = row
        text = text or ""
        if state and frame - state[2] <= gap and similarity(state[3], text) >= near:
            better = (quality_score(text), len(text)) > (quality_score(state[3]), len(state[3]))
            return (ms, state[1], frame, text if better else state[3]), []
        return (ms, frame, frame, text), [state[1:]] if state else []

    return ordered(
        texts, key, time, late, "frame", ["text"], "ms bigint, first bigint, last bigint, text string",
        "first bigint, last bigint, text string", step, lambda s: s[0] + hold_ms, lambda s: [s[1:]],
    )
