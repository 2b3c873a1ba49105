"""Extensions over append streams: gap sessions, and greedy keyframes with carried state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Sessions that end after `gap` without a row; rows later than `late` behind the newest are dropped."""
    w = F.session_window(time, gap)
    return events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_keyframes(frames: DataFrame, key: str, threshold: float = 0.9) -> DataFrame:
    """frames (key, idx, emb), in order by batch: keeps a frame whose cosine to the key's last kept one is below the threshold."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = np.array(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("idx")
        kept = []
        for idx, emb in rows[["idx", "emb"]].itertuples(index=False):
            v = np.asarray(emb, float)
            v = v / max(np.linalg.norm(v), 1e-12)
            if last is None or last @ v < threshold:
                last = v
                kept.append((k[0], idx))
        if last is not None:
            state.update((last.tolist(),))
        yield pd.DataFrame(kept, columns=[key, "idx"])

    return frames.groupBy(key).applyInPandasWithState(run, f"{key} long, idx long", "emb array<double>", "append", "NoTimeout")
