"""Scores, persistence and alerts on a stream of events (an extension: the batch operators over
data as it arrives)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def alerts(events: DataFrame, settings: DataFrame, *, window: int = 3, count: int = 2, key: str = "series_id", ts: str = "ts", value: str = "value", delay: str = "1 hour") -> DataFrame:
    """Each event with its lag-1 ``score``, and ``alert``: ``count`` of the last ``window`` scores
    at the series' threshold or above.

    ``settings`` has a row for each series: ``std``, ``threshold``. A series' state is its last
    value and its last ``window`` hits, however long it runs. Events of a micro-batch are taken in
    order of time; those later than ``delay`` behind the newest are dropped by the watermark.
    """
    rows = events.withWatermark(ts, delay).join(settings, key).select(F.col(key).cast("string").alias("key"), F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"), "std", "threshold")

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, hits = state.get if state.exists else (None, [])
        frame = pd.concat(list(frames)).sort_values("ts", kind="stable")
        scores, flags = [], []
        for v, std, threshold in zip(frame["value"], frame["std"], frame["threshold"], strict=True):
            score = None if last is None else gaussian_score(v - last, std)
            hits = [*hits, int(score is not None and score >= threshold)][-window:]
            last = float(v)
            scores.append(score)
            flags.append(int(sum(hits) >= count))
        state.update((last, hits))
        yield pd.DataFrame({"series_id": own[0], "ts": frame["ts"], "score": pd.Series(scores, frame.index, dtype=float), "alert": flags})

    return rows.groupBy("key").applyInPandasWithState(step, "series_id string, ts timestamp, score double, alert int", "last double, hits array<int>", "append", GroupStateTimeout.NoTimeout)


def gaussian_score(difference: float, std: float) -> float:
    import math

    return 0.5 * (difference / std) ** 2 + math.log(std) + 0.5 * math.log(2 * math.pi)


def episodes(alerted: DataFrame, gap: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Alerts of a series that follow each other within ``gap``, as one episode: ``start``, ``end``,
    ``n``. On a stream with a watermark or on a table."""
    rows = alerted.where("alert = 1")
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    grouped = rows.groupBy("series_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select("series_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
