"""Count-based windows of series, and their union."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sequence import CHUNK, numbered, trailing


def make_windows(df: DataFrame, lookback: int, horizon: int, stride: int = 1, by: Sequence[str] = ("series_id",), t: str = "t", x: str = "x", single: bool = False, strict: bool = False) -> DataFrame:
    """One row for each window: ``start``, ``window`` (the ``lookback`` observations from there),
    ``target`` (the ``horizon`` after), ``regime_label`` (of the window's last step) and
    ``anomaly_label`` (1 if any target step has it). ``t`` counts from 0 in each series.

    Frames look back from a window's last step, so long series are cut into chunks. ``single``
    rounds observations to 32 bits. Series that are too short give no window; with ``strict`` they
    fail at once.
    """
    if min(lookback, horizon, stride) < 1:
        raise ValueError("lookback, horizon and stride must be at least 1")
    width = lookback + horizon
    if strict and not df.groupBy(*by).count().where(F.col("count") < width).isEmpty():
        raise ValueError("a series is too short for the windows")

    def build(w):
        frame, ahead = w.rowsBetween(1 - width, 0), w.rowsBetween(1 - horizon, 0)
        return {"_x": F.collect_list(x).over(frame), "_r": F.collect_list("regime_label").over(frame), "_a": F.max("anomaly_label").over(ahead)}

    start = F.col(t) - (width - 1)
    rows = trailing(df, t, width - 1, build, by).where((start >= 0) & (start % stride == 0))
    part = lambda a, n: F.slice("_x", a, n).cast("array<array<float>>") if single else F.slice("_x", a, n)
    return rows.select(*by, start.cast("long").alias("start"), part(1, lookback).alias("window"), part(lookback + 1, horizon).alias("target"), F.get("_r", F.lit(lookback - 1)).alias("regime_label"), F.col("_a").alias("anomaly_label"))


def concat(frames: Sequence[DataFrame], order: Sequence[str] = ("start",)) -> DataFrame:
    """All rows, with ``group_id`` (the place of their frame) and ``seq`` (their place in all). The
    last column of ``order`` counts up within the others, as ``start`` does in a series."""
    tagged = [f.withColumn("group_id", F.lit(i)) for i, f in enumerate(frames)]
    return numbered(reduce(lambda a, b: a.unionByName(b), tagged), ["group_id", *order[:-1]], order[-1:], chunk=CHUNK)


def replace_labels(windows: DataFrame, labels: DataFrame, key: str = "seq") -> DataFrame:
    """``windows`` with ``regime_label`` from ``labels`` (key, label); every row must have one."""
    joined = windows.drop("regime_label").join(labels.select(key, F.col("label").alias("regime_label")), key, "left")
    return joined.where(F.when(F.col("regime_label").isNotNull(), True).otherwise(F.raise_error(F.lit("a window has no label")).cast("boolean")))


def flatten(windows: DataFrame, seq: str = "seq", lookback: int | None = None) -> DataFrame:
    """The windows' observations one after another, overlapping rows repeated: ``place`` counts
    them from 0 if ``lookback`` is given."""
    rows = windows.select("*", F.posexplode("window").alias("step", "x"))
    return rows.withColumn("place", F.col(seq) * lookback + F.col("step")) if lookback else rows
