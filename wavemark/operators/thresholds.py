"""Thresholds on anomaly scores, predictions from them, and the persistence filter."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles
from .sequence import trailing

MOST_CANDIDATES = 64
#: The named strategies.
GLOBAL_QUANTILES = {
    "validation_quantile_95": 0.95, "validation_quantile_98": 0.98, "validation_quantile_985": 0.985, "validation_quantile_99": 0.99,
    "validation_quantile_991": 0.991, "validation_quantile_992": 0.992, "validation_quantile_993": 0.993, "validation_quantile_994": 0.994,
    "validation_quantile_995": 0.995, "validation_quantile_996": 0.996, "validation_quantile_997": 0.997,
}
GROUP_QUANTILES = {"per_machine_validation_quantile_98": 0.98, "per_machine_validation_quantile_985": 0.985, "per_machine_validation_quantile_99": 0.99}
TARGET_RECALLS = {"target_recall_50": (0.5, 0.95), "target_recall_70": (0.7, 0.9)}
STRATEGIES = ("max_validation_f1", *GLOBAL_QUANTILES, *GROUP_QUANTILES, *TARGET_RECALLS)


def check_strategy(strategy: str) -> None:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown threshold strategy {strategy!r}; choose one of {', '.join(STRATEGIES)}")


def candidates(df: DataFrame, score: str = "score") -> list[float]:
    """At most 64 thresholds, descending: one above all scores, then the distinct scores, or 63
    quantiles of them if there are more."""
    values = df.select(score).distinct()
    if values.limit(MOST_CANDIDATES + 1).count() <= MOST_CANDIDATES:
        found = sorted((r[0] for r in values.collect()), reverse=True)
    else:
        found = list(dict.fromkeys(exact_quantiles(df, score, [1 - i / (MOST_CANDIDATES - 2) for i in range(MOST_CANDIDATES - 1)], distinct=True)))
    return [math.nextafter(found[0], math.inf), *found]


def finite(score: str = "score") -> Column:
    """The score as it is; one that is null or not finite fails the job."""
    value = F.col(score)
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value).otherwise(F.raise_error(F.lit("scores must be finite")).cast("double"))


def predict(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Add ``pred``: 1 where the score is at the threshold or above; a score that is not finite
    fails the job."""
    return df.withColumn("pred", (finite(score) >= threshold).cast("int"))


def predict_by_group(df: DataFrame, thresholds: DataFrame, group: str = "group_id", score: str = "score") -> DataFrame:
    """Add ``pred`` by each group's ``threshold``; a group without one fails the job."""
    joined = df.join(thresholds.select(group, "threshold"), group, "left")
    known = F.when(F.col("threshold").isNotNull(), (F.col(score) >= F.col("threshold")).cast("int"))
    return joined.withColumn("pred", known.otherwise(_no_threshold(group).cast("int"))).drop("threshold")


def _no_threshold(group: str) -> Column:
    return F.raise_error(F.concat(F.lit("no threshold for group "), F.col(group).cast("string")))


def predict_by_group_each(df: DataFrame, thresholds: DataFrame, names: Sequence[str], group: str = "group_id", score: str = "score", name: str = "strategy") -> DataFrame:
    """The rows once for each of ``names``, in the column ``name``, with ``pred`` by the group's
    threshold at that place of its ``thresholds``; a group without one fails the job."""
    joined = df.join(thresholds.select(group, "thresholds"), group, "left")
    own = lambda k: F.when(F.col("thresholds")[k].isNotNull(), (F.col(score) >= F.col("thresholds")[k]).cast("int")).otherwise(_no_threshold(group).cast("int"))
    each = F.array(*(F.struct(F.lit(n).alias(name), own(k).alias("pred")) for k, n in enumerate(names)))
    return joined.select(*df.columns, F.explode(each).alias("_each")).select(*df.columns, "_each.*")


def group_quantiles(df: DataFrame, level: float, group: str = "group_id", score: str = "score", accuracy: int = 10_000) -> DataFrame:
    """Each group's ``threshold``: its exact quantile, linearly interpolated; see
    ``group_quantiles_at``."""
    return group_quantiles_at(df, [level], group, score, accuracy).select(group, F.col("thresholds")[0].alias("threshold"))


def group_quantiles_at(df: DataFrame, levels: Sequence[float], group: str = "group_id", score: str = "score", accuracy: int = 10_000) -> DataFrame:
    """Each group's ``thresholds``: its exact quantiles at the levels, linearly interpolated.

    A mergeable sketch of each group (ranks within 1 / ``accuracy`` of its rows) brackets the wanted
    ranks, from the lowest to the highest level; the rows below the bracket are only counted, and only
    the distinct values inside, with one level some ten-thousandths of the group (of a group of fewer
    than 2 * ``accuracy`` rows: all), are put in order. ``df`` is read twice. Null scores do not count;
    a group without any others has null thresholds."""
    margin = 2 / accuracy
    ends = F.array(F.lit(max(0.0, min(levels) - margin)), F.lit(min(1.0, max(levels) + margin)))
    total, value = F.count(score), F.col(score).cast("double")
    near = F.percentile_approx(value, ends, F.lit(accuracy))
    ends = F.when(total < 2 * accuracy, F.array(F.min(value), F.max(value))).otherwise(near)  # few rows: all of them
    sketch = df.groupBy(group).agg(ends.alias("_ends"), total.alias("_total"))
    near = df.select(group, F.col(score).cast("double").alias("_v")).join(sketch, group).where(F.col("_v") <= F.col("_ends")[1])
    inside = F.when(F.col("_v") >= F.col("_ends")[0], F.col("_v"))  # null: all below
    counted = near.groupBy(group, inside.alias("_v")).agg(F.count("*").alias("_n"), F.first("_total").alias("_total"))
    upto = F.sum("_n").over(Window.partitionBy(group).orderBy(F.col("_v").asc_nulls_first()))
    place = [(F.col("_total") - 1) * F.lit(level) for level in levels]
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.struct(F.col("_v")))).alias
    ranked = (c for k, p in enumerate(place) for c in (at(F.floor(p))(f"_a{k}"), at(F.ceil(p))(f"_b{k}"), F.first(p).alias(f"_place{k}")))
    found = counted.withColumn("_upto", upto).groupBy(group).agg(*ranked)

    def sure(k: int) -> Column:
        a, b, part = F.col(f"_a{k}._v"), F.col(f"_b{k}._v"), F.col(f"_place{k}") - F.floor(f"_place{k}")
        value = F.when(part == 0, a).otherwise((1 - part) * a + part * b)
        return F.when(a.isNotNull() & b.isNotNull(), value).otherwise(F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))

    none = sketch.where("_total = 0").select(group, F.array_repeat(F.lit(None).cast("double"), len(levels)).alias("thresholds"))
    return found.select(group, F.array(*map(sure, range(len(levels)))).alias("thresholds")).union(none)


def check_persistence(window: int, count: int) -> None:
    if window < 1 or count < 1:
        raise ValueError("persistence window and count must be at least 1")
    if count > window:
        raise ValueError("persistence count cannot exceed the window")


def persist(df: DataFrame, window: int = 1, count: int = 1, seq: str = "seq", by: Sequence[str] = (), pred: str = "pred") -> DataFrame:
    """``pred`` becomes 1 where ``count`` or more of the last ``window`` predictions are, fewer at
    the start. Over the whole sequence, or within ``by`` (with ``seq`` counting in each group)."""
    check_persistence(window, count)
    if (window, count) == (1, 1):
        return df
    seen = trailing(df, seq, window - 1, lambda w: {"_hits": F.sum(pred).over(w.rowsBetween(1 - window, 0))}, by)
    return seen.withColumn(pred, (F.col("_hits") >= count).cast("int")).drop("_hits")
