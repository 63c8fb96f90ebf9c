"""Anomaly scores of forecasts and of regime posteriors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import trailing
from .mixture import channel_nll, dot, nll, normalized_entropy, total

FORECAST_METHODS = ("mean_nll", "channel_mean_nll", "channel_max_nll", "channel_top3_mean_nll")
REGIME_METHODS = ("regime_entropy", "regime_confidence_gap", "regime_switch")


def check_method(method: str, allowed: Sequence[str] = FORECAST_METHODS) -> None:
    if method not in allowed:
        raise ValueError(f"unknown anomaly score method {method!r}; choose one of {', '.join(allowed)}")


def forecast_scores(forecast: DataFrame, method: str = "mean_nll", by: Sequence[str] = ("seq",)) -> DataFrame:
    """One ``score`` for each example (``by``) of a forecast table with a row per horizon step:
    ``observed``, ``weights``, ``means``, ``stds``."""
    check_method(method)
    columns = [F.col(c) for c in ("observed", "weights", "means", "stds")]
    if method == "mean_nll":
        return forecast.groupBy(*by).agg(F.avg(nll(*columns)).alias("score"))
    flat = forecast.select(*by, F.explode(channel_nll(*columns)).alias("v"))
    if method == "channel_mean_nll":
        return flat.groupBy(*by).agg(F.avg("v").alias("score"))
    if method == "channel_max_nll":
        return flat.groupBy(*by).agg(F.max("v").alias("score"))
    first = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("v")))
    return flat.withColumn("r", first).where("r <= 3").groupBy(*by).agg(F.avg("v").alias("score"))


def confidence_gap(probabilities: Column) -> Column:
    return 1 - F.array_max(probabilities)


def is_posterior(p: Column) -> Column:
    """True for a non-empty array of finite numbers, none negative, that add up to 1 (within 1e-5,
    relative, and 1e-8)."""
    return F.coalesce((F.size(p) > 0) & F.forall(p, lambda v: v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf"))) & (F.abs(total(p) - 1) <= 1e-5 + 1e-8), F.lit(False))


def regime_scores(posterior: DataFrame, method: str, seq: str = "seq", probabilities: str = "probs", by: Sequence[str] = ()) -> DataFrame:
    """Add ``score``. ``regime_switch`` is one less the overlap with the row before in the whole
    sequence (0 at its start); ``by`` starts it anew in each group. Rows that are no probabilities
    (empty, not finite, negative, or not adding up to 1) fail the job."""
    check_method(method, REGIME_METHODS)
    posterior = posterior.where(F.when(is_posterior(F.col(probabilities)), True).otherwise(F.raise_error(F.lit("posteriors must be probabilities that add up to 1")).cast("boolean")))
    p = F.col(probabilities)
    if method == "regime_entropy":
        return posterior.withColumn("score", normalized_entropy(p))
    if method == "regime_confidence_gap":
        return posterior.withColumn("score", confidence_gap(p))

    def build(window):
        return {"score": F.coalesce(1 - dot(p, F.lag(probabilities).over(window)), F.lit(0.0))}

    return trailing(posterior, seq, 1, build, by)


def joint_scores(forecast: DataFrame, posterior: DataFrame, method: str) -> DataFrame:
    """``seq`` and ``score`` by a forecast or a regime method."""
    check_method(method, FORECAST_METHODS + REGIME_METHODS)
    return forecast_scores(forecast, method) if method in FORECAST_METHODS else regime_scores(posterior, method).select("seq", "score")
