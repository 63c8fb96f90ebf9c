"""Diagnostics of mixture forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mixture import entropy, normalized, normalized_entropy, pairwise_distance
from .quantiles import exact_quantiles


def component_weights(df: DataFrame, weights: str = "weights") -> DataFrame:
    """Each component's mean normalised weight."""
    return df.select(F.posexplode(normalized(F.col(weights))).alias("component", "w")).groupBy("component").agg(F.avg("w").alias("mean_weight"))


def std_summary(df: DataFrame, stds: str = "stds") -> DataFrame:
    """Spread of all standard deviations, in one row; its quantiles are exact, without gathering the
    values in one place."""
    flat = df.select(F.explode(F.flatten(stds)).alias("s"))
    p05, median, p95 = exact_quantiles(flat, "s", [0.05, 0.5, 0.95])
    return flat.agg(F.min("s").alias("min"), F.lit(p05).alias("p05"), F.lit(median).alias("median"), F.avg("s").alias("mean"), F.lit(p95).alias("p95"), F.max("s").alias("max"))


def mixture_diagnostics(df: DataFrame, active: float = 0.01) -> DataFrame:
    """One row: mean, least and largest entropy, mean normalised entropy, each component's mean
    weight, active and effective components, mean distance between component means, and the summary
    of the standard deviations."""
    if not 0 <= active <= 1:
        raise ValueError("the share of an active component lies between 0 and 1")
    w = normalized(F.col("weights"))
    e = entropy(w)
    rows = df.agg(
        F.avg(e).alias("mean_entropy"), F.min(e).alias("min_entropy"), F.max(e).alias("max_entropy"),
        F.avg(normalized_entropy(w)).alias("mean_normalized_entropy"), F.avg(pairwise_distance(F.col("means"))).alias("mean_pairwise_distance"),
    )
    parts = component_weights(df).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("component", "mean_weight"))), lambda c: c["mean_weight"]).alias("component_mean_weights"),  # as many as components
        F.count_if(F.col("mean_weight") >= active).alias("active_components"),
        F.exp(-F.sum(F.col("mean_weight") * F.log(F.greatest("mean_weight", F.lit(1e-12))))).alias("effective_components"),
    )
    spread = std_summary(df).select(F.struct("*").alias("std"))
    return rows.crossJoin(F.broadcast(parts)).crossJoin(F.broadcast(spread))  # one row each
