"""Scores of Gaussian-mixture forecasts, row by row.

A forecast row has ``weights`` array<double> (M components, need not add to 1), ``means`` and
``stds`` array<array<double>> (M by D channels); the observation is array<double> of D. Axes of
windows and horizons are rows. All functions are built-in array expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .gaussian import absolute_mean, bound, cdf

STD_FLOOR = 1e-12
_LOG_TWO_PI = math.log(2 * math.pi)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean_of(values: Column) -> Column:
    return total(values) / F.size(values)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def normalized(weights: Column) -> Column:
    """Weights that add to 1."""
    return bound(total(weights), lambda t: F.transform(weights, lambda w: w / t))


def valid(observed: Column, weights: Column, means: Column, stds: Column) -> Column:
    """True for rows that are a forecast: shapes agree, all finite, weights not negative and not
    all zero, standard deviations positive."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    shaped = (F.size(means) == F.size(weights)) & (F.size(stds) == F.size(weights)) & F.forall(means, lambda m: F.size(m) == F.size(observed)) & F.forall(stds, lambda s: F.size(s) == F.size(observed))
    return (
        shaped
        & F.forall(observed, finite)
        & F.forall(weights, lambda w: finite(w) & (w >= 0))
        & (total(weights) > 0)
        & F.forall(means, lambda m: F.forall(m, finite))
        & F.forall(stds, lambda s: F.forall(s, lambda x: finite(x) & (x > 0)))
    )


def log_sum_exp(values: Column) -> Column:
    """Nulls stand for minus infinity; null if there is nothing else."""
    above = lambda v, top: top + F.log(F.aggregate(v, F.lit(0.0), lambda s, x: s + F.coalesce(F.exp(x - top), F.lit(0.0))))
    return bound(values, lambda v: bound(F.array_max(v), lambda top: above(v, top)))


def _log_density(y: Column, mean: Column, std: Column) -> Column:
    std = F.greatest(std, F.lit(STD_FLOOR))
    return -0.5 * (F.pow((y - mean) / std, 2.0) + 2 * F.log(std) + _LOG_TWO_PI)


def nll(observed: Column, weights: Column, means: Column, stds: Column) -> Column:
    """Negative log-likelihood of the whole observation. A component of weight 0 plays no part."""
    joint = F.transform(
        F.arrays_zip(normalized(weights).alias("w"), means.alias("m"), stds.alias("s")),
        lambda c: F.log(F.when(c["w"] > 0, c["w"])) + total(F.transform(F.arrays_zip(observed.alias("y"), c["m"].alias("m"), c["s"].alias("s")), lambda d: _log_density(d["y"], d["m"], d["s"]))),
    )
    return -log_sum_exp(joint)


def by_channel(observed: Column, weights: Column, means: Column, stds: Column, build) -> Column:
    """An array over channels: ``build`` gets the observed value and an array of the components'
    normalised weight, mean and standard deviation (``w``, ``m``, ``s``) of one channel."""

    def one(w: Column, y: Column, d: Column) -> Column:
        parts = F.arrays_zip(w.alias("w"), F.transform(means, lambda m: F.get(m, d)).alias("m"), F.transform(stds, lambda s: F.get(s, d)).alias("s"))
        return bound(parts, lambda p: build(y, p))

    return bound(normalized(weights), lambda w: F.transform(observed, lambda y, d: one(w, y, d)))


def channel_nll(observed: Column, weights: Column, means: Column, stds: Column) -> Column:
    """Each channel's negative log-likelihood under its own marginal mixture."""

    def one(y: Column, parts: Column) -> Column:
        return -log_sum_exp(F.transform(parts, lambda c: F.log(F.when(c["w"] > 0, c["w"])) + _log_density(y, c["m"], c["s"])))

    return by_channel(observed, weights, means, stds, one)


def predictive_mean(weights: Column, means: Column) -> Column:
    """The mixture's mean in each channel."""
    return bound(normalized(weights), lambda w: F.transform(F.get(means, F.lit(0)), lambda _, d: dot(w, F.transform(means, lambda m: F.get(m, d)))))


def absolute_errors(observed: Column, weights: Column, means: Column) -> Column:
    return F.zip_with(observed, predictive_mean(weights, means), lambda y, m: F.abs(y - m))


def squared_errors(observed: Column, weights: Column, means: Column) -> Column:
    return F.transform(absolute_errors(observed, weights, means), lambda e: e * e)


def channel_crps(observed: Column, weights: Column, means: Column, stds: Column) -> Column:
    """Each channel's continuous ranked probability score, in closed form."""

    def one(y: Column, parts: Column) -> Column:
        to_observed = total(F.transform(parts, lambda c: c["w"] * absolute_mean(y - c["m"], c["s"])))
        between = total(F.transform(parts, lambda c: c["w"] * total(F.transform(parts, lambda e: e["w"] * absolute_mean(c["m"] - e["m"], F.sqrt(c["s"] * c["s"] + e["s"] * e["s"]))))))
        return to_observed - 0.5 * between

    return by_channel(observed, weights, means, stds, one)


def pit(observed: Column, weights: Column, means: Column, stds: Column) -> Column:
    """The forecast distribution function at each channel's observed value."""
    return by_channel(observed, weights, means, stds, lambda y, parts: total(F.transform(parts, lambda c: c["w"] * cdf((y - c["m"]) / c["s"]))))


def entropy(probabilities: Column) -> Column:
    return -total(F.transform(probabilities, lambda p: p * F.log(F.greatest(p, F.lit(1e-12)))))


def normalized_entropy(probabilities: Column) -> Column:
    """Entropy over its largest value; 0 for a single class."""
    return F.when(F.size(probabilities) > 1, entropy(probabilities) / F.log(F.size(probabilities).cast("double"))).otherwise(F.lit(0.0))


def pairwise_distance(means: Column) -> Column:
    """Mean Euclidean distance over pairs of components; 0 for one component."""
    pairs = F.flatten(F.transform(means, lambda a, i: F.transform(F.slice(means, i + 2, F.size(means)), lambda b: F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))))
    return F.when(F.size(pairs) > 0, mean_of(pairs)).otherwise(F.lit(0.0))
