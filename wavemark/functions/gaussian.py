"""The normal distribution as column expressions, and as SQL text for other engines.

The distribution function is the rational approximation of Hart (1968) in the form of West (2005),
good to about 1e-15; Spark has no error function.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The published coefficients, highest power first.
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT, FAR, ROOT_TWO_PI = 7.07106781186547, 37.0, 2.506628274631


def _horner(x, coefficients):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def _fraction(x):
    total = x + 0.65
    for k in (4, 3, 2, 1):
        total = x + k / total
    return total


def bound(value: Column, build) -> Column:
    """``build`` of the value, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def pdf(z: Column) -> Column:
    return F.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)


def _tail(a: Column) -> Column:
    """The distribution function at -a, for a of 0 or more."""
    e = F.exp(-0.5 * a * a)
    near = e * _horner(a, tuple(map(F.lit, NUMERATOR))) / _horner(a, tuple(map(F.lit, DENOMINATOR)))
    return F.when(a > FAR, 0.0).when(a < SPLIT, near).otherwise(e / _fraction(a) / ROOT_TWO_PI)


def cdf(z: Column) -> Column:
    return bound(z, lambda v: bound(_tail(F.abs(v)), lambda tail: F.when(v > 0, 1 - tail).otherwise(tail)))


def cdf_sql(z: str) -> str:
    """The same expression as SQL text."""
    a = f"abs({z})"

    def text(coefficients: tuple[float, ...]) -> str:
        total = repr(coefficients[0])
        for c in coefficients[1:]:
            total = f"({total} * {a} + {c!r})"
        return total

    e = f"exp(-0.5 * {a} * {a})"
    fraction = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        fraction = f"({a} + {k} / {fraction})"
    tail = f"CASE WHEN {a} > {FAR} THEN 0.0 WHEN {a} < {SPLIT} THEN {e} * {text(NUMERATOR)} / {text(DENOMINATOR)} ELSE {e} / {fraction} / {ROOT_TWO_PI} END"
    return f"(CASE WHEN {z} > 0 THEN 1 - ({tail}) ELSE ({tail}) END)"


def absolute_mean(mean: Column, std: Column) -> Column:
    """The expected absolute value of a normal variable; std must be positive."""
    return bound(std, lambda s: bound(mean / s, lambda z: s * (2 * pdf(z) + z * (2 * cdf(z) - 1))))


def absolute_mean_sql(mean: str, std: str) -> str:
    z = f"(({mean}) / ({std}))"
    return f"(({std}) * (2 * exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) + {z} * (2 * {cdf_sql(z)} - 1)))"
