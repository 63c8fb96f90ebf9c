"""Exact, linearly interpolated quantiles without gathering the values in one place."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interpolate(low: float, high: float, part: float) -> float:
    """The value ``part`` of the way from ``low`` to ``high``, monotone in ``part``."""
    return low + (high - low) * part if part < 0.5 else high - (high - low) * (1 - part)


def exact_quantiles(df: DataFrame, column: str, levels: Sequence[float], *, distinct: bool = False, buckets: int = 256) -> list[float]:
    """Quantiles of a non-empty column (``distinct``: of its distinct values).

    Equal values are counted first, so a frequent value is one row. Approximate quantiles cut the
    values into buckets; the buckets' counts say which hold the wanted ranks, and only those are
    ranked. What comes to the driver: a count for each bucket, two values for each level.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg((F.lit(1) if distinct else F.count("*")).cast("long").alias("n")).cache()
    try:
        edges = sorted(set(values.approxQuantile("v", [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))))
        table = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>")
        placed = values.withColumn("b", F.size(F.filter(table, lambda e: e <= F.col("v"))))
        counts = dict(placed.groupBy("b").agg(F.sum("n")).collect())
        total = sum(counts.values())
        if not total:
            raise ValueError("no values")
        wanted = sorted({f((total - 1) * q) for q in levels for f in (math.floor, math.ceil)})
        before, needed, start = {}, set(), 0
        for b in sorted(counts):
            before[b] = start
            if any(start <= w < start + counts[b] for w in wanted):
                needed.add(b)
            start += counts[b]
        upto = F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
        base = F.create_map(*(F.lit(x) for b in needed for x in (b, before[b])))
        ranked = placed.where(F.col("b").isin(*needed)).withColumn("upto", upto + base[F.col("b")])
        hits = ranked.select("v", (F.col("upto") - F.col("n")).alias("first"), "upto", F.explode(F.filter(F.array(*map(F.lit, wanted)), lambda w: (w >= F.col("upto") - F.col("n")) & (w < F.col("upto")))).alias("w"))
        at = {r["w"]: r["v"] for r in hits.select("w", "v").collect()}
    finally:
        values.unpersist()
    out = []
    for q in levels:
        place = (total - 1) * q
        out.append(interpolate(at[math.floor(place)], at[math.ceil(place)], place - math.floor(place)))
    return out
