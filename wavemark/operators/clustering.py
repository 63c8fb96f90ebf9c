"""Pseudo-regimes: k-means over features of windows, with a fixed start."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mixture import mean_of, total
from . import scaling


def window_features(window: str = "window") -> Column:
    """Mean, population standard deviation, last, and last less first of each channel."""
    w = F.col(window)
    channels = F.transform(F.get(w, F.lit(0)), lambda _, d: F.transform(w, lambda row: F.get(row, d)))
    std = lambda c: F.sqrt(F.transform(F.array(mean_of(c)), lambda m: mean_of(F.transform(c, lambda v: (v - m) * (v - m))))[0])
    last = lambda c: F.get(c, F.size(c) - 1)
    return F.concat(F.transform(channels, mean_of), F.transform(channels, std), F.transform(channels, last), F.transform(channels, lambda c: last(c) - F.get(c, F.lit(0))))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def nearest(features: Column, centroids: list[list[float]]) -> Column:
    """The number of the nearest centroid; the lowest of equals."""
    away = F.array(*(squared_distance(features, F.array(*map(F.lit, map(float, c)))) for c in centroids))
    return (F.array_position(away, F.array_min(away)) - 1).cast("long")


@dataclass(frozen=True)
class PseudoRegimes:
    mean: list[float]
    std: list[float]
    centroids: list[list[float]]

    def features(self, window: str = "window") -> Column:
        table = F.arrays_zip(window_features(window).alias("f"), F.array(*map(F.lit, self.mean)).alias("m"), F.array(*map(F.lit, self.std)).alias("s"))
        return F.transform(table, lambda c: (c["f"] - c["m"]) / c["s"])

    def predict(self, df: DataFrame, window: str = "window", name: str = "regime_label") -> DataFrame:
        return df.withColumn(name, nearest(self.features(window), self.centroids))


def update_centroids(labelled: DataFrame, before: list[list[float]], label: str = "label", features: str = "features") -> list[list[float]]:
    """The members' mean; a cluster without members keeps its centroid."""
    return _round_of(labelled, before, label, features)[0]


def _round_of(labelled: DataFrame, before: list[list[float]], label: str = "label", features: str = "features") -> tuple[list[list[float]], int]:
    """New centroids, and how many labels ``changed``, if the table says so: one aggregate, a row for
    each cluster."""
    changes = F.count_if("changed") if "changed" in labelled.columns else F.lit(0)
    means = F.array(*(F.avg(F.get(features, F.lit(i))) for i in range(len(before[0]))))
    after, changed = [list(c) for c in before], 0
    for row in labelled.groupBy(label).agg(means.alias("means"), changes.alias("changed")).collect():
        after[row[label]], changed = list(row["means"]), changed + row["changed"]
    return after, changed


def first_centroids(df: DataFrame, k: int, seed: int, seq: str = "seq", features: str = "features") -> list[list[float]]:
    """One row drawn by the seed, then always the row farthest from all chosen, the earliest of
    equals; chosen rows do not come again."""
    n = df.count()
    if n < k or k < 2:
        raise ValueError("n_regimes must be at least 2 and at most the number of windows")
    place = int(np.random.default_rng(seed).integers(n))
    row = df.where(F.col(seq) == place).select(seq, features).first()
    chosen, found = [row[seq]], [list(row[features])]
    while len(found) < k:
        away = F.array_min(F.array(*(squared_distance(F.col(features), F.array(*map(F.lit, c))) for c in found)))
        best = df.where(~F.col(seq).isin(*chosen)).agg(F.max_by(F.struct(seq, features), F.struct(away, -F.col(seq))).alias("b")).first()["b"]
        chosen.append(best[seq])
        found.append(list(best[features]))
    return found


def fit_pseudo_regimes(windows: DataFrame, k: int, seed: int = 0, max_iter: int = 50, seq: str = "seq", window: str = "window") -> PseudoRegimes:
    """k-means (Lloyd's steps from farthest-first centroids) over standardised window features;
    ``seq`` counts the windows from 0. Stops before an update once no label changes. Only
    centroids, ``k`` small rows, come to the driver. A round is one aggregate: assignment, the test for
    changes and the new means."""
    raw = windows.select(seq, window_features(window).alias("x")).cache()
    try:
        stats = scaling.fit_scaler(raw, by=()).first()
        model = PseudoRegimes(list(stats["mean"]), list(stats["std"]), [])
        table = F.arrays_zip(F.col("x").alias("f"), F.array(*map(F.lit, model.mean)).alias("m"), F.array(*map(F.lit, model.std)).alias("s"))
        points = raw.select(seq, F.transform(table, lambda c: (c["f"] - c["m"]) / c["s"]).alias("features"))
        centroids, before = first_centroids(points, k, seed, seq), None
        for _ in range(max_iter):
            labelled = points.withColumn("label", nearest(F.col("features"), centroids))
            moved = F.lit(True) if before is None else F.col("label") != nearest(F.col("features"), before)
            after, changed = _round_of(labelled.withColumn("changed", moved), centroids)
            if not changed:
                break
            before, centroids = centroids, after
    finally:
        raw.unpersist()
    return PseudoRegimes(model.mean, model.std, centroids)
