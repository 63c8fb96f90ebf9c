"""Scaling of series, and splits by position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fit_scaler(df: DataFrame, by: Sequence[str] = ("series_id",), x: str = "x", floor: float = 1e-6) -> DataFrame:
    """``mean`` and ``std`` (population, not below ``floor``) of each channel, as arrays: a row for
    each group, or one row for all (``by=()``)."""
    flat = df.select(*by, F.posexplode(x).alias("channel", "v"))
    stats = flat.groupBy(*by, "channel").agg(F.avg("v").alias("m"), F.greatest(F.stddev_pop("v"), F.lit(floor)).alias("s"))
    rows = F.sort_array(F.collect_list(F.struct("channel", "m", "s")))  # as many as channels
    return stats.groupBy(*by).agg(rows.alias("r")).select(*by, F.transform("r", lambda c: c["m"]).alias("mean"), F.transform("r", lambda c: c["s"]).alias("std"))


def _with_scaler(df: DataFrame, scaler: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(scaler, list(by)) if by else df.crossJoin(F.broadcast(scaler.limit(1)))


def scale(df: DataFrame, scaler: DataFrame, by: Sequence[str] = ("series_id",), x: str = "x") -> DataFrame:
    """Channels less their mean, over their standard deviation."""
    scaled = F.transform(F.arrays_zip(F.col(x).alias("v"), F.col("mean").alias("m"), F.col("std").alias("s")), lambda c: (c["v"] - c["m"]) / c["s"])
    return _with_scaler(df, scaler, by).withColumn(x, scaled).drop("mean", "std")


def unscale(df: DataFrame, scaler: DataFrame, by: Sequence[str] = ("series_id",), x: str = "x") -> DataFrame:
    """The inverse of ``scale``."""
    back = F.transform(F.arrays_zip(F.col(x).alias("v"), F.col("mean").alias("m"), F.col("std").alias("s")), lambda c: c["v"] * c["s"] + c["m"])
    return _with_scaler(df, scaler, by).withColumn(x, back).drop("mean", "std")


def split_tail(df: DataFrame, fraction: float = 0.2, by: Sequence[str] = ("series_id",), t: str = "t") -> DataFrame:
    """Add ``split``: the last rows of each series are 'validation', as many as the fraction gives,
    rounded half to even, at least one; the rest 'train'. A series of which nothing is left to train
    on fails the job."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    n = F.count("*").over(Window.partitionBy(*by))
    size = F.greatest(F.lit(1), F.bround(n * F.lit(fraction)).cast("long"))
    split = F.when(F.col(t) >= n - size, "validation").otherwise("train")
    return df.withColumn("split", F.when(size < n, split).otherwise(F.raise_error(F.lit("a validation split leaves no training observations")).cast("string")))


def finite_rows(df: DataFrame, x: str = "x") -> DataFrame:
    """The rows as they are; a null, empty or non-finite observation fails the job."""
    good = F.col(x).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.when(good, True).otherwise(F.raise_error(F.lit("observations must be non-empty and finite")).cast("boolean")))
