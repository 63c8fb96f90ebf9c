"""Baseline forecasters: the last season again, with a constant spread."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from .sequence import trailing


def spread(d: Column, floor: float = 1e-3, over: WindowSpec | None = None) -> Column:
    """The population standard deviation of ``d``, not below ``floor``; 1 where it has no values. As
    an aggregate, or over a window."""
    n, s = F.count(d), F.stddev_pop(d)
    if over is not None:
        n, s = n.over(over), s.over(over)
    return F.when(n > 0, F.greatest(s, F.lit(floor))).otherwise(1.0)


def fit_seasonal(df: DataFrame, season: int = 1, by: Sequence[str] = ("series_id",), t: str = "t", x: str = "x", floor: float = 1e-3, reset: Sequence[str] | None = None) -> DataFrame:
    """``std`` of each channel, as an array: population standard deviation of x[t] - x[t - season],
    not below ``floor``; 1 where no such difference exists. A row for each group of ``by``;
    differences are taken in the order of ``t`` within ``reset`` (by default the same)."""
    if season < 1:
        raise ValueError("season must be at least 1")
    within = by if reset is None else reset
    lagged = trailing(df.select(*{*by, *within}, t, x), t, season, lambda w: {"_before": F.lag(x, season).over(w)}, within)
    flat = lagged.select(*by, F.posexplode(F.zip_with(x, F.coalesce("_before", F.transform(x, lambda v: F.lit(None).cast("double"))), lambda a, b: a - b)).alias("channel", "d"))
    stats = flat.groupBy(*by, "channel").agg(spread(F.col("d"), floor).alias("s"))
    rows = F.sort_array(F.collect_list(F.struct("channel", "s")))
    return stats.groupBy(*by).agg(rows.alias("r")).select(*by, F.transform("r", lambda c: c["s"]).alias("std"))


def forecast_seasonal(windows: DataFrame, season: int, horizon: int, std: Column, window: str = "window") -> DataFrame:
    """A forecast row for each window and step ``h``: one component of weight 1 at the value a
    season before, with spread ``std`` (an array over channels)."""
    steps = windows.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    place = F.size(window) - season + F.col("h") % season
    return steps.withColumn("weights", F.array(F.lit(1.0))).withColumn("means", F.array(F.get(window, place))).withColumn("stds", F.array(std))


def forecast_persistence(windows: DataFrame, horizon: int, std: float = 1.0, window: str = "window") -> DataFrame:
    """The last observation again, with one fixed spread."""
    return forecast_seasonal(windows, 1, horizon, F.transform(F.get(window, F.size(window) - 1), lambda _: F.lit(std)), window)
