"""Rows in ascending order of a numeric key, dealt over tasks as ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beyond this many ranges, ranges grow instead: their bounds travel with the plan.
MOST_RANGES = 16_384


def range_bounds(df: DataFrame, key: str, rows_per_range: int, most_ranges: int = MOST_RANGES) -> list[float]:
    """Keys that cut ``df`` into ranges of about ``rows_per_range`` rows. Only the key is read, and
    the list is bounded by ``most_ranges``, however large the input."""
    n = min(most_ranges, -(-df.select(key).count() // rows_per_range))
    return sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 0.2 / n))) if n > 1 else []


def range_number(key: Column, bounds: list[float]) -> Column:
    """How many bounds are at or below the key; 0 for null. Equal keys get equal numbers."""
    edges = np.array(bounds, np.float64)

    @F.pandas_udf("long")
    def number(keys: pd.Series) -> pd.Series:
        values = keys.to_numpy(np.float64, na_value=-np.inf)
        return pd.Series(np.searchsorted(edges, values, side="right"))

    return number(key.cast("double"))


def in_ranges(df: DataFrame, key: str, then: str, rows_per_range: int, most_ranges: int = MOST_RANGES) -> DataFrame:
    """``df`` with ``range_id``; all rows of a range stand together in one task, in ascending order
    of ``key``, then ``then``, nulls first."""
    bounds = range_bounds(df, key, rows_per_range, most_ranges)
    numbered = df.withColumn("range_id", range_number(F.col(key), bounds))
    return dealt(numbered, len(bounds) + 1).sortWithinPartitions("range_id", F.col(key).asc_nulls_first(), F.col(then).asc_nulls_first())


def dealt(df: DataFrame, ranges: int) -> DataFrame:
    """Ranges over tasks, evenly: range k goes to task k modulo the number of tasks."""
    tasks = min(ranges, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionById(tasks, F.pmod(F.col("range_id"), F.lit(tasks)).cast("int"))
