"""Telemetry views of the given tables, and the same as SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mixture import nll
from ..operators import baselines

Query = Callable[[SparkSession, str], DataFrame]

REGIMES = {"view": 0, "click": 1, "purchase": 2, "signup": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def series_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id``, ``t``, ``x`` (value, k), ``regime_label``, ``anomaly_label``, ``n``."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id")
    code = F.coalesce(F.create_map(*(F.lit(v) for pair in REGIMES.items() for v in pair))[F.col("event_type")], F.lit(4))
    return e.select(
        F.col("user_id").alias("series_id"),
        (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("t"),
        F.array("value", F.get_json_object("props", "$.k").cast("double")).alias("x"),
        code.alias("regime_label"),
        (F.col("event_type") == "error").cast("int").alias("anomaly_label"),
        F.count("*").over(w).alias("n"),
    )


EV = """ev AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(event_type = 'error' AS INT) AS anomaly_label,
  CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS regime_label,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def split_by_place(t: str = "t", n: str = "n"):
    """The first six tenths train, two validation, two test."""
    return F.when(F.col(t) * 10 < F.col(n) * 6, "train").when(F.col(t) * 10 < F.col(n) * 8, "validation").otherwise("test")


def scored(spark: SparkSession, sf_dir: str, split: str | None = None, *, numbered: bool = True) -> DataFrame:
    """Lag-1 scores of the validation and test splits, or one of them: ``split``, ``group_id`` (the
    series), ``t``, ``place`` (in the series' split), ``score``, ``label`` and, unless not
    ``numbered``, ``seq``, the place in the whole split.

    One pass over the events: order, lag and spread of a series come from windows over the same
    exchange. Numbers of rows before a series come from a table of a row for each series."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", (F.col("event_type") == "error").cast("int").alias("label"))
    whole = Window.partitionBy("user_id")
    order = whole.orderBy("ts", "event_id")
    rows = e.select("*", (F.row_number().over(order) - 1).cast("long").alias("t"), F.lag("value").over(order).alias("before"), F.count("*").over(whole).alias("n"))
    rows = rows.withColumn("split", split_by_place())
    std = baselines.spread(F.when(F.col("split") == "train", F.col("value") - F.col("before")), over=whole)
    first = F.when(F.col("split") == "test", _begin(8)).otherwise(_begin(6))
    score = nll(F.array("value"), F.array(F.lit(1.0)), F.array(F.array("before")), F.array(F.array("std")))
    rows = rows.withColumn("std", std).where(F.col("split") == split if split else F.col("split") != "train")
    made = rows.select("split", F.col("user_id").alias("group_id"), "t", (F.col("t") - first).cast("long").alias("place"), F.round(score, 6).alias("score"), "label")
    if not numbered:
        return made
    sizes = e.groupBy(F.col("user_id").alias("group_id")).agg(F.count("*").alias("n"))
    before = Window.orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = sizes.select("group_id", total(_begin(8) - _begin(6)).alias("validation"), total(F.col("n") - _begin(8)).alias("test"))
    seq = (F.col("place") + F.when(F.col("split") == "test", F.col("test")).otherwise(F.col("validation"))).cast("long")
    return made.join(offsets, "group_id").select("split", "group_id", "t", "place", seq.alias("seq"), "score", "label")


def _begin(tenths: int) -> Column:
    """The first place in a series of ``n`` rows at or beyond so many tenths."""
    return F.floor((F.col("n") * tenths + 9) / 10)


SC = f"""{EV},
res AS (SELECT *, v - lag(v) OVER (PARTITION BY series_id ORDER BY t) AS d,
  CASE WHEN t * 10 < n * 6 THEN 'train' WHEN t * 10 < n * 8 THEN 'validation' ELSE 'test' END AS split FROM ev),
sg AS (SELECT series_id, coalesce(greatest(stddev_pop(d), 1e-3), 1.0) AS s FROM res WHERE split = 'train' GROUP BY 1),
sc AS (SELECT series_id AS group_id, t, split, anomaly_label AS label, round(0.5 * ((d / s) * (d / s) + 2 * ln(s) + ln(2 * pi())), 6) AS score
  FROM res JOIN sg USING (series_id) WHERE split <> 'train'),
val AS (SELECT *, row_number() OVER (ORDER BY group_id, t) - 1 AS seq FROM sc WHERE split = 'validation'),
tst AS (SELECT *, row_number() OVER (ORDER BY group_id, t) - 1 AS seq FROM sc WHERE split = 'test')"""
