"""Queries over series: scaling, splits, windows, failures, pseudo-regimes and generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, failures, scaling, windows
from ..sources import synthetic
from .views import EV, Query, series_events

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
L, H, S = 8, 2, 2


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(column, name: str):
    return F.round(column, 6).alias(name)


FIT = "fit AS (SELECT series_id, avg(v) AS m0, greatest(stddev_pop(v), 1e-6) AS s0, avg(k) AS m1, greatest(stddev_pop(k), 1e-6) AS s1 FROM ev GROUP BY 1)"


@query("standardize_fit", f"WITH {EV}, {FIT} SELECT series_id, round(m0, 6) AS m0, round(s0, 6) AS s0, round(m1, 6) AS m1, round(s1, 6) AS s1 FROM fit")
def standardize_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = scaling.fit_scaler(series_events(spark, sf_dir))
    return fit.select("series_id", *(r6(F.col(c)[i], f"{c[0]}{i}") for i in (0, 1) for c in ("mean", "std")))


@query("standardize_transform", f"WITH {EV}, {FIT} SELECT series_id, t, round((v - m0) / s0, 6) + 0.0 AS z0, round((k - m1) / s1, 6) + 0.0 AS z1 FROM ev JOIN fit USING (series_id)")
def standardize_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = series_events(spark, sf_dir)
    done = scaling.scale(ev, scaling.fit_scaler(ev))
    return done.select("series_id", "t", *((F.round(F.col("x")[i], 6) + 0.0).alias(f"z{i}") for i in (0, 1)))


@query("standardize_roundtrip", f"WITH {EV} SELECT series_id, t, round(v, 6) AS v, round(k, 6) AS k FROM ev")
def standardize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = series_events(spark, sf_dir)
    fit = scaling.fit_scaler(ev)
    back = scaling.unscale(scaling.scale(ev, fit), fit)
    return back.select("series_id", "t", r6(F.col("x")[0], "v"), r6(F.col("x")[1], "k"))


@query("split_tail", f"WITH {EV}, c AS (SELECT DISTINCT series_id, n, greatest(1, CAST(round_even(CAST(n AS DOUBLE) * CAST(0.2 AS DOUBLE), 0) AS BIGINT)) AS m FROM ev) SELECT series_id, n - m AS n_train, m AS n_validation FROM c")
def split_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = scaling.split_tail(series_events(spark, sf_dir), 0.2)
    return cut.groupBy("series_id").agg(F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "validation").alias("n_validation"))


WINDOWS = f"""w AS (SELECT series_id, t AS start, n,
  sum(v) OVER f AS sum_v, last_value(v) OVER f AS last_v, first_value(v) OVER f AS first_v, avg(v) OVER f AS mean_v, stddev_pop(v) OVER f AS std_v, last_value(regime_label) OVER f AS regime_label,
  avg(v) OVER g AS target_v, max(anomaly_label) OVER g AS anomaly_label FROM ev
  WINDOW f AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN CURRENT ROW AND {L - 1} FOLLOWING), g AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN {L} FOLLOWING AND {L + H - 1} FOLLOWING)),
ws AS (SELECT * FROM w WHERE start <= n - {L + H} AND start % {S} = 0)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.make_windows(series_events(spark, sf_dir), L, H, S)


@query("sliding_windows", f"WITH {EV}, {WINDOWS} SELECT series_id, start, round(sum_v, 6) AS sum_v, round(last_v, 6) AS last_v, round(target_v, 6) AS target_v, regime_label, anomaly_label FROM ws")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lambda c: F.transform(c, lambda x: x[0])
    add = lambda c: F.aggregate(v(c), F.lit(0.0), lambda a, b: a + b)
    return _windows(spark, sf_dir).select("series_id", "start", r6(add("window"), "sum_v"), r6(F.col("window")[L - 1][0], "last_v"), r6(add("target") / H, "target_v"), "regime_label", "anomaly_label")


@query("window_count_per_series", f"WITH {EV}, {WINDOWS} SELECT series_id, count(*) AS n_windows FROM ws GROUP BY 1")
def window_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).groupBy("series_id").agg(F.count("*").alias("n_windows"))


@query("windows_union", f"WITH {EV}, {WINDOWS}, u AS (SELECT 0 AS group_id, * FROM ws WHERE series_id % 2 = 0 UNION ALL SELECT 1, * FROM ws WHERE series_id % 2 = 1) SELECT group_id, series_id, start, row_number() OVER (ORDER BY group_id, series_id, start) - 1 AS seq FROM u")
def windows_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _windows(spark, sf_dir)
    return windows.concat([made.where("series_id % 2 = 0"), made.where("series_id % 2 = 1")], ["series_id", "start"]).select("group_id", "series_id", "start", "seq")


@query("regime_features", f"WITH {EV}, {WINDOWS} SELECT series_id, start, round(mean_v, 6) AS mean_v, round(std_v, 6) AS std_v, round(last_v, 6) AS last_v, round(last_v - first_v, 6) + 0.0 AS delta_v FROM ws")
def regime_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _windows(spark, sf_dir).select("series_id", "start", clustering.window_features().alias("f"))
    return f.select("series_id", "start", r6(F.col("f")[0], "mean_v"), r6(F.col("f")[2], "std_v"), r6(F.col("f")[4], "last_v"), (F.round(F.col("f")[6], 6) + 0.0).alias("delta_v"))


@query("nearest_centroid", f"WITH {EV}, c(c, a, b) AS (VALUES (0, 10.0, 10.0), (1, 50.0, 50.0), (2, 90.0, 30.0)), d AS (SELECT series_id, t, c, (v - a) * (v - a) + (k - b) * (k - b) AS d FROM ev, c) SELECT series_id, t, CAST(arg_min(c, (d, c)) AS BIGINT) AS label FROM d GROUP BY 1, 2")
def nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = clustering.nearest(F.col("x"), [[10.0, 10.0], [50.0, 50.0], [90.0, 30.0]])
    return series_events(spark, sf_dir).select("series_id", "t", label.alias("label"))


@query("kmeans_pseudo_regimes")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = windows.concat([_windows(spark, sf_dir)], ["series_id", "start"])
    model = clustering.fit_pseudo_regimes(made, 3, seed=7)
    return model.predict(made).select("series_id", "start", "regime_label")


def _injected(spark: SparkSession, sf_dir: str, *events: failures.FailureEvent) -> DataFrame:
    done = failures.inject(series_events(spark, sf_dir), events, strict=False)
    return done.select("series_id", "t", r6(F.col("x")[0], "v"), r6(F.col("x")[1], "k"), F.col("anomaly_label").cast("int").alias("label"))


def _inject_sql(value: str, a: int = 10, b: int = 20, more: str = "") -> str:
    return f"WITH {EV}{more} SELECT series_id, t, round(CASE WHEN t >= {a} AND t < {b} THEN {value} ELSE v END, 6) AS v, round(k, 6) AS k, CAST(CASE WHEN t >= {a} AND t < {b} THEN 1 ELSE anomaly_label END AS INT) AS label FROM ev"


E = failures.FailureEvent


@query("inject_dropout", _inject_sql("-1.0"))
def inject_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, E("dropout", 10, 20, (0,), value=-1.0))


@query("inject_drift", _inject_sql("v + CAST(3.0 AS DOUBLE) * (t - 10) / 9"))
def inject_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, E("additive_drift", 10, 20, (0,), magnitude=3.0))


@query("inject_spikes", _inject_sql("CASE WHEN (t - 10) % 4 = 0 THEN v + 7 ELSE v END"))
def inject_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, E("spike_train", 10, 20, (0,), magnitude=7.0, period=4))


@query("inject_stuck_at", _inject_sql("h", more=", hs AS (SELECT series_id AS sid, v AS h FROM ev WHERE t = 9)") + " JOIN hs ON sid = series_id")
def inject_stuck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, E("stuck_at", 10, 20, (0,)))


@query("inject_phase_shift", _inject_sql("p", more=", q AS (SELECT series_id AS sid, t AS qt, coalesce(lag(v, 3) OVER (PARTITION BY series_id ORDER BY t), first_value(v) OVER (PARTITION BY series_id ORDER BY t)) AS p FROM ev)") + " JOIN q ON sid = series_id AND qt = t")
def inject_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, E("phase_shift", 10, 20, (0,), lag=3))


@query(
    "inject_compound",
    f"WITH {EV}, d AS (SELECT * REPLACE (CASE WHEN t >= 5 AND t < 15 THEN v + CAST(2.0 AS DOUBLE) * (t - 5) / 9 ELSE v END AS v) FROM ev), hs AS (SELECT series_id AS sid, v AS h FROM d WHERE t = 11) "
    "SELECT series_id, t, round(CASE WHEN t >= 12 AND t < 18 THEN h ELSE v END, 6) AS v, round(k, 6) AS k, CAST(CASE WHEN t >= 5 AND t < 18 THEN 1 ELSE anomaly_label END AS INT) AS label FROM d JOIN hs ON sid = series_id",
)
def inject_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, E("additive_drift", 5, 15, (0,), magnitude=2.0), E("stuck_at", 12, 18, (0,)))


@query("inject_noise")
def inject_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _injected(spark, sf_dir, E("multiplicative_noise", 10, 20, (0,), magnitude=0.5))


@query("switching_ar_generate")
def generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthetic.generate(synthetic.draw_configs(spark, synthetic.ConfigSpace(), 4, 2, 2, seed=11), 200, seed=11)
    return made.select("series_id", "split", "t", r6(F.col("x")[0], "v"), "regime_label")
