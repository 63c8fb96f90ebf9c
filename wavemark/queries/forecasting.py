"""Queries over forecasts: baselines, mixture scores, diagnostics and anomaly scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import gaussian, mixture, scores
from ..functions.energy import energy_score
from ..functions.intervals import channel_coverage
from ..operators import baselines, diagnostics, regimes, scaling, windows
from ..operators.sequence import CHUNK, numbered, spread
from ..plans import neural
from .series import H, L, S, WINDOWS, _windows, r6
from .views import EV, Query, series_events

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("seasonal_naive_fit", f"WITH {EV}, d AS (SELECT series_id, v - lag(v, 7) OVER w AS dv, k - lag(k, 7) OVER w AS dk FROM ev WINDOW w AS (PARTITION BY series_id ORDER BY t)) SELECT series_id, round(coalesce(greatest(stddev_pop(dv), 1e-3), 1.0), 6) AS s0, round(coalesce(greatest(stddev_pop(dk), 1e-3), 1.0), 6) AS s1 FROM d GROUP BY 1")
def seasonal_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.fit_seasonal(series_events(spark, sf_dir), 7).select("series_id", r6(F.col("std")[0], "s0"), r6(F.col("std")[1], "s1"))


@query("seasonal_naive_forecast", f"WITH {EV}, ws AS (SELECT series_id, t - {L - 1} AS start, v AS a, lag(v, 1) OVER p AS b, lag(v, 2) OVER p AS c, n FROM ev WINDOW p AS (PARTITION BY series_id ORDER BY t)), h AS (SELECT unnest(range({H + 2})) AS h) SELECT series_id, start, CAST(h AS INT) AS h, round(CASE h % 3 WHEN 0 THEN c WHEN 1 THEN b ELSE a END, 6) AS mean FROM ws, h WHERE start >= 0 AND start % {S} = 0 AND start <= n - {L + H}")
def seasonal_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = baselines.forecast_seasonal(_windows(spark, sf_dir), 3, H + 2, F.array(F.lit(1.0), F.lit(1.0)))
    return made.select("series_id", "start", "h", r6(F.col("means")[0][0], "mean"))


@query("persistence_forecast", f"WITH {EV}, {WINDOWS}, h AS (SELECT unnest(range({H})) AS h) SELECT series_id, start, CAST(h AS INT) AS h, round(last_v, 6) AS mean, 2.0::DOUBLE AS std FROM ws, h")
def persistence_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = baselines.forecast_persistence(_windows(spark, sf_dir), H, 2.0)
    return made.select("series_id", "start", "h", r6(F.col("means")[0][0], "mean"), F.col("stds")[0][0].alias("std"))


@query(
    "flatten_windows_residual_std",
    f"WITH {EV}, {WINDOWS}, q AS (SELECT series_id, start, row_number() OVER (ORDER BY series_id, start) - 1 AS seq FROM ws), f AS (SELECT seq * {L} + (ev.t - q.start) AS place, v FROM q JOIN ev ON ev.series_id = q.series_id AND ev.t BETWEEN q.start AND q.start + {L - 1}), d AS (SELECT v - lag(v) OVER (ORDER BY place) AS d FROM f) SELECT round(stddev_pop(d), 6) AS std FROM d",
)
def flatten_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = numbered(_windows(spark, sf_dir).select("series_id", "start", "window"), ["series_id"], ["start"], chunk=CHUNK)
    flat = windows.flatten(made, lookback=L).select("place", "x")
    return baselines.fit_seasonal(flat, 1, by=(), t="place").select(r6(F.col("std")[0], "std"))


# Mixtures made from the events by arithmetic: two components, two channels.


def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, k, t = F.col("x")[0], F.col("x")[1], F.col("t")
    return series_events(spark, sf_dir).select(
        "series_id", "t", F.col("x").alias("observed"),
        F.array((1 + t % 3).cast("double"), F.lit(2.0)).alias("weights"),
        F.array(F.array(v + 0.5, k - 1), F.array(v * 0.8, k + 2)).alias("means"),
        F.array(F.array(1 + 0.1 * (t % 5), F.lit(2.0)), F.array(0.5 + 0.05 * k, F.lit(1.5))).alias("stds"),
    )


MX = f"""{EV}, mx AS (SELECT series_id, t, v, k, CAST(1 + t % 3 AS DOUBLE) / (3 + t % 3) AS w1, CAST(2 AS DOUBLE) / (3 + t % 3) AS w2, v + 0.5 AS m1v, k - 1 AS m1k, v * 0.8::DOUBLE AS m2v, k + 2 AS m2k,
  1 + 0.1::DOUBLE * (t % 5) AS s1v, 2.0::DOUBLE AS s1k, 0.5 + 0.05::DOUBLE * k AS s2v, 1.5::DOUBLE AS s2k FROM ev)"""


def _ln(y: str, m: str, s: str) -> str:
    return f"(-0.5 * (pow(({y} - {m}) / {s}, 2) + 2 * ln({s}) + ln(2 * pi())))"


def _lse(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"


JOINT = f"j AS (SELECT *, ln(w1) + {_ln('v', 'm1v', 's1v')} + {_ln('k', 'm1k', 's1k')} AS a, ln(w2) + {_ln('v', 'm2v', 's2v')} + {_ln('k', 'm2k', 's2k')} AS b, ln(w1) + {_ln('v', 'm1v', 's1v')} AS av, ln(w2) + {_ln('v', 'm2v', 's2v')} AS bv, ln(w1) + {_ln('k', 'm1k', 's1k')} AS ak, ln(w2) + {_ln('k', 'm2k', 's2k')} AS bk FROM mx)"
NLL = f"{MX}, {JOINT}, nl AS (SELECT *, -{_lse('a', 'b')} AS nll, -{_lse('av', 'bv')} AS cv, -{_lse('ak', 'bk')} AS ck FROM j)"
COLUMNS = ("observed", "weights", "means", "stds")


def _cols():
    return [F.col(c) for c in COLUMNS]


@query("mixture_nll", f"WITH {NLL} SELECT series_id, t, round(nll, 6) AS nll FROM nl")
def mixture_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures(spark, sf_dir).select("series_id", "t", r6(mixture.nll(*_cols()), "nll"))


@query("channelwise_nll", f"WITH {NLL} SELECT series_id, t, round(cv, 6) AS nll_v, round(ck, 6) AS nll_k FROM nl")
def channel_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixtures(spark, sf_dir).select("series_id", "t", mixture.channel_nll(*_cols()).alias("c"))
    return rows.select("series_id", "t", r6(F.col("c")[0], "nll_v"), r6(F.col("c")[1], "nll_k"))


@query("predictive_mean", f"WITH {MX} SELECT series_id, t, round(w1 * m1v + w2 * m2v, 6) AS mean_v, round(w1 * m1k + w2 * m2k, 6) + 0.0 AS mean_k FROM mx")
def predictive_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixtures(spark, sf_dir).select("series_id", "t", mixture.predictive_mean(F.col("weights"), F.col("means")).alias("m"))
    return rows.select("series_id", "t", r6(F.col("m")[0], "mean_v"), (F.round(F.col("m")[1], 6) + 0.0).alias("mean_k"))


@query("forecast_mae_rmse", f"WITH {MX}, e AS (SELECT series_id, unnest([v - (w1 * m1v + w2 * m2v), k - (w1 * m1k + w2 * m2k)]) AS e FROM mx) SELECT series_id, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse FROM e GROUP BY 1")
def mae_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixtures(spark, sf_dir).select("series_id", F.explode(mixture.absolute_errors(*_cols()[:3])).alias("e"))
    return rows.groupBy("series_id").agg(r6(F.avg("e"), "mae"), r6(F.sqrt(F.avg(F.col("e") * F.col("e"))), "rmse"))


def _crps_sql(y: str, c: str) -> str:
    m1, m2, s1, s2 = f"m1{c}", f"m2{c}", f"s1{c}", f"s2{c}"
    a = gaussian.absolute_mean_sql
    both = f"sqrt({s1} * {s1} + {s2} * {s2})"
    return f"w1 * {a(f'{y} - {m1}', s1)} + w2 * {a(f'{y} - {m2}', s2)} - 0.5 * (w1 * w1 * {a('0.0', f'sqrt(2 * {s1} * {s1})')} + w2 * w2 * {a('0.0', f'sqrt(2 * {s2} * {s2})')} + w1 * w2 * ({a(f'{m1} - {m2}', both)} + {a(f'{m2} - {m1}', both)}))"


@query("mixture_crps", f"WITH {MX} SELECT series_id, t, round({_crps_sql('v', 'v')}, 6) AS crps_v, round({_crps_sql('k', 'k')}, 6) AS crps_k FROM mx")
def crps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixtures(spark, sf_dir).select("series_id", "t", mixture.channel_crps(*_cols()).alias("c"))
    return rows.select("series_id", "t", r6(F.col("c")[0], "crps_v"), r6(F.col("c")[1], "crps_k"))


@query("mixture_pit", f"WITH {MX} SELECT series_id, t, round(w1 * {gaussian.cdf_sql('((v - m1v) / s1v)')} + w2 * {gaussian.cdf_sql('((v - m2v) / s2v)')}, 6) AS pit_v FROM mx")
def pit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures(spark, sf_dir).select("series_id", "t", r6(F.get(mixture.pit(*_cols()), F.lit(0)), "pit_v"))


def _coverage_sql(n_grid: int = 128) -> str:
    """Central intervals by the same grid of points: a point is reached where the distribution
    function is at the level or above, and the interval's end is interpolated from the point before."""
    ends = "p AS (SELECT series_id, t, unnest([struct_pack(d := 0, y := v, m1 := m1v, m2 := m2v, s1 := s1v, s2 := s2v), struct_pack(d := 1, y := k, m1 := m1k, m2 := m2k, s1 := s1k, s2 := s2k)]) AS c, w1, w2 FROM mx), e AS (SELECT series_id, t, c.d AS d, c.y AS y, c.m1 AS m1, c.m2 AS m2, c.s1 AS s1, c.s2 AS s2, w1, w2, least(c.m1 - 8 * c.s1, c.m2 - 8 * c.s2) AS lo, greatest(c.m1 + 8 * c.s1, c.m2 + 8 * c.s2) AS hi FROM p)"
    grid = f"g AS (SELECT *, lo + (hi - lo) * (i / {n_grid - 1}.0::DOUBLE) AS x FROM e, (SELECT unnest(range({n_grid})) AS i)), f AS (SELECT *, w1 * {gaussian.cdf_sql('((x - m1) / s1)')} + w2 * {gaussian.cdf_sql('((x - m2) / s2)')} AS f FROM g)"
    steps = "l AS (SELECT *, lag(x) OVER w AS bx, lag(f) OVER w AS bf FROM f WINDOW w AS (PARTITION BY series_id, t, d ORDER BY i))"
    end = lambda q: f"arg_min(CASE WHEN i = 0 THEN x ELSE bx + (x - bx) * least(greatest(({q} - bf) / greatest(f - bf, 1e-12), 0), 1) END, i) FILTER (f >= {q})"
    return f"WITH {MX}, {ends}, {grid}, {steps}, q AS (SELECT series_id, t, d, any_value(y) AS y, {end('0.05::DOUBLE')} AS a, {end('0.95::DOUBLE')} AS b FROM l GROUP BY 1, 2, 3) SELECT series_id, round(avg(CAST(y >= a AND y <= b AS INT)), 6) AS coverage FROM q GROUP BY 1"


@query("interval_coverage_90", _coverage_sql())
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixtures(spark, sf_dir).select("series_id", F.explode(channel_coverage(*COLUMNS)).alias("c"))
    return rows.groupBy("series_id").agg(r6(F.avg("c"), "coverage"))


@query("energy_score")
def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(mixtures(spark, sf_dir), "series_id", "t").withColumn("key", F.abs(F.hash("series_id", "t")))
    return rows.select("series_id", "t", r6(energy_score(*COLUMNS, "key"), "energy"))


EXAMPLE = "series_id, t // 4 AS example"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four steps make one example."""
    return mixtures(spark, sf_dir).withColumn("example", F.floor(F.col("t") / 4))


def _score(name: str, method: str, sql: str) -> None:
    @query(name, f"WITH {NLL}, x AS (SELECT {EXAMPLE}, nll, unnest([cv, ck]) AS c FROM nl) {sql}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = scores.forecast_scores(_examples(spark, sf_dir), method, ["series_id", "example"])
        return made.select("series_id", "example", r6(F.col("score"), "score"))


_score("score_mean_nll", "mean_nll", "SELECT series_id, example, round(avg(nll), 6) AS score FROM x GROUP BY 1, 2")
_score("score_channel_mean", "channel_mean_nll", "SELECT series_id, example, round(avg(c), 6) AS score FROM x GROUP BY 1, 2")
_score("score_channel_max", "channel_max_nll", "SELECT series_id, example, round(max(c), 6) AS score FROM x GROUP BY 1, 2")
_score("score_channel_top3", "channel_top3_mean_nll", "SELECT series_id, example, round(list_avg(max(c, 3)), 6) AS score FROM x GROUP BY 1, 2")


# Posteriors over three regimes, from the events by arithmetic.


def posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.pmod(F.col("x")[1].cast("long"), F.lit(4)) + 1.0, F.col("t") % 3 + 1.0
    rows = series_events(spark, sf_dir).select("series_id", "t", F.transform(F.array(a, b, F.lit(2.0)), lambda p: p / (a + b + 2)).alias("probs"), "regime_label")
    return numbered(rows, ["series_id"], ["t"], chunk=CHUNK)


PO = f"""{EV}, q AS (SELECT series_id, t, regime_label, row_number() OVER (ORDER BY series_id, t) - 1 AS seq, CAST(k AS BIGINT) % 4 + 1.0::DOUBLE AS a, t % 3 + 1.0::DOUBLE AS b FROM ev),
po AS (SELECT *, a / (a + b + 2) AS p1, b / (a + b + 2) AS p2, 2 / (a + b + 2) AS p3 FROM q), pe AS (SELECT *, -(p1 * ln(p1) + p2 * ln(p2) + p3 * ln(p3)) AS e, greatest(p1, p2, p3) AS c,
  CASE WHEN p1 >= p2 AND p1 >= p3 THEN 0 WHEN p2 >= p3 THEN 1 ELSE 2 END AS best, 1 - (p1 * lag(p1) OVER w + p2 * lag(p2) OVER w + p3 * lag(p3) OVER w) AS sw FROM po WINDOW w AS (ORDER BY seq))"""


def _regime(name: str, method: str, sql: str) -> None:
    @query(name, f"WITH {PO} SELECT series_id, t, round({sql}, 6) AS score FROM pe")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scores.regime_scores(posteriors(spark, sf_dir), method).select("series_id", "t", r6(F.col("score"), "score"))


_regime("score_regime_entropy", "regime_entropy", "e / ln(3)")
_regime("score_regime_confidence_gap", "regime_confidence_gap", "1 - c")
_regime("score_regime_switch", "regime_switch", "coalesce(sw, 0)")


@query("posterior_argmax", f"WITH {PO} SELECT series_id, t, CAST(best AS BIGINT) AS best FROM pe")
def posterior_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posteriors(spark, sf_dir).select("series_id", "t", regimes.argmax(F.col("probs")).alias("best"))


@query("posterior_diagnostics", f"WITH {PO}, s AS (SELECT *, lag(best) OVER (ORDER BY seq) AS was FROM pe) SELECT round(avg(e), 6) AS mean_entropy, round(avg(e / ln(3)), 6) AS mean_normalized_entropy, round(avg(c), 6) AS mean_confidence, count(*) FILTER (best <> was) AS switches FROM s")
def posterior_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = regimes.posterior_diagnostics(posteriors(spark, sf_dir))
    return d.select(*(r6(F.col(c), c) for c in ("mean_entropy", "mean_normalized_entropy", "mean_confidence")), "switches")


@query("component_weights", f"WITH {MX} SELECT 0 AS component, round(avg(w1), 6) AS mean_weight FROM mx UNION ALL SELECT 1, round(avg(w2), 6) FROM mx")
def component_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.component_weights(mixtures(spark, sf_dir)).select("component", r6(F.col("mean_weight"), "mean_weight"))


STDS = "s AS (SELECT unnest([s1v, s1k, s2v, s2k]) AS s FROM mx)"


@query("std_summary", f"WITH {MX}, {STDS} SELECT round(min(s), 6) AS min, round(quantile_cont(s, 0.05), 6) AS p05, round(quantile_cont(s, 0.5), 6) AS median, round(avg(s), 6) AS mean, round(quantile_cont(s, 0.95), 6) AS p95, round(max(s), 6) AS max FROM s")
def std_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diagnostics.std_summary(mixtures(spark, sf_dir))
    return d.select(*(r6(F.col(c), c) for c in d.columns))


@query("component_pairwise_distance", f"WITH {MX} SELECT series_id, t, round(sqrt((m1v - m2v) * (m1v - m2v) + 9), 6) AS distance FROM mx")
def pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures(spark, sf_dir).select("series_id", "t", r6(mixture.pairwise_distance(F.col("means")), "distance"))


@query(
    "mixture_diagnostics",
    f"WITH {MX}, e AS (SELECT *, -(w1 * ln(w1) + w2 * ln(w2)) AS e FROM mx), m AS (SELECT avg(e) AS e, min(e) AS least, max(e) AS most, avg(sqrt((m1v - m2v) * (m1v - m2v) + 9)) AS d, avg(w1) AS a, avg(w2) AS b FROM e), "
    "s AS (SELECT unnest([s1v, s1k, s2v, s2k]) AS s FROM mx), sd AS (SELECT min(s) AS lo, quantile_cont(s, 0.05) AS p05, quantile_cont(s, 0.5) AS med, avg(s) AS mean, quantile_cont(s, 0.95) AS p95, max(s) AS hi FROM s) "
    "SELECT round(e, 6) AS mean_entropy, round(least, 6) AS min_entropy, round(most, 6) AS max_entropy, round(e / ln(2), 6) AS mean_normalized_entropy, round(d, 6) AS mean_pairwise_distance, round(a, 6) AS mean_weight_0, round(b, 6) AS mean_weight_1, "
    "CAST((a >= 0.01)::INT + (b >= 0.01)::INT AS BIGINT) AS active_components, round(exp(-(a * ln(a) + b * ln(b))), 6) AS effective_components, "
    "round(lo, 6) AS std_min, round(p05, 6) AS std_p05, round(med, 6) AS std_median, round(mean, 6) AS std_mean, round(p95, 6) AS std_p95, round(hi, 6) AS std_max FROM m, sd",
)
def mixture_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = diagnostics.mixture_diagnostics(mixtures(spark, sf_dir))
    means = [r6(F.get("component_mean_weights", F.lit(k)), f"mean_weight_{k}") for k in range(2)]
    std = [r6(F.col(f"std.{c}"), f"std_{c}") for c in ("min", "p05", "median", "mean", "p95", "max")]
    return d.select(*(r6(F.col(c), c) for c in ("mean_entropy", "min_entropy", "max_entropy", "mean_normalized_entropy", "mean_pairwise_distance")), *means, "active_components", r6(F.col("effective_components"), "effective_components"), *std)


def _forecast(spark: SparkSession, sf_dir: str, n_regimes: int) -> DataFrame:
    """A small model of all scaled windows, trained for one epoch; its forecasts' means."""
    ev = series_events(spark, sf_dir)
    made = windows.make_windows(scaling.scale(ev, scaling.fit_scaler(ev)), L, H, S)
    rows = numbered(made, ["series_id"], ["start"], chunk=CHUNK)
    config = neural.ModelConfig(2, H, hidden=6, components=2, n_regimes=n_regimes)
    model = neural.train(rows, config, neural.TrainingConfig(epochs=1, supervised=0.1 if n_regimes else 0.0))
    return neural.predict(rows, model, ("series_id", "start")).select("series_id", "start", "h", F.round(mixture.predictive_mean(F.col("weights"), F.col("means"))[0], 4).alias("mean"), regimes.argmax(F.col("probs")).alias("regime") if n_regimes else F.lit(0).cast("long").alias("regime"))


@query("mdn_forecast")
def mdn_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(spark, sf_dir, 0)


@query("joint_forecast")
def joint_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forecast(spark, sf_dir, 5)
