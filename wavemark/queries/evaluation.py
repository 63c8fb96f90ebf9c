"""Queries over scores and labels: thresholds, ranges, curves, and agreement of regimes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quantiles, ranges, regimes, selection, thresholds
from ..operators.sequence import kept
from .forecasting import PO, posteriors
from .series import r6
from .views import SC, Query, scored

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


LEVELS = list(thresholds.GLOBAL_QUANTILES.items())


@query("threshold_quantile", f"WITH {SC} " + " UNION ALL ".join(f"SELECT '{n}' AS strategy, round(quantile_cont(score, {q}::DOUBLE), 6) AS threshold FROM val" for n, q in LEVELS))
def threshold_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quantiles.exact_quantiles(scored(spark, sf_dir, "validation"), "score", [q for _, q in LEVELS])
    rows = spark.createDataFrame([(n, v) for (n, _), v in zip(LEVELS, found, strict=True)], "strategy string, threshold double")
    return rows.select("strategy", r6(F.col("threshold"), "threshold"))


GROUPED = "th AS (SELECT group_id, round(quantile_cont(score, 0.9), 9) AS threshold FROM val GROUP BY 1)"


def _by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = thresholds.group_quantiles(scored(spark, sf_dir, "validation"), 0.9)
    return found.select("group_id", F.round("threshold", 9).alias("threshold"))


@query("threshold_per_group", f"WITH {SC}, {GROUPED} SELECT group_id, round(threshold, 6) AS threshold FROM th")
def threshold_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_group(spark, sf_dir).select("group_id", r6(F.col("threshold"), "threshold"))


@query("predict_grouped", f"WITH {SC}, {GROUPED} SELECT group_id, t, CAST(score >= threshold AS INT) AS pred FROM tst JOIN th USING (group_id)")
def predict_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.predict_by_group(scored(spark, sf_dir, "test"), _by_group(spark, sf_dir)).select("group_id", "t", "pred")


FIXED = 6.0
PR = f"{SC}, pr AS (SELECT *, CAST(score >= {FIXED} AS INT) AS pred FROM tst)"


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.predict(scored(spark, sf_dir, "test"), FIXED)


@query("predict_global", f"WITH {PR} SELECT group_id, t, pred FROM pr")
def predict_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).select("group_id", "t", "pred")


@query("persistence_filter", f"WITH {PR} SELECT seq, CAST(sum(pred) OVER (ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS INT) AS pred FROM pr")
def persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.persist(_predicted(spark, sf_dir), 3, 2).select("seq", "pred")


@query("persistence_grouped", f"WITH {PR} SELECT group_id, t, CAST(sum(pred) OVER (PARTITION BY group_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS INT) AS pred FROM pr")
def persistence_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thresholds.persist(_predicted(spark, sf_dir), 3, 2, "t", ["group_id"]).select("group_id", "t", "pred")


def _islands(flag: str, source: str, out: str, key: str = "") -> str:
    by = f"PARTITION BY {key} " if key else ""
    keys = f"{key}, " if key else ""
    return f"{out} AS (SELECT {keys}min(seq) AS s, max(seq) + 1 AS e, avg(label) AS true_share, avg(pred) AS pred_share, min(CASE WHEN pred = 1 THEN seq END) - min(seq) AS delay FROM (SELECT *, seq - row_number() OVER ({by}ORDER BY seq) AS island FROM {source} WHERE {flag} = 1) GROUP BY {keys}island)"


ISLANDS = f"{PR}, {_islands('label', 'pr', 'ti')}, {_islands('pred', 'pr', 'pi')}"


@query("anomaly_ranges", f'WITH {ISLANDS} SELECT s AS "start", e AS "end" FROM ti')
def anomaly_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.ranges(scored(spark, sf_dir, "test"), "label")


MEASURES = "m AS (SELECT coalesce((SELECT avg(true_share) FROM pi), 0) AS p, coalesce((SELECT avg(pred_share) FROM ti), 0) AS r)"
ROUNDED = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1"


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


@query("range_precision_recall", f"WITH {ISLANDS}, {MEASURES} SELECT {ROUNDED} FROM m")
def range_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranges.range_metrics(_predicted(spark, sf_dir)))


@query(
    "range_metrics_per_series",
    f"WITH {PR}, {_islands('label', 'pr', 'ti', 'group_id')}, {_islands('pred', 'pr', 'pi', 'group_id')}, a AS (SELECT group_id, max(label) AS t, max(pred) AS q FROM pr GROUP BY 1), tr AS (SELECT group_id, avg(pred_share) AS r FROM ti GROUP BY 1), pp AS (SELECT group_id, avg(true_share) AS p FROM pi GROUP BY 1), "
    f"m AS (SELECT group_id, CASE WHEN t + q = 0 THEN 1 ELSE coalesce(p, 0) END AS p, CASE WHEN t + q = 0 THEN 1 ELSE coalesce(r, 0) END AS r FROM a LEFT JOIN tr USING (group_id) LEFT JOIN pp USING (group_id)) SELECT group_id, {ROUNDED} FROM m",
)
def range_metrics_per_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ranges.range_metrics(_predicted(spark, sf_dir), by=["group_id"], seq="t"), "group_id")


@query("range_overlap_join", f"WITH {ISLANDS}, o AS (SELECT ti.s, ti.e, sum(CASE WHEN pi.s IS NULL THEN 0 ELSE greatest(0, least(ti.e, pi.e) - greatest(ti.s, pi.s)) END) AS overlap FROM ti LEFT JOIN pi ON pi.s < ti.e AND ti.s < pi.e GROUP BY 1, 2) SELECT s AS \"start\", e AS \"end\", CAST(overlap AS BIGINT) AS overlap FROM o")
def range_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = ranges.island_numbers(_predicted(spark, sf_dir), "label")
    return numbers.groupBy("island").agg(F.min("seq").alias("start"), (F.max("seq") + 1).alias("end"), F.sum("pred").alias("overlap")).drop("island")


RATES = "coalesce(tp / nullif(tp + fp, 0), 1) AS p, coalesce(tp / nullif(tp + fn, 0), 1) AS r, coalesce(fp / nullif(fp + tn, 0), 0) AS f"


@query("confusion", f"WITH {PR}, c AS (SELECT count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 1 AND pred = 0) AS fn FROM pr), q AS (SELECT *, {RATES} FROM c) SELECT tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS fpr FROM q")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ranges.confusion(_predicted(spark, sf_dir))
    return c.select("tp", "fp", "tn", "fn", *(r6(F.col(x), x) for x in ("precision", "recall", "fpr")))


@query("detection_delay", f"WITH {ISLANDS} SELECT round(avg(delay), 6) AS mean_delay, round(median(delay), 6) AS median_delay, count(delay) AS detected, count(*) - count(delay) AS missed FROM ti")
def detection_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ranges.detection_delay(_predicted(spark, sf_dir))
    return d.select(r6(F.col("mean_delay"), "mean_delay"), r6(F.col("median_delay"), "median_delay"), "detected", "missed")


@query("false_alarm_rate", f"WITH {PR}, l AS (SELECT *, coalesce(lag(pred) OVER (ORDER BY seq), 0) AS was FROM pr) SELECT round(1000.0::DOUBLE * count(*) FILTER (pred = 1 AND was = 0 AND label = 0) / count(*) FILTER (label = 0), 6) AS false_alarms_per_1000 FROM l")
def false_alarm_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranges.false_alarm_rate(_predicted(spark, sf_dir)).select(r6(F.col("false_alarms_per_1000"), "false_alarms_per_1000"))


# Sweeps. Thresholds are rounded, so that both engines compare scores with the same numbers.

_SWEEP = ", ".join(f"{1 - i / 62!r}::DOUBLE" for i in range(63))


def _candidates_sql(source: str) -> str:
    return f"""u AS (SELECT DISTINCT score FROM {source}), qs AS (SELECT unnest(quantile_cont(score, [{_SWEEP}])) AS th FROM u),
raw AS (SELECT DISTINCT round(th, 9) AS th FROM qs), cn AS (SELECT th AS threshold, row_number() OVER (ORDER BY th DESC) AS cand_ix FROM raw UNION ALL SELECT (SELECT max(th) FROM raw) + 1, 0)"""


def _candidates(df: DataFrame) -> list[float]:
    found = thresholds.candidates(df)[1:]
    rounded = list(dict.fromkeys(round(c, 9) for c in found))
    return [rounded[0] + 1, *rounded]


@query("threshold_candidates", f"WITH {SC}, {_candidates_sql('tst')} SELECT CAST(cand_ix AS INT) AS cand_ix, round(threshold, 6) AS threshold FROM cn WHERE cand_ix > 0")
def threshold_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = list(enumerate(_candidates(scored(spark, sf_dir, "test"))))[1:]
    return spark.createDataFrame(found, "cand_ix int, threshold double").select("cand_ix", r6(F.col("threshold"), "threshold"))


def _points_sql(source: str) -> str:
    return f"pt AS (SELECT cand_ix, threshold, count(*) FILTER (label = 1 AND score >= threshold) AS tp, count(*) FILTER (label = 0 AND score >= threshold) AS fp, count(*) FILTER (label = 0 AND score < threshold) AS tn, count(*) FILTER (label = 1 AND score < threshold) AS fn FROM cn, {source} GROUP BY 1, 2), pts AS (SELECT *, {RATES} FROM pt)"


def _range_sql(source: str) -> str:
    return f"""b AS (SELECT cand_ix, threshold, seq, label, CAST(score >= threshold AS INT) AS pred FROM cn, {source}),
tl AS (SELECT *, seq - row_number() OVER (PARTITION BY cand_ix ORDER BY seq) AS island FROM b WHERE label = 1), tr AS (SELECT cand_ix, avg(x) AS r FROM (SELECT cand_ix, avg(pred) AS x FROM tl GROUP BY cand_ix, island) GROUP BY 1),
pl AS (SELECT *, seq - row_number() OVER (PARTITION BY cand_ix ORDER BY seq) AS island FROM b WHERE pred = 1), pp AS (SELECT cand_ix, avg(x) AS p FROM (SELECT cand_ix, avg(label) AS x FROM pl GROUP BY cand_ix, island) GROUP BY 1),
rc AS (SELECT cn.cand_ix, cn.threshold, coalesce(pp.p, 0) AS p, coalesce(tr.r, 0) AS r, pts.f FROM cn LEFT JOIN tr USING (cand_ix) LEFT JOIN pp USING (cand_ix) JOIN pts USING (cand_ix)),
rf AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM rc)"""


TEST_SWEEP = f"{SC}, {_candidates_sql('tst')}, {_points_sql('tst')}"
RANGE_SWEEP = f"{TEST_SWEEP}, {_range_sql('tst')}"


def _swept(spark: SparkSession, sf_dir: str, split: str = "test", use=lambda rows: rows) -> DataFrame:
    """What ``use`` makes of the sweep over a split's candidates: a row for each of them at most. The
    scores are computed once."""
    with kept(scored(spark, sf_dir, split)) as rows:
        return ranges.gathered(use(ranges.sweep(rows, _candidates(rows))))


def _points(rows: DataFrame) -> DataFrame:
    return ranges.with_rates(rows.select("cand_ix", "threshold", "tp", "fp", "tn", "fn"))


@query("pr_curve", f"WITH {TEST_SWEEP} SELECT CAST(cand_ix AS INT) AS cand_ix, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall FROM pts")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _points(_swept(spark, sf_dir))
    return p.select("cand_ix", "tp", "fp", "tn", "fn", r6(F.col("precision"), "precision"), r6(F.col("recall"), "recall"))


@query("roc_curve", f"WITH {TEST_SWEEP} SELECT CAST(cand_ix AS INT) AS cand_ix, round(f, 6) AS fpr, round(r, 6) AS tpr FROM pts")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(_swept(spark, sf_dir)).select("cand_ix", r6(F.col("fpr"), "fpr"), r6(F.col("recall"), "tpr"))


@query("range_curve", f"WITH {RANGE_SWEEP} SELECT CAST(cand_ix AS INT) AS cand_ix, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS fpr, round(f1, 6) AS f1 FROM rf")
def range_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _swept(spark, sf_dir)
    return c.select("cand_ix", *(r6(F.col(x), x) for x in ("precision", "recall", "fpr", "f1")))


ALL_SWEEP = f"{SC}, cn AS (SELECT score AS threshold, row_number() OVER (ORDER BY score DESC) AS cand_ix FROM (SELECT DISTINCT score FROM tst)), {_points_sql('tst')}, {_range_sql('tst')}"


@query("range_curve_all_scores", f"WITH {ALL_SWEEP} SELECT round(rf.threshold, 6) AS threshold, tp, fp, round(rf.p, 6) AS precision, round(rf.r, 6) AS recall, round(f1, 6) AS f1 FROM rf JOIN pts USING (cand_ix)")
def range_curve_all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ranges.sweep_all_scores(scored(spark, sf_dir, "test"))
    return c.select(r6(F.col("threshold"), "threshold"), "tp", "fp", *(r6(F.col(x), x) for x in ("precision", "recall", "f1")))


def _step_sql(points: str) -> str:
    return f"(SELECT sum((x - before) * env) FROM (SELECT x, max(y) OVER (ORDER BY x DESC) AS env, lag(x, 1, 0) OVER (ORDER BY x) AS before FROM (SELECT r AS x, max(p) AS y FROM {points} GROUP BY 1)))"


def _trapezoid_sql(points: str) -> str:
    return f"(SELECT sum((x2 - f) * (r + y2) / 2) FROM (SELECT f, r, lead(f) OVER w AS x2, lead(r) OVER w AS y2 FROM {points} WINDOW w AS (ORDER BY f, cand_ix)))"


def _area(name: str, pick, sweep: str, sql: str) -> None:
    @query(name, f"WITH {sweep} SELECT round({sql}, 6) AS area")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return pick(_swept(spark, sf_dir)).select(r6(F.col("area"), "area"))


_area("average_precision", lambda swept: ranges.step_area(_points(swept)), TEST_SWEEP, _step_sql("pts"))
_area("roc_auc", lambda swept: ranges.trapezoid_area(_points(swept)), TEST_SWEEP, _trapezoid_sql("pts"))
_area("vus_pr", ranges.step_area, RANGE_SWEEP, _step_sql("rf"))
_area("vus_roc", ranges.trapezoid_area, RANGE_SWEEP, _trapezoid_sql("rf"))


VAL_SWEEP = f"{SC}, {_candidates_sql('val')}, {_points_sql('val')}, {_range_sql('val')}"
CHOSEN = "SELECT round(threshold, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM rf"


def _chosen(swept: DataFrame, *order) -> DataFrame:
    best = swept.orderBy(*(F.desc(F.round(c, 9)) for c in order), "cand_ix").limit(1)
    return best.select(*(r6(F.col(c), c) for c in ("threshold", "precision", "recall", "f1")))


@query("threshold_max_f1", f"WITH {VAL_SWEEP} {CHOSEN} ORDER BY round(f1, 9) DESC, round(r, 9) DESC, round(p, 9) DESC, cand_ix LIMIT 1")
def threshold_max_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chosen(_swept(spark, sf_dir, "validation"), "f1", "recall", "precision")


def _target(name: str, recall: float) -> None:
    @query(name, f"WITH {VAL_SWEEP} {CHOSEN} WHERE r >= {recall} ORDER BY round(p, 9) DESC, round(r, 9) DESC, round(f1, 9) DESC, cand_ix LIMIT 1")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        swept = _swept(spark, sf_dir, "validation")
        return _chosen(swept.where(F.col("recall") >= recall), "precision", "recall", "f1")


_target("threshold_target_recall_50", 0.5)
_target("threshold_target_recall_70", 0.7)


def _evaluated(name: str, per_group: bool) -> None:
    threshold = "th AS (SELECT group_id, round(quantile_cont(score, 0.98), 9) AS threshold FROM val GROUP BY 1), p0 AS (SELECT tst.*, CAST(score >= threshold AS INT) AS p FROM tst JOIN th USING (group_id))" if per_group else "p0 AS (SELECT *, CAST(score >= (SELECT round(quantile_cont(score, 0.95), 9) FROM val) AS INT) AS p FROM tst)"
    by = "PARTITION BY group_id " if per_group else ""
    sql = f"""WITH {SC}, {threshold}, pr AS (SELECT group_id, seq, label, CAST(sum(p) OVER ({by}ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS INT) AS pred FROM p0),
{_islands('label', 'pr', 'ti')}, {_islands('pred', 'pr', 'pi')}, {MEASURES} SELECT {ROUNDED}, (SELECT count(delay) FROM ti) AS detected, (SELECT count(*) - count(delay) FROM ti) AS missed FROM m"""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with kept(scored(spark, sf_dir)) as rows:
            validation, test = (rows.where(F.col("split") == s) for s in ("validation", "test"))
            if per_group:
                found = thresholds.group_quantiles(validation, 0.98).withColumn("threshold", F.round("threshold", 9))
                predicted, restart = thresholds.predict_by_group(test, found), "group_id"
            else:
                level = round(quantiles.exact_quantiles(validation, "score", [0.95])[0], 9)
                predicted, restart = thresholds.predict(test, level), None
            measured = ranges.measures(predicted, persistence=(3, 2), restart=restart)
            return ranges.gathered(measured.select(*(r6(F.col(c), c) for c in ("precision", "recall", "f1")), "detected", "missed"))


_evaluated("evaluate_anomaly_global", False)
_evaluated("evaluate_anomaly_per_group", True)


def _strategies_sql() -> str:
    swept = lambda name, where, order: f"SELECT '{name}' AS strategy, threshold FROM (SELECT threshold FROM rf {where} ORDER BY {order}, cand_ix LIMIT 1)"
    found = [swept("max_validation_f1", "", "f1 DESC, r DESC, p DESC")]
    found += [swept(name, f"WHERE r >= {recall}", "p DESC, r DESC, f1 DESC") for name, (recall, _) in thresholds.TARGET_RECALLS.items()]
    found += [f"SELECT '{n}', quantile_cont(score, {q}::DOUBLE) FROM val" for n, q in thresholds.GLOBAL_QUANTILES.items()]
    grouped = " UNION ALL ".join(f"SELECT '{n}' AS strategy, group_id, quantile_cont(score, {q}::DOUBLE) AS threshold FROM val GROUP BY 2" for n, q in thresholds.GROUP_QUANTILES.items())
    predicted = "SELECT strategy, seq, label, CAST(score >= threshold AS INT) AS pred FROM st, val UNION ALL SELECT strategy, seq, label, CAST(score >= threshold AS INT) FROM gt JOIN val USING (group_id)"
    exact = f"{SC}, {_candidates_sql('val').replace('round(th, 9)', 'th')}, {_points_sql('val')}, {_range_sql('val')}"
    return (
        f"WITH {exact}, st AS ({' UNION ALL '.join(found)}), gt AS ({grouped}), pr AS ({predicted}), {_islands('label', 'pr', 'ti', 'strategy')}, {_islands('pred', 'pr', 'pi', 'strategy')}, "
        "m AS (SELECT s.strategy, st.threshold, coalesce((SELECT avg(true_share) FROM pi WHERE pi.strategy = s.strategy), 0) AS p, coalesce((SELECT avg(pred_share) FROM ti WHERE ti.strategy = s.strategy), 0) AS r FROM (SELECT DISTINCT strategy FROM pr) s LEFT JOIN st USING (strategy)) "
        f"SELECT strategy, round(threshold, 6) AS threshold, {ROUNDED} FROM m"
    )


@query("select_threshold_strategies", _strategies_sql())
def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named strategy: its threshold (null for those by group) and range metrics."""
    with kept(scored(spark, sf_dir, "validation")) as rows:
        found = [(s, c.threshold, *(c.metrics[k] for k in selection.MEASURES)) for s, c in selection.select_thresholds(rows).items()]
    made = spark.createDataFrame(found, "strategy string, threshold double, precision double, recall double, f1 double")
    return made.select("strategy", r6(F.col("threshold"), "threshold"), *(r6(F.col(c), c) for c in ("precision", "recall", "f1")))


# Agreement of regimes: the regime of an event against the likeliest of the made posteriors.


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posteriors(spark, sf_dir).select("series_id", "t", "seq", F.col("regime_label").alias("true_label"), regimes.argmax(F.col("probs")).alias("pred_label"))


@query("contingency", f"WITH {PO} SELECT regime_label AS truth, CAST(best AS BIGINT) AS pred, count(*) AS n FROM pe GROUP BY 1, 2")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.contingency(_labels(spark, sf_dir))


@query(
    "adjusted_rand_index",
    f"WITH {PO}, c AS (SELECT series_id, regime_label AS a, best AS b, count(*) AS n FROM pe GROUP BY ALL), i AS (SELECT series_id, sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM c GROUP BY 1), ra AS (SELECT series_id, sum(m * (m - 1) / 2) AS x FROM (SELECT series_id, a, sum(n) AS m FROM c GROUP BY ALL) GROUP BY 1), rb AS (SELECT series_id, sum(m * (m - 1) / 2) AS y FROM (SELECT series_id, b, sum(n) AS m FROM c GROUP BY ALL) GROUP BY 1) "
    "SELECT series_id, round(CASE WHEN (x + y) / 2 - x * y / (n * (n - 1) / 2) = 0 THEN 1 ELSE (i - x * y / (n * (n - 1) / 2)) / ((x + y) / 2 - x * y / (n * (n - 1) / 2)) END, 6) + 0.0 AS ari FROM i JOIN ra USING (series_id) JOIN rb USING (series_id)",
)
def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.adjusted_rand(_labels(spark, sf_dir), by=["series_id"]).select("series_id", (F.round("ari", 6) + 0.0).alias("ari"))


@query("switch_points", f"WITH {PO}, s AS (SELECT *, lag(regime_label) OVER (ORDER BY seq) AS was FROM pe) SELECT seq, regime_label FROM s WHERE regime_label <> was")
def switch_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.switch_points(posteriors(spark, sf_dir), "regime_label").select("seq", "regime_label")


@query("false_switch_rate", f"WITH {PO}, s AS (SELECT *, lag(regime_label) OVER w AS true_was, lag(best) OVER w AS pred_was FROM pe WINDOW w AS (ORDER BY seq)) SELECT round(1000.0::DOUBLE * count(*) FILTER (regime_label = true_was AND best <> pred_was) / count(*) FILTER (regime_label = true_was), 6) AS false_switches_per_1000 FROM s")
def false_switch_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regimes.false_switch_rate(_labels(spark, sf_dir)).select(r6(F.col("false_switches_per_1000"), "false_switches_per_1000"))


@query(
    "align_regimes",
    f"WITH {PO}, c AS (SELECT regime_label AS truth, best AS pred, count(*) AS n FROM pe GROUP BY 1, 2), u AS (SELECT DISTINCT truth FROM c), "
    "a AS (SELECT x.truth AS a, y.truth AS b, z.truth AS d FROM u x, u y, u z WHERE x.truth <> y.truth AND x.truth <> z.truth AND y.truth <> z.truth), "
    "s AS (SELECT a, b, d, coalesce(sum(n), 0) AS hits FROM a LEFT JOIN c ON (pred = 0 AND truth = a) OR (pred = 1 AND truth = b) OR (pred = 2 AND truth = d) GROUP BY 1, 2, 3), m AS (SELECT * FROM s ORDER BY hits DESC LIMIT 1) "
    "SELECT truth, CASE pred WHEN 0 THEN m.a WHEN 1 THEN m.b ELSE m.d END AS pred, CAST(sum(n) AS BIGINT) AS n FROM c, m GROUP BY 1, 2",
)
def align(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labels(spark, sf_dir)
    return regimes.contingency(regimes.aligned(rows, regimes.align(rows)), pred="aligned")


@query(
    "per_series_pipeline",
    f"""WITH {SC}, th AS (SELECT group_id, round(quantile_cont(score, 0.9), 9) AS threshold FROM val GROUP BY 1), p0 AS (SELECT tst.*, CAST(score >= threshold AS INT) AS p FROM tst JOIN th USING (group_id)),
pr AS (SELECT group_id, seq, label, CAST(sum(p) OVER (PARTITION BY group_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS INT) AS pred FROM p0),
{_islands('label', 'pr', 'ti', 'group_id')}, {_islands('pred', 'pr', 'pi', 'group_id')}, a AS (SELECT group_id, max(label) AS t, max(pred) AS q FROM pr GROUP BY 1), tr AS (SELECT group_id, avg(pred_share) AS r FROM ti GROUP BY 1), pp AS (SELECT group_id, avg(true_share) AS p FROM pi GROUP BY 1),
m AS (SELECT group_id, CASE WHEN t + q = 0 THEN 1 ELSE coalesce(p, 0) END AS p, CASE WHEN t + q = 0 THEN 1 ELSE coalesce(r, 0) END AS r FROM a LEFT JOIN tr USING (group_id) LEFT JOIN pp USING (group_id)) SELECT group_id, {ROUNDED} FROM m""",
)
def per_series_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From events to range metrics of each series: lag-1 scores, its own validation quantile, two
    of three persistence, islands."""
    rows = scored(spark, sf_dir, numbered=False)
    found = thresholds.group_quantiles(rows.where("split = 'validation'"), 0.9).select("group_id", F.round("threshold", 9).alias("threshold"))
    predicted = thresholds.predict_by_group(rows.where("split = 'test'"), found)
    return _rounded(ranges.measures(predicted, seq="place", by=["group_id"], persistence=(3, 2)), "group_id")


JOBS = [(q, p) for q in (0.95, 0.98, 0.99) for p in ((1, 1), (3, 2), (5, 2))]


def _job_sql(i: int, q: float, window: int, count: int) -> str:
    names = {"label": f"t{i}", "pred": f"p{i}"}
    rows = f"r{i} AS (SELECT seq, label, CAST(sum(CAST(score >= (SELECT round(quantile_cont(score, {q}::DOUBLE), 9) FROM val) AS INT)) OVER (ORDER BY seq ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW) >= {count} AS INT) AS pred FROM tst)"
    measured = f"m{i} AS (SELECT coalesce((SELECT avg(true_share) FROM p{i}), 0) AS p, coalesce((SELECT avg(pred_share) FROM t{i}), 0) AS r)"
    return ", ".join([rows, *(_islands(flag, f"r{i}", name) for flag, name in names.items()), measured])


@query(
    "rescore_matrix",
    f"WITH {SC}, " + ", ".join(_job_sql(i, q, *p) for i, (q, p) in enumerate(JOBS)) + " " + " UNION ALL ".join(f"SELECT {q}::DOUBLE AS quantile, {w} AS persistence_window, {c} AS persistence_count, {ROUNDED} FROM m{i}" for i, (q, (w, c)) in enumerate(JOBS)),
)
def rescore_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every threshold under every persistence: a filter measures all thresholds in one plan."""
    levels, filters = sorted({q for q, _ in JOBS}), sorted({p for _, p in JOBS})
    with kept(scored(spark, sf_dir)) as rows:
        found = quantiles.exact_quantiles(rows.where("split = 'validation'"), "score", levels)
        each = F.array(*(F.struct(F.lit(q).alias("quantile"), F.lit(round(v, 9)).alias("threshold")) for q, v in zip(levels, found, strict=True)))
        test = rows.where("split = 'test'").select("seq", "score", "label", F.explode(each).alias("x")).select("seq", "label", "x.quantile", (F.col("score") >= F.col("x.threshold")).cast("int").alias("pred"))
        out = [_rounded(ranges.measures(test, by=["quantile"], persistence=p), "quantile").select("quantile", F.lit(p[0]).alias("persistence_window"), F.lit(p[1]).alias("persistence_count"), "precision", "recall", "f1") for p in filters]
        return ranges.gathered(reduce(DataFrame.union, out))
