"""Golden values on tiny tables, and properties against plain NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemark.functions import gaussian, intervals, mixture, scores
from wavemark.operators import baselines, clustering, diagnostics, failures, quantiles, ranges, regimes, scaling, selection, sequence, thresholds, windows


def seq(spark, **columns):
    names = list(columns)
    return spark.createDataFrame([(i, *v) for i, v in enumerate(zip(*columns.values(), strict=True))], ["seq", *names])


def series(spark, n=10):
    regime = [0, 0, 1, 1, 1, 2, 2, 2, 0, 0]
    anomaly = [0, 0, 0, 1, 0, 0, 1, 0, 0, 0]
    rows = [("cfg", t, [2.0 * t, 2.0 * t + 1], regime[t], anomaly[t]) for t in range(n)]
    return spark.createDataFrame(rows, "series_id string, t long, x array<double>, regime_label long, anomaly_label int")


def one(df):
    return df.first().asDict()


def test_scaler(spark):
    df = spark.createDataFrame([("a", t, [v]) for t, v in enumerate([0.0, 2.0, 4.0])], "series_id string, t long, x array<double>")
    fit = scaling.fit_scaler(df)
    assert one(fit)["mean"] == [2.0] and one(fit)["std"][0] == pytest.approx(math.sqrt(8 / 3))
    back = scaling.unscale(scaling.scale(df, fit), fit)
    assert [r["x"][0] for r in back.orderBy("t").collect()] == pytest.approx([0, 2, 4])
    for fraction in (0.0, 1.0):
        with pytest.raises(ValueError, match="fraction"):
            scaling.split_tail(series(spark), fraction)
    with pytest.raises(Exception, match="no training"):
        scaling.split_tail(series(spark, 1), 0.5).collect()
    cut = scaling.split_tail(series(spark), 0.25)
    assert cut.where("split = 'validation'").count() == 2  # 2.5 rounds half to even


def test_windows(spark):
    made = windows.make_windows(series(spark), 3, 2, 2).orderBy("start").collect()
    assert len(made) == 3 and (made[0]["regime_label"], made[0]["anomaly_label"]) == (1, 1)
    assert made[1]["window"] == [[4.0, 5.0], [6.0, 7.0], [8.0, 9.0]] and made[1]["target"] == [[10.0, 11.0], [12.0, 13.0]]
    labels = [r["anomaly_label"] for r in windows.make_windows(series(spark), 4, 2).orderBy("start").collect()]
    assert labels[:3] == [0, 1, 1]
    with pytest.raises(ValueError):
        windows.make_windows(series(spark), 9, 2, strict=True)
    both = windows.concat([windows.make_windows(series(spark), 3, 2, 2)] * 2)
    assert [(r["group_id"], r["seq"]) for r in both.orderBy("seq").collect()] == [(0, 0), (0, 1), (0, 2), (1, 3), (1, 4), (1, 5)]


def test_windows_in_chunks(spark, monkeypatch):
    whole = windows.make_windows(series(spark), 3, 2).orderBy("start").collect()
    monkeypatch.setattr(sequence, "CHUNK", 5)
    monkeypatch.setattr(windows, "trailing", lambda *a: sequence.trailing(*a, chunk=5))
    assert windows.make_windows(series(spark), 3, 2).orderBy("start").collect() == whole


@pytest.mark.parametrize(
    ("event", "changed"),
    [
        (failures.FailureEvent("stuck_at", 3, 6, (0,)), {3: 4.0, 4: 4.0, 5: 4.0}),
        (failures.FailureEvent("additive_drift", 1, 4, (0,), magnitude=3.0), {1: 2.0, 2: 5.5, 3: 9.0}),
        (failures.FailureEvent("spike_train", 1, 8, (0,), magnitude=10.0, period=3), {1: 12.0, 4: 18.0, 7: 24.0}),
        (failures.FailureEvent("phase_shift", 3, 6, (0,), lag=2), {3: 2.0, 4: 4.0, 5: 6.0}),
        (failures.FailureEvent("dropout", 2, 4, (0,), value=-1.0), {2: -1.0, 3: -1.0}),
    ],
)
def test_failures(spark, event, changed):
    rows = failures.inject(series(spark), [event]).orderBy("t").collect()
    for t, r in enumerate(rows):
        assert r["x"] == [changed.get(t, 2.0 * t), 2.0 * t + 1]
        assert r["anomaly_label"] == (1 if event.start <= t < event.end else [0, 0, 0, 1, 0, 0, 1, 0, 0, 0][t])


def test_failures_compound(spark):
    plain = series(spark).withColumn("anomaly_label", F.lit(0))
    rows = failures.inject(plain, [failures.FailureEvent("dropout", 1, 4), failures.FailureEvent("stuck_at", 3, 6)]).orderBy("t").collect()
    assert [r["anomaly_label"] for r in rows] == [0, 1, 1, 1, 1, 1, 0, 0, 0, 0]
    noisy = failures.inject(plain, [failures.FailureEvent("multiplicative_noise", 2, 8, magnitude=0.1)], seed=1)
    assert noisy.orderBy("t").collect() == failures.inject(plain.repartition(3), [failures.FailureEvent("multiplicative_noise", 2, 8, magnitude=0.1)], seed=1).orderBy("t").collect()
    with pytest.raises(ValueError):
        failures.inject(plain, [failures.FailureEvent("melt", 0, 1)])
    for event in (failures.FailureEvent("dropout", 5, 11), failures.FailureEvent("dropout", 1, 2, (2,)), failures.FailureEvent("dropout", 1, 2, (-1,))):
        with pytest.raises(ValueError):
            failures.inject(plain, [event], strict=True)
    changed = noisy.where("t >= 2 and t < 8").join(plain.select("t", F.col("x").alias("was")), "t")
    assert noisy.count() == 10 and noisy.where("t < 2 or t >= 8").select("t", "x").exceptAll(plain.select("t", "x")).isEmpty()
    assert all(a != b for r in changed.collect() for a, b in zip(r["x"], r["was"], strict=True))
    assert failures.default_events(400) == [failures.FailureEvent("additive_drift", 140, 160, (0,), magnitude=3.0), failures.FailureEvent("spike_train", 280, 296, (0,), magnitude=5.0)]
    assert failures.default_events(400, False) == [failures.FailureEvent("spike_train", 240, 260, (0,), magnitude=4.0)]


def test_seasonal(spark):
    df = spark.createDataFrame([(0, [[float(v)] for v in range(1, 7)])], "seq long, window array<array<double>>")
    got = baselines.forecast_seasonal(df, 3, 5, F.array(F.lit(1.0))).orderBy("h").collect()
    assert [r["means"][0][0] for r in got] == [4, 5, 6, 4, 5]
    assert one(baselines.forecast_persistence(df, 1))["means"] == [[6.0]]
    short = spark.createDataFrame([("a", 0, [1.0])], "series_id string, t long, x array<double>")
    assert one(baselines.fit_seasonal(short, 3))["std"] == [1.0]


def forecast(spark, y, w, m, s):
    return spark.createDataFrame([(0, y, w, m, s)], "seq long, observed array<double>, weights array<double>, means array<array<double>>, stds array<array<double>>")


def test_forecasts_are_checked(spark):
    from wavemark.plans import reports

    good = ([0.0], [1.0], [[0.0]], [[1.0]])
    for bad in (([0.0], [-1.0], [[0.0]], [[1.0]]), ([0.0], [0.0], [[0.0]], [[1.0]]), ([0.0], [1.0], [[0.0]], [[0.0]]), ([0.0, 1.0], [1.0], [[0.0]], [[1.0]]), ([float("inf")], [1.0], [[0.0]], [[1.0]]), (None, [1.0], [[0.0]], [[1.0]])):
        with pytest.raises(Exception, match="forecast needs"):
            reports.checked_forecast(forecast(spark, *bad)).collect()
    assert reports.checked_forecast(forecast(spark, *good)).count() == 1


def test_mixture_scores(spark):
    columns = [F.col(c) for c in ("observed", "weights", "means", "stds")]
    unit = forecast(spark, [0.0], [1.0], [[0.0]], [[1.0]])
    got = one(unit.select(mixture.nll(*columns).alias("nll"), mixture.channel_crps(*columns)[0].alias("crps"), mixture.pit(*columns)[0].alias("pit"), mixture.valid(*columns).alias("valid")))
    assert got == {"nll": pytest.approx(0.5 * math.log(2 * math.pi)), "crps": pytest.approx((math.sqrt(2) - 1) / math.sqrt(math.pi)), "pit": pytest.approx(0.5), "valid": True}
    two = forecast(spark, [1.0], [0.25, 0.75], [[0.0], [4.0]], [[1.0], [1.0]])
    assert one(two.select(mixture.predictive_mean(F.col("weights"), F.col("means"))[0].alias("m"), mixture.absolute_errors(*columns[:3])[0].alias("e"))) == {"m": 3.0, "e": 2.0}
    zero = forecast(spark, [0.5], [0.0, 2.0], [[9.0], [0.0]], [[1.0], [1.0]])
    assert one(zero.select(mixture.nll(*columns).alias("v")))["v"] == pytest.approx(0.5 * math.log(2 * math.pi) + 0.125)
    inside = forecast(spark, [0.0, 10.0], [1.0], [[0.0, 0.0]], [[1.0, 1.0]])
    assert one(inside.select(intervals.channel_coverage("observed", "weights", "means", "stds").alias("c")))["c"] == [1, 0]


def test_normal_cdf(spark):
    z = [-40.0, -8.0, -7.0, -1.5, 0.0, 0.3, 6.9, 7.2, 38.0]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(z)], "i int, z double").orderBy("i").select(gaussian.cdf(F.col("z"))).collect()]
    want = [0.5 * math.erfc(-v / math.sqrt(2)) for v in z]
    assert got == pytest.approx(want, abs=1e-14) and intervals.normal_cdf(np.array(z)) == pytest.approx(want, abs=1e-14)


def test_scores(spark):
    probs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.25, 0.75])], "seq long, probs array<double>")
    got = [r["score"] for r in scores.regime_scores(probs, "regime_switch").orderBy("seq").collect()]
    assert got == pytest.approx([0, 0, 1, 0.25])
    assert [r["score"] for r in scores.regime_scores(probs, "regime_confidence_gap").orderBy("seq").collect()] == pytest.approx([0, 0, 0, 0.25])
    with pytest.raises(ValueError, match="mean_nll"):
        scores.forecast_scores(probs, "nonsense")


def test_ranges(spark):
    df = seq(spark, label=[0, 1, 1, 0, 1, 1, 1], pred=[0] * 7)
    assert sorted((r["start"], r["end"]) for r in ranges.ranges(df, "label").collect()) == [(1, 3), (4, 7)]
    df = seq(spark, label=[0, 1, 1, 1, 1, 0], pred=[0, 0, 1, 1, 0, 0])
    assert one(ranges.range_metrics(df)) == {"precision": 1.0, "recall": 0.5, "f1": pytest.approx(2 / 3)}
    assert one(ranges.range_metrics(seq(spark, label=[0, 0], pred=[0, 0])))["f1"] == 1.0
    assert one(ranges.range_metrics(seq(spark, label=[0, 1], pred=[0, 0])))["f1"] == 0.0
    df = seq(spark, label=[0, 1, 1, 1, 0, 1, 1], pred=[0, 0, 0, 1, 0, 0, 0])
    assert one(ranges.detection_delay(df)) == {"mean_delay": 2.0, "median_delay": 2.0, "detected": 1, "missed": 1}
    df = seq(spark, label=[0, 0, 1, 1, 0, 0], pred=[1, 1, 0, 0, 1, 0])
    assert one(ranges.false_alarm_rate(df))["false_alarms_per_1000"] == 500
    c = one(ranges.confusion(seq(spark, label=[1, 0, 1, 0], pred=[1, 1, 0, 0])))
    assert [c[k] for k in ("tp", "fp", "tn", "fn")] == [1, 1, 1, 1]


def test_persistence(spark):
    got = thresholds.persist(seq(spark, pred=[0, 1, 0, 1, 1, 0, 1]), 3, 2).orderBy("seq").collect()
    assert [r["pred"] for r in got] == [0, 0, 0, 1, 1, 1, 1]
    grouped = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 1, 1)], "g int, t long, pred int")
    assert [r["pred"] for r in thresholds.persist(grouped, 2, 2, "t", ["g"]).orderBy("g", "t").collect()] == [0, 0, 0, 1]
    with pytest.raises(ValueError):
        thresholds.check_persistence(2, 3)


@pytest.mark.parametrize("seed", range(3))
def test_measures_against_brute_force(spark, seed, monkeypatch):
    """All measures of two groups, with islands over the bounds of chunks."""
    rng = np.random.default_rng(seed)
    flags = {g: ((rng.random(60) < 0.5).astype(int).tolist(), (rng.random(60) < 0.5).astype(int).tolist()) for g in (0, 1)} | {2: ([0] * 9, [0] * 9), 3: ([1] * 20, [0] * 20)}
    rows = [(g, i, t, p) for g, (truth, pred) in flags.items() for i, (t, p) in enumerate(zip(truth, pred, strict=True))]
    for r in ranges.measures(spark.createDataFrame(rows, "g int, seq long, label int, pred int"), by=["g"]).collect():
        truth, pred = flags[r["g"]]
        true, own = brute_ranges(truth), brute_ranges(pred)
        delays = [next((i - s for i in range(s, e) if pred[i]), None) for s, e in true]
        hit = [d for d in delays if d is not None]
        normal = truth.count(0)
        assert (r["recall"], r["precision"]) == (pytest.approx(overlap(true, own)), pytest.approx(overlap(own, true)))
        assert (r["detected"], r["missed"]) == (len(hit), len(delays) - len(hit)) and r["mean_delay"] == (pytest.approx(np.mean(hit)) if hit else None) and r["median_delay"] == (pytest.approx(np.median(hit)) if hit else None)
        assert r["false_alarms_per_1000"] == pytest.approx(1000 * sum(truth[s] == 0 for s, _ in own) / normal if normal else 0.0)
    with pytest.raises(Exception, match="0 or 1"):
        ranges.measures(seq(spark, label=[0, 2], pred=[0, 1])).collect()


def test_group_quantiles_by_brackets(spark):
    """Exact in every group, also in one of many rows, of few values, or of one."""
    rng = np.random.default_rng(6)
    groups = {"normal": rng.normal(size=3000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.5]), "two": np.array([1.0, 2.0]), "same": np.full(50, 7.0), "few": rng.normal(size=13)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("none", None), ("ties", None)]
    df = spark.createDataFrame(rows, "group_id string, score double").repartition(5)
    for level, accuracy in ((0.5, 10_000), (0.98, 50), (0.985, 100), (0.0, 20), (1.0, 20), (0.37, 10)):
        found = {r["group_id"]: r["threshold"] for r in thresholds.group_quantiles(df, level, accuracy=accuracy).collect()}
        assert set(found) == {*groups, "none"} and found["none"] is None
        for g, values in groups.items():
            assert found[g] == pytest.approx(np.quantile(values, level), rel=1e-12), (g, level)


def test_numbers_in_pieces(spark):
    rows = [(g, t) for g in (2, 0, 5) for t in range(0, 50, 3)]
    df = spark.createDataFrame(rows, "g int, t long").repartition(3)
    whole = sequence.numbered(df, ["g"], ["t"]).orderBy("g", "t").collect()
    assert [r["seq"] for r in whole] == list(range(len(rows)))
    assert sequence.numbered(df, ["g"], ["t"], chunk=10).orderBy("g", "t").collect() == whole


def scored(spark, score, label, group=None):
    return seq(spark, score=list(map(float, score)), label=label, group_id=group or [0] * len(score))


def test_thresholds(spark):
    assert thresholds.candidates(scored(spark, [0.2, 0.8, 0.2], [0] * 3)) == [math.nextafter(0.8, math.inf), 0.8, 0.2]
    assert len(thresholds.candidates(scored(spark, range(300), [0] * 300))) == 64
    df = scored(spark, range(4), [0] * 4)
    for name, want in (("validation_quantile_95", 2.85), ("validation_quantile_985", 2.955), ("validation_quantile_997", 2.991)):
        assert selection.select_threshold(df, name).threshold == pytest.approx(want)
    best = selection.select_threshold(scored(spark, [0.1, 0.8, 0.7, 0.2, 0.3], [0, 1, 1, 0, 0]), "max_validation_f1")
    assert (best.threshold, best.metrics["f1"]) == (0.7, 1.0)
    hit = selection.by_target_recall(scored(spark, [0.1, 0.9, 0.8, 0.2], [0, 1, 1, 0]), 0.5)
    assert hit.threshold == 0.8 and hit.metrics["precision"] == hit.metrics["recall"] == 1.0
    assert selection.by_target_recall(df, 0.5, 0.5).threshold == 1.5
    assert selection.select_threshold(scored(spark, [0.1, 0.9, 0.8, 0.2], [0, 1, 1, 0]), "target_recall_50").threshold == 0.8
    assert selection.select_threshold(df, "target_recall_50").threshold == pytest.approx(2.85) and selection.select_threshold(df, "target_recall_70").threshold == pytest.approx(2.7)
    groups = selection.by_group_quantile(scored(spark, [0, 1, 10, 20], [0] * 4, [0, 0, 1, 1]), 0.5)
    assert {r["group_id"]: r["threshold"] for r in groups.by_group.collect()} == {0: 0.5, 1: 15.0}
    with pytest.raises(Exception, match="no threshold"):
        thresholds.predict_by_group(scored(spark, [1], [0], [7]), groups.by_group).collect()


def test_exact_quantiles(spark):
    x = np.random.default_rng(0).normal(size=5000).round(2)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    levels = [0.0, 0.01, 0.5, 0.985, 0.997, 1.0]
    assert quantiles.exact_quantiles(df, "v", levels) == pytest.approx(np.quantile(x, levels).tolist(), abs=1e-12)
    assert quantiles.exact_quantiles(df, "v", levels, distinct=True) == pytest.approx(np.quantile(np.unique(x), levels).tolist(), abs=1e-12)


def test_areas(spark):
    def areas(score, label):
        df = scored(spark, score, label)
        return one(ranges.threshold_free(df, thresholds.candidates(df)))

    assert set(areas([0.9, 0.8, 0.2, 0.1], [1, 1, 0, 0]).values()) == {1.0}
    assert set(areas([0.5] * 4, [1, 0, 1, 0]).values()) == {0.5}
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.0, 0.0), (2, 0.5, 0.5)], "cand_ix int, fpr double, recall double")
    assert one(ranges.trapezoid_area(points))["area"] == 0.5


def brute_ranges(flags):
    out, start = [], None
    for i, f in enumerate([*flags, 0]):
        if f and start is None:
            start = i
        if not f and start is not None:
            out.append((start, i))
            start = None
    return out


def overlap(subject, reference):
    if not subject:
        return 0.0 if reference else 1.0
    return float(np.mean([sum(max(0, min(e, f) - max(s, r)) for r, f in reference) / (e - s) for s, e in subject]))


@pytest.mark.parametrize("seed", range(3))
def test_sweep_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    score, label = rng.integers(0, 12, 80) / 4, (rng.random(80) < 0.4).astype(int).tolist()
    df = scored(spark, score, label)
    cut = thresholds.candidates(df)
    for r in [*ranges.sweep_ranges(df, cut).collect(), *ranges.sweep_ranges(df, cut, chunk=9).collect(), *ranges.sweep_ranges(df.repartition(5), cut, chunk=1).collect()]:
        pred = (score >= cut[r["cand_ix"]]).astype(int)
        true, own = brute_ranges(label), brute_ranges(pred)
        assert (r["recall"], r["precision"]) == (pytest.approx(overlap(true, own)), pytest.approx(overlap(own, true)))
    one_by_one = {r["cand_ix"]: r for r in ranges.sweep_points(df, cut).collect()}
    assert all(one_by_one[i]["tp"] == int(((score >= c) & (np.array(label) == 1)).sum()) for i, c in enumerate(cut))


def test_regimes(spark):
    df = seq(spark, true_label=[0, 0, 1, 1, 2, 2], pred_label=[2, 2, 0, 0, 1, 1])
    assert one(regimes.adjusted_rand(df))["ari"] == 1.0 and regimes.align(df) == {2: 0, 0: 1, 1: 2}
    labels = seq(spark, label=[0, 0, 1, 1, 2, 2, 2, 1])
    assert sorted(r["seq"] for r in regimes.switch_points(labels, "label").collect()) == [2, 4, 7]
    df = seq(spark, true_label=[0, 0, 0, 1, 1, 1], pred_label=[0, 1, 1, 1, 2, 2])
    assert one(regimes.false_switch_rate(df))["false_switches_per_1000"] == 500
    assert regimes.assign([[4, 1, 3], [2, 0, 5], [3, 2, 2]]) == [(0, 1), (1, 0), (2, 2)]
    for bad in (None, 0.5):
        with pytest.raises(Exception, match="whole numbers"):
            regimes.contingency(spark.createDataFrame([(1.0, 1), (bad, 1)], "true_label double, pred_label int")).collect()
    with pytest.raises(Exception, match="0 or 1"):
        ranges.sweep_points(spark.createDataFrame([(1.0, 2)], "score double, label int"), [0.5]).collect()


def test_diagnostics(spark):
    df = spark.createDataFrame([([1.0, 0.0], [[0.0, 0.0], [3.0, 4.0]], [[1.0, 1.0], [2.0, 2.0]]), ([0.5, 0.5], [[0.0, 0.0], [3.0, 4.0]], [[1.0, 1.0], [2.0, 2.0]])], "weights array<double>, means array<array<double>>, stds array<array<double>>")
    assert sorted(r["mean_weight"] for r in diagnostics.component_weights(df).collect()) == [0.25, 0.75]
    d = one(diagnostics.mixture_diagnostics(df))
    assert d["mean_pairwise_distance"] == 5 and d["active_components"] == 2 and d["std"]["median"] == 1.5
    assert d["component_mean_weights"] == [0.75, 0.25] and (d["min_entropy"], d["max_entropy"]) == (pytest.approx(0.0), pytest.approx(math.log(2)))
    with pytest.raises(ValueError):
        diagnostics.mixture_diagnostics(df, active=1.5)


def test_energy_and_coverage_of_stacked_rows(spark):
    """Rows of several shapes together; draws do not depend on how rows are dealt."""
    from wavemark.functions.energy import energy_score

    rows = [(i, [0.3 * i] * d, [1.0 + k for k in range(m)], [[float(k)] * d for k in range(m)], [[0.5 + 0.1 * k] * d for k in range(m)]) for i, (m, d) in enumerate([(1, 1), (3, 2), (2, 2), (3, 2), (1, 3)] * 4)]
    df = spark.createDataFrame(rows, "seq long, observed array<double>, weights array<double>, means array<array<double>>, stds array<array<double>>")
    score = energy_score("observed", "weights", "means", "stds", "seq", 2000).alias("e")
    one_way, other = ([r["e"] for r in d.select("seq", score).orderBy("seq").collect()] for d in (df.coalesce(1), df.repartition(5)))
    assert one_way == other
    draws = np.random.default_rng(0)
    for (_, y, w, m, s), got in zip(rows, one_way, strict=True):
        part = draws.choice(len(w), size=(2, 4000), p=np.array(w) / sum(w))
        x = draws.normal(np.array(m)[part], np.array(s)[part])
        want = np.linalg.norm(x[0] - np.array(y), axis=1).mean() - np.linalg.norm(x[0] - x[1], axis=1).mean() / 2
        assert got == pytest.approx(want, abs=0.15)
    inside = df.select("seq", intervals.channel_coverage("observed", "weights", "means", "stds").alias("c")).orderBy("seq").collect()
    for (_, y, w, m, s), r in zip(rows, inside, strict=True):
        below = sum(a / sum(w) * 0.5 * math.erfc(-(y[0] - k[0]) / v[0] / math.sqrt(2)) for a, k, v in zip(w, m, s, strict=True))
        assert len(r["c"]) == len(y) and (abs(below - 0.05) < 0.005 or abs(below - 0.95) < 0.005 or set(r["c"]) == {int(0.05 <= below <= 0.95)})


def test_posteriors_are_probabilities(spark):
    for bad in ([0.5, 0.6], [], [-0.5, 1.5], [float("nan"), 1.0], None):
        df = spark.createDataFrame([(0, [1.0, 0.0]), (1, bad)], "seq long, probs array<double>")
        with pytest.raises(Exception, match="probabilities"):
            scores.regime_scores(df, "regime_entropy").collect()


def test_pseudo_regimes(spark):
    rows = [(i, [[float(v)], [float(v)]]) for i, v in enumerate([0, 0.1, 0.2, 10, 10.1, 10.2])]
    df = spark.createDataFrame(rows, "seq long, window array<array<double>>")
    assert one(spark.createDataFrame([([[0.0], [2.0]],)], "window array<array<double>>").select(clustering.window_features().alias("f")))["f"] == [1, 1, 2, 2]
    labels = [r["regime_label"] for r in clustering.fit_pseudo_regimes(df, 2, seed=1).predict(df).orderBy("seq").collect()]
    assert len(set(labels[:3])) == len(set(labels[3:])) == 1 and labels[0] != labels[5]


def test_kmeans_against_brute_force(spark):
    """Farthest-first centroids and Lloyd's steps, row by row."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1.0, (12, 3, 2)) for c in (0, 4, 9)])
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(x)], "seq long, window array<array<double>>").repartition(3)
    f = np.concatenate([x.mean(axis=1), x.std(axis=1), x[:, -1], x[:, -1] - x[:, 0]], axis=1)
    f = (f - f.mean(axis=0)) / np.maximum(f.std(axis=0), 1e-6)
    chosen = [int(np.random.default_rng(11).integers(len(f)))]
    while len(chosen) < 3:
        away = ((f[:, None] - f[chosen][None]) ** 2).sum(axis=2).min(axis=1)
        away[chosen] = -1
        chosen.append(int(away.argmax()))
    centroids, before = f[chosen], None
    for _ in range(50):
        label = ((f[:, None] - centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
        if before is not None and (label == before).all():
            break
        before, centroids = label, np.array([f[label == k].mean(axis=0) if (label == k).any() else centroids[k] for k in range(3)])
    model = clustering.fit_pseudo_regimes(df, 3, seed=11)
    assert np.allclose(model.centroids, centroids)
    assert [r["regime_label"] for r in model.predict(df).orderBy("seq").collect()] == label.tolist()


def test_noise_against_brute_force(spark):
    from wavemark.functions import draws

    df = spark.createDataFrame([(s, t, [t * 1.5, float(t % 3)], 0) for s in ("a", "b") for t in range(12)], "series_id string, t long, x array<double>, anomaly_label int")
    rows = failures.inject(df, [failures.FailureEvent("multiplicative_noise", 3, 9, (0,), magnitude=0.5)], seed=5).withColumn("k", F.xxhash64("series_id", "t")).collect()
    spread = np.std([t * 1.5 for t in range(3, 9)])
    for r in rows:
        z = draws.normals(np.array([r["k"]]), 5, 2)[0]
        acts = 3 <= r["t"] < 9
        assert r["x"] == pytest.approx([r["t"] * 1.5 + (0.5 * spread * z[0] if acts else 0.0), r["t"] % 3]) and r["anomaly_label"] == int(acts)
    many = draws.normals(np.arange(20000), 1, 3)
    assert abs(many.mean()) < 0.02 and abs(many.std() - 1) < 0.02 and abs(np.corrcoef(many.T) - np.eye(3)).max() < 0.03
    assert (draws.normals(np.arange(5), 1, 2) == draws.normals(np.arange(5), 1, 7)[:, :2]).all()


@pytest.mark.parametrize("seed", range(4))
def test_chains_of_failures_against_brute_force(spark, seed):
    """Events that repeat what earlier events left, also where these overlap."""
    rng, length = np.random.default_rng(seed), 24
    modes = rng.choice(["stuck_at", "phase_shift", "additive_drift", "spike_train", "dropout"], 5)
    events = []
    for mode in [*modes, "stuck_at", "phase_shift"]:
        start = int(rng.integers(0, 18))
        events.append(failures.FailureEvent(str(mode), start, start + int(rng.integers(1, 7)), (0,) if rng.random() < 0.5 else None, float(rng.integers(1, 4)), 7.0, int(rng.integers(1, 4)), int(rng.integers(1, 5))))
    want = {s: np.array([[100.0 * s + t, -t] for t in range(length)], float) for s in (1, 2)}
    for e in events:
        for x in want.values():
            was = x.copy()
            for t in range(e.start, e.end):
                for d in e.channels or (0, 1):
                    steps = e.end - e.start - 1
                    x[t, d] = {
                        "stuck_at": was[e.start - 1, d] if e.start else e.value, "phase_shift": was[max(t - e.lag, 0), d], "dropout": e.value,
                        "additive_drift": was[t, d] + (e.magnitude * (t - e.start) / steps if steps else 0), "spike_train": was[t, d] + (e.magnitude if (t - e.start) % e.period == 0 else 0),
                    }[e.mode]
    df = spark.createDataFrame([(s, t, [100.0 * s + t, -float(t)], 0) for s in (1, 2) for t in range(length)], "series_id int, t long, x array<double>, anomaly_label int")
    got = failures.inject(df.repartition(3), events)
    assert got.columns == df.columns
    for r in got.collect():
        assert r["x"] == pytest.approx(want[r["series_id"]][r["t"]].tolist())
