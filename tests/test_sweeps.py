"""Range measures by chunks, with persistence, and sweeps over thresholds by the component tree."""

import numpy as np
import pytest

from wavemark.operators import component_tree, ranges, thresholds


def brute_runs(flags):
    edges = np.flatnonzero(np.diff(np.array(flags, np.int8), prepend=0, append=0))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def brute_persist(pred, window, count):
    return [int(sum(pred[max(0, i - window + 1) : i + 1]) >= count) for i in range(len(pred))]


def brute_measures(truth, pred):
    true, own = brute_runs(truth), brute_runs(pred)
    p, r = [sum(truth[a:b]) / (b - a) for a, b in own], [sum(pred[a:b]) / (b - a) for a, b in true]
    delays = [d for a, b in true if (d := next((i - a for i in range(a, b) if pred[i]), None)) is not None]
    precision, recall = (1.0, 1.0) if not p and not r else (np.mean(p) if p else 0.0, np.mean(r) if r else 0.0)
    normals = truth.count(0)
    return {
        "precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall) if precision + recall else 0.0,
        "mean_delay": np.mean(delays) if delays else None, "median_delay": np.median(delays) if delays else None, "detected": len(delays), "missed": len(true) - len(delays),
        "false_alarms_per_1000": 1000 * sum(truth[a] == 0 for a, _ in own) / normals if normals else 0.0,
    }


def close(got, want):
    assert got.keys() >= want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9) if v is not None else got[k] is None, (k, got[k], v)


def flags(rng, n):
    out, state = [], int(rng.random() < 0.5)
    for _ in range(n):
        state = 1 - state if rng.random() < rng.choice([0.1, 0.5]) else state
        out.append(state)
    return out


@pytest.mark.parametrize(("seed", "chunk"), [(0, 2), (1, 5), (2, 16), (3, 1 << 16), (4, 4)])
def test_measures_by_chunks(spark, seed, chunk):
    rng = np.random.default_rng(seed)
    groups = {g: (flags(rng, n), flags(rng, n)) for g, n in enumerate([1, 3, 17, 40, 64])}
    groups |= {7: ([0] * 9, [0] * 9), 8: ([1] * 20, [1] * 20), 9: ([1] * 9, [0] * 9), 10: ([0] * 9, [1] * 9)}
    df = spark.createDataFrame([(g, i, t, p) for g, (truth, pred) in groups.items() for i, (t, p) in enumerate(zip(truth, pred, strict=True))], "g int, seq long, label int, pred int").repartition(3)
    for window, count in ((1, 1), (2, 1), (2, 2)) if chunk < 5 else ((1, 1), (3, 2), (5, 2)):
        if window > chunk:
            continue
        found = {r["g"]: r.asDict() for r in ranges.measures(df, by=["g"], persistence=(window, count), chunk=chunk).collect()}
        assert set(found) == set(groups)
        for g, (truth, pred) in groups.items():
            close(found[g], brute_measures(truth, brute_persist(pred, window, count)))
    with pytest.raises(ValueError, match="chunk"):
        ranges.measures(df, persistence=(chunk + 1, 1), chunk=chunk)


def test_persistence_starts_anew(spark):
    """Filtered within groups, measured over the whole sequence."""
    rng = np.random.default_rng(5)
    sizes, truth, pred = [3, 1, 30, 2, 25], flags(rng, 61), flags(rng, 61)
    group = np.repeat(np.arange(len(sizes)), sizes).tolist()
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(zip(truth, pred, group, strict=True))], "seq long, label int, pred int, group_id int")
    ends = np.cumsum([0, *sizes])
    kept = [v for a, b in zip(ends[:-1], ends[1:], strict=True) for v in brute_persist(pred[a:b], 4, 2)]
    for chunk in (8, 1 << 16):
        close(ranges.measures(df, persistence=(4, 2), restart="group_id", chunk=chunk).first().asDict(), brute_measures(truth, kept))
    close(ranges.measures(df.limit(0)).first().asDict(), {"precision": 1.0, "recall": 1.0, "f1": 1.0, "mean_delay": None, "detected": 0, "missed": 0, "false_alarms_per_1000": 0.0})


def test_measures_exchange_rows_once(spark):
    """After the score: rows by chunk, edges by side, sums."""
    df = spark.range(100).selectExpr("id AS seq", "cast(id % 7 = 0 AS int) AS label", "cast(id % 5 = 0 AS int) AS pred")
    plan = ranges.measures(df, persistence=(3, 2))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 3 and plan.count("Range (") == 1


@pytest.mark.parametrize("seed", range(3))
def test_component_tree_in_any_grouping(seed):
    """Numbers and shares of runs at every level, of stretches put together in random order."""
    rng = np.random.default_rng(seed)
    for _ in range(300):
        n = int(rng.integers(1, 25))
        levels = rng.integers(0, rng.choice([1, 3, 30]) + 1, n).astype(float)
        levels[rng.random(n) < 0.1] = component_tree.NEVER
        truth = flags(rng, n)
        cuts = sorted({0, n, *rng.integers(0, n + 1, int(rng.integers(0, 6))).tolist()})
        steps = component_tree._steps()
        parts = [component_tree.stretch(levels[a:b].tolist(), truth[a:b], steps) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        while len(parts) > 1:
            i = int(rng.integers(0, len(parts) - 1))
            parts[i : i + 2] = [component_tree.joined(parts[i], parts[i + 1], steps)]
        component_tree.ended(parts[0], steps)
        total = np.zeros(len(component_tree.SUMS))
        sums = {level: (total := total + steps[level]) for level in sorted(steps)}
        for level in sorted({*levels.tolist()} - {component_tree.NEVER}):
            pred = (levels <= level).astype(int).tolist()
            own, true = brute_runs(pred), brute_runs(truth)
            want = [len(own), sum(sum(truth[a:b]) / (b - a) for a, b in own), sum(sum(pred[a:b]) / (b - a) for a, b in true), sum(p & t for p, t in zip(pred, truth, strict=True)), sum(p & (1 - t) for p, t in zip(pred, truth, strict=True)), len(true), sum(truth), n - sum(truth)]
            assert np.allclose(sums[level], want)


@pytest.mark.parametrize("chunk", [1, 6, 1 << 16])
def test_sweeps(spark, chunk):
    rng = np.random.default_rng(8)
    n, label = 90, flags(rng, 90)
    score = np.round(rng.normal(size=n) + np.array(label), 1).tolist()
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(zip(score, label, strict=True))], "seq long, score double, label int").repartition(4)
    found = {r["threshold"]: r.asDict() for r in ranges.sweep_all_scores(df, chunk=chunk).collect()}
    assert sorted(found) == sorted(set(score))
    cut = sorted({*score[:20], 99.0}, reverse=True)
    some = {r["threshold"]: r.asDict() for r in ranges.sweep(df, cut, chunk=chunk).collect()}
    assert sorted(some, reverse=True) == cut
    for swept in (found, some):
        for c, r in swept.items():
            pred = [int(s >= c) for s in score]
            want = brute_measures(label, pred)
            tp, fp = sum(p & t for p, t in zip(pred, label, strict=True)), sum(p & (1 - t) for p, t in zip(pred, label, strict=True))
            close(r, {k: want[k] for k in ("precision", "recall", "f1")} | {"tp": tp, "fp": fp, "tn": n - sum(label) - fp, "fn": sum(label) - tp, "fpr": fp / (n - sum(label))})
    areas = ranges.threshold_free(df, thresholds.candidates(df)).first().asDict()
    assert all(0 <= v <= 1 for v in areas.values())


def test_sweeps_of_odd_tables(spark):
    schema = "seq long, score double, label int"
    assert ranges.sweep_all_scores(spark.createDataFrame([], schema)).collect() == []
    rising = spark.createDataFrame([(i, float(i), 0) for i in range(50)], schema)
    rows = ranges.sweep_all_scores(rising, chunk=4).collect()
    assert len(rows) == 50 and all(r["precision"] == 0.0 and r["recall"] == 0.0 and r["tn"] == r["threshold"] for r in rows)
    gone = spark.createDataFrame([(0, 1.0, 1), (1, None, 1), (2, 1.0, 0)], schema)
    (row,) = ranges.sweep_all_scores(gone).collect()
    assert (row["precision"], row["recall"], row["tp"], row["fn"]) == (0.5, 0.5, 1, 1)
    with pytest.raises(Exception, match="label must be 0 or 1"):
        ranges.sweep(spark.createDataFrame([(0, 1.0, 2)], schema), [1.0]).collect()
