"""Sources, models, reports, suites and streams, end to end on small data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wavemark import cli
from wavemark.plans import neural, pipelines, reports, suite
from wavemark.sources import machines, runs, synthetic
from wavemark.streaming import alerts


@pytest.fixture
def tree(tmp_path):
    for part, n in (("train", 16), ("test", 10), ("test_label", 10)):
        (tmp_path / part).mkdir()
        for name in ("machine-1-1", "machine-1-2"):
            lines = [f"{int(i == 2)}" if part == "test_label" else f"{i},{i + 1}" for i in range(n)]
            (tmp_path / part / f"{name}.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "train" / "only.txt").write_text("1,2\n")
    return str(tmp_path)


def test_machines(spark, tree):
    assert [r[0] for r in machines.machine_ids(spark, tree).collect()] == ["machine-1-1", "machine-1-2"]
    rows = machines.load_machines(spark, tree, ["machine-1-2", "machine-1-1"])
    assert rows.where("split = 'train'").count() == 32 and rows.where("anomaly_label = 1").count() == 2
    assert rows.where("machine_id = 'machine-1-2'").select("group_id").distinct().collect() == [(0,)]
    made = machines.windowed_machines(machines.prepare_machines(rows, 0.25), 3, 1)
    assert {r["split"]: r["count"] for r in made.groupBy("split").count().collect()} == {"train": 18, "validation": 2, "test": 14}
    with pytest.raises(Exception, match="(?i)path"):
        machines.machine_ids(spark, tree + "/none").collect()


@pytest.mark.parametrize(("part", "text", "says"), [("test_label", "0\n0.7\n", "0 or 1"), ("test_label", "0\n2\n", "0 or 1"), ("train", "\n", "empty file"), ("train", "1,nan\n2,3\n", "finite")])
def test_machines_with_faults(spark, tree, part, text, says):
    from pathlib import Path

    (Path(tree) / part / "machine-1-1.txt").write_text(text)
    with pytest.raises(Exception, match=says):
        machines.load_machines(spark, tree).collect()


def test_long_files_in_byte_ranges(spark, tmp_path):
    """Lines of a file that is read in many ranges are numbered as in one; only asked machines' files are read."""
    lengths = {"a": 2000, "b [1]": 700, "c": 3}
    for part in machines.PARTS:
        (tmp_path / part).mkdir()
        for name, n in lengths.items():
            (tmp_path / part / f"{name}.txt").write_text("".join(f"{int(i % 9 == 0)}\n" if part == "test_label" else f"{i},{i % 7}\n" + "\n" * (i % 5 == 0) for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = machines._lines(spark, str(tmp_path), "train", ["a", "b [1]"])
        got = lines.select("machine_id", "t", "n_lines", "line", F.spark_partition_id().alias("task")).collect()
        rows = machines.load_machines(spark, str(tmp_path), ["b [1]", "a"]).where("split = 'test'").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name in ("a", "b [1]"):
        own = sorted((r["t"], r["line"], r["n_lines"]) for r in got if r["machine_id"] == name)
        assert own == [(i, f"{i},{i % 7}", lengths[name]) for i in range(lengths[name])]
        assert sorted((r["t"], r["x"][0], r["anomaly_label"]) for r in rows if r["machine_id"] == name) == [(i, float(i), int(i % 9 == 0)) for i in range(lengths[name])]
    files_read = machines._lines(spark, str(tmp_path), "train", ["c"]).select("machine_id").distinct().collect()
    assert [r[0] for r in files_read] == ["c"] and {r["group_id"] for r in rows if r["machine_id"] == "a"} == {1}


def test_windows_in_sql(spark):
    from wavemark.functions import window_table
    from wavemark.operators import windows

    window_table.register(spark)
    df = spark.createDataFrame([(s, t, [t * 1.5, float(s)], t % 3, int(t % 5 == 0)) for s, n in ((1, 20), (2, 4), (3, 9)) for t in range(n)], "series_id int, t long, x array<double>, regime_label int, anomaly_label int").repartition(4)
    df.createOrReplaceTempView("series_rows")
    for lookback, horizon, stride in ((3, 2, 1), (4, 1, 3), (1, 1, 2), (20, 1, 1)):
        got = spark.sql(f"SELECT * FROM windows(TABLE(series_rows) PARTITION BY series_id ORDER BY (t), {lookback}, {horizon}, {stride})")
        want = windows.make_windows(df, lookback, horizon, stride).select(*got.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(Exception, match="stride"):
        spark.sql("SELECT * FROM windows(TABLE(series_rows) PARTITION BY series_id ORDER BY (t), 3, 2, 0)").collect()


def test_synthetic_series(spark):
    space = synthetic.ConfigSpace(n_channels=2)
    made = synthetic.generate(synthetic.draw_configs(spark, space, 2, 1, 1, seed=3), 60, seed=3)
    assert made.count() == 240 and made.select("series_id").distinct().count() == 4
    again = synthetic.generate(synthetic.draw_configs(spark, space, 2, 1, 1, seed=3), 60, seed=3)
    key = lambda d: d.orderBy("series_id", "t").collect()
    assert key(made) == key(again)
    child = int(np.random.SeedSequence(3).spawn(4)[0].generate_state(1, dtype=np.uint32)[0])
    x, regime = synthetic.simulate(synthetic.draw_config(space, child), 60, 1003)
    first = made.where("series_id = 'synthetic-config-0000'").orderBy("t").collect()
    assert np.allclose([r["x"] for r in first], x) and [r["regime_label"] for r in first] == regime.tolist()


@pytest.mark.parametrize("layers", [1, 3])
def test_gradient(layers):
    rng = np.random.default_rng(0)
    config = neural.ModelConfig(2, horizon=2, hidden=3, components=2, n_regimes=2, layers=layers)
    w, x, y = neural.initial(config, 1), rng.normal(size=(4, 5, 2)), rng.normal(size=(4, 2, 2))
    labels = np.array([0, 1, 1, 0])
    _, g = neural.loss_and_gradient(config, w, x, y, labels, 0.5)
    for name, value in w.items():
        at = tuple(rng.integers(s) for s in value.shape)
        moved = []
        for step in (1e-5, -1e-5):
            other = {k: v.copy() for k, v in w.items()}
            other[name][at] += step
            moved.append(neural.loss_and_gradient(config, other, x, y, labels, 0.5)[0])
        assert g[name][at] == pytest.approx((moved[0] - moved[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_forward_of_every_step():
    rng = np.random.default_rng(3)
    config = neural.ModelConfig(2, horizon=2, hidden=3, components=2, n_regimes=2, layers=2, dropout=0.5)
    w, x = neural.initial(config, 1), rng.normal(size=(4, 5, 2))
    last, steps = neural.forward(config, w, x), neural.forward(config, w, x, every_step=True)
    for name in ("logits", "means", "stds", "regime_logits", "probs"):
        assert steps[name].shape[:2] == (4, 5) and np.allclose(steps[name][:, -1], last[name])
    other = neural.forward(config, w, x, override=np.full((4, 2), [9.0, -9.0]))
    assert np.allclose(other["probs"][:, 0], 1) and not np.allclose(other["means"], last["means"])
    with pytest.raises(ValueError, match="override"):
        neural.forward(config, w, x, override=np.zeros((4, 3)))
    dropped = neural.forward(config, w, x, rng=np.random.default_rng(0))
    assert not np.allclose(dropped["means"], last["means"])
    logits = np.log(np.array([[[0.5, 0.5], [0.9, 0.1], [0.9, 0.1]]]))
    assert neural.regime_smoothness(logits) == pytest.approx(0.9 * np.log(1.8) + 0.1 * np.log(0.2)) and neural.regime_smoothness(logits[:, :1]) == 0
    for bad in ({"layers": 0}, {"dropout": 1.0}):
        with pytest.raises(ValueError):
            neural.ModelConfig(1, **bad).check()


def test_training_refuses_labels_out_of_range(spark):
    df = spark.createDataFrame([(0, [[0.0]], [[0.0]], 2)], "seq long, window array<array<double>>, target array<array<double>>, regime_label int")
    with pytest.raises(ValueError, match="n_regimes"):
        neural.train(df, neural.ModelConfig(1, n_regimes=2), neural.TrainingConfig(supervised=0.5))


def test_training_learns(spark):
    line = np.linspace(-1, 1, 70)
    rows = [(i, [[float(v)] for v in line[i : i + 6]], [[float(line[i + 6])]], 0) for i in range(64)]
    df = spark.createDataFrame(rows, "seq long, window array<array<double>>, target array<array<double>>, regime_label int")
    model = neural.train(df, neural.ModelConfig(1, hidden=4, components=2), neural.TrainingConfig(epochs=4, batches=2, rate=0.05), df)
    assert model.train_loss[-1] < model.train_loss[0] and len(model.validation_loss) == 4
    got = neural.predict(df, model).collect()
    assert len(got) == 64 and sum(got[0]["weights"]) == pytest.approx(1)


def test_batches_follow_rows():
    """Every row once, in its batch, wherever frames and tasks are cut."""
    import pandas as pd

    n, size = 100, 16
    for tasks, cut in ((1, 7), (3, 10), (40, 2)):
        seen = {}
        for task in range(tasks):
            places = np.arange(task, n, tasks)
            frames = [pd.DataFrame({"_place": p, "window": [[[float(v)]] for v in p], "target": [[[0.0]]] * len(p), "regime_label": 0}) for p in np.array_split(places, max(1, len(places) // cut)) if len(p)]
            parts = list(neural.batches_of(iter(frames), size, 7))
            assert len(parts) == 7
            for batch, own in enumerate(parts):
                seen.setdefault(batch, []).extend(int(v) for x, _, _ in own for v in x[:, 0, 0])
        assert [sorted(seen[b]) for b in range(7)] == [list(range(b * size, min(n, (b + 1) * size))) for b in range(7)]


def made_rows(spark, n):
    return spark.range(n).select(F.col("id").alias("seq"), F.array(F.array(F.col("id") / n), F.array(F.sin("id"))).alias("window"), F.array(F.array(F.cos("id"))).alias("target"), (F.col("id") % 2).alias("regime_label"))


@pytest.mark.parametrize("tasks", [1, 3, None])
def test_training_equals_a_plain_loop(spark, tasks):
    """The same losses and weights as batches taken one after another in one process."""
    rows = made_rows(spark, 150)
    config, training = neural.ModelConfig(1, hidden=3, components=2, n_regimes=2), neural.TrainingConfig(epochs=2, batch_size=40, rate=0.03, decay=0.01, supervised=0.2, seed=4, tasks=tasks)
    model = neural.train(rows, config, training)
    state, losses = neural.Adam.first(neural.initial(config, 4)), []
    for epoch in range(2):
        order = rows.orderBy(F.xxhash64("seq", F.lit(4), F.lit(epoch))).toPandas()
        own = []
        for a in range(0, 150, 40):
            part = order.iloc[a : a + 40]
            loss, g = neural.loss_and_gradient(config, state.weights, *neural._arrays(part), part["regime_label"].to_numpy(), 0.2)
            own.append(loss / len(part))
            state.take(g, len(part), training)
        losses.append(np.mean(own))
    assert model.train_loss == pytest.approx(losses, rel=1e-9)
    assert all(np.allclose(model.weights[k], state.weights[k], atol=1e-9) for k in state.weights)


def test_jobs_of_an_epoch_do_not_follow_rows(spark):
    jobs, context = [], spark.sparkContext
    for n in (40, 3000):
        context.setJobGroup(f"rows {n}", "training")
        model = neural.train(made_rows(spark, n).repartition(2), neural.ModelConfig(1, hidden=2, components=1, dropout=0.1, layers=2), neural.TrainingConfig(epochs=1, batch_size=20))
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"rows {n}")))
        assert np.isfinite(model.train_loss[0])
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    empty = neural.train(made_rows(spark, 40).limit(0), neural.ModelConfig(1), neural.TrainingConfig(epochs=1))
    assert np.isnan(empty.train_loss[0]) and empty.weights.keys() == neural.initial(neural.ModelConfig(1), 0).keys()
    assert pipelines.configured("smd-mdn", {"batch_size": 7}).batch_size == 7


def test_forecast_covers_catalogue_windows(spark):
    found, sf = entry.queries(), "/root/testdata/sf0.001"
    windows_of = lambda name: {(r["series_id"], r["start"]) for r in found[name](spark, sf).select("series_id", "start").collect()}
    assert windows_of("mdn_forecast") == windows_of("sliding_windows")


def test_queries_take_default_parameters(spark, monkeypatch):
    from inspect import signature

    from wavemark.queries import forecasting, series

    given = {}

    def spied(where, name):
        real = getattr(where, name)

        def call(*args, **kwargs):
            bound = signature(real).bind(*args, **kwargs)
            bound.apply_defaults()
            given.update(bound.arguments)
            return real(*args, **kwargs)

        monkeypatch.setattr(where, name, call)

    spied(forecasting, "energy_score")
    spied(series.clustering, "fit_pseudo_regimes")
    assert entry.queries()["energy_score"](spark, "/root/testdata/sf0.001").count() == 1000
    assert entry.queries()["kmeans_pseudo_regimes"](spark, "/root/testdata/sf0.001").count() > 0
    assert (given["samples"], given["max_iter"]) == (256, 50)


SMALL = {"n_train_configs": 2, "n_validation_configs": 1, "n_test_configs": 1, "series_length": 80, "burn_in": 10, "n_channels": 2, "lookback": 8, "horizon": 2, "stride": 3, "energy_samples": 8}
TINY = {"hidden_size": 3, "n_components": 2, "epochs": 1, "learning_rate": 0.01, "device": "cuda"}


def test_suite(spark, tmp_path):
    jobs = [{"run_id": "a", "pipeline": "synthetic-baseline", "params": SMALL}, {"run_id": "b", "pipeline": "synthetic-joint", "params": SMALL | TINY | {"anomaly_score_method": "channel_max_nll", "threshold_strategy": "validation_quantile_95"}}]
    (tmp_path / "suite.json").write_text(json.dumps({"name": "s", "jobs": jobs}))
    loaded = suite.with_overrides(suite.load_suite(str(tmp_path / "suite.json")), {"seed": 4})
    out = tmp_path / "runs"
    suite.run_suite(spark, loaded, str(out), compare=str(tmp_path / "table.csv"))
    report = json.loads((out / "a" / "metrics.json").read_text())
    assert set(report) == {"forecast", "anomaly", "regime"} and report["forecast"]["nll"] is not None
    table = runs.collect_runs(spark, str(out))
    assert table.columns[:3] == ["run_dir", "manifest.run_id", "manifest.pipeline"] and table.count() == 2
    assert (tmp_path / "table.csv").read_text().startswith("run_dir,manifest.run_id,manifest.pipeline")
    made = reports.rescore(spark, str(out / "a"), str(tmp_path / "again"), [("validation_quantile_99", reports.Persistence(5, 2)), ("per_machine_validation_quantile_98", reports.Persistence(2, 1))])
    assert made[0].endswith("a-validation-quantile-99-w5-c2") and len(made) == 2
    [other] = reports.rescore(spark, str(out / "a"), str(tmp_path / "again"), [("target_recall_70", reports.Persistence())], pipeline="p", dataset="d", seed=9, base="B")
    said = runs.read_manifest(f"{other}/manifest.json")
    assert (said.run_id, said.pipeline, said.dataset, said.seed) == ("b-target-recall-70-w1-c1", "p", "d", 9) and "target_recall_70" in said.notes
    kept = runs.read_manifest(f"{made[0]}/manifest.json")
    assert (kept.pipeline, kept.seed) == ("synthetic-baseline", 4)
    for name, keys in (("a", {"validation", "test"}), ("b", {"validation", "test"})):
        found = json.loads((out / name / "mixture_diagnostics.json").read_text())
        assert set(found) == keys and {"min_entropy", "max_entropy", "component_mean_weights", "std"} <= set(found["test"])
    assert json.loads((out / "b" / "regime_diagnostics.json").read_text())["mean_confidence"] > 0 and not (out / "a" / "regime_diagnostics.json").exists()
    spark.read.parquet(str(out / "a" / "scores")).where("split = 'test'").write.partitionBy("split").parquet(str(tmp_path / "half" / "scores"))
    with pytest.raises(FileNotFoundError, match="scores of validation"):
        reports.rescore(spark, str(tmp_path / "half"), str(tmp_path / "again"), [("max_validation_f1", reports.Persistence())])
    (out / "a" / "metrics.json").unlink()
    assert cli.main(["evaluate", str(out / "a"), "--persistence-window", "3", "--persistence-count", "2", "--skip-forecast"]) == 0
    assert json.loads((out / "a" / "metrics.json").read_text())["anomaly"]["persistence"] == {"window": 3, "count": 2}
    with pytest.raises(FileExistsError):
        pipelines.PIPELINES["synthetic-baseline"](spark, str(out / "a"), pipelines.configured("synthetic-baseline", SMALL))
    with pytest.raises(ValueError, match="unknown"):
        pipelines.configured("synthetic-mdn", {"nonsense": 1})
    with pytest.raises(ValueError, match="pipeline"):
        suite.Suite("s", (suite.SuiteJob("x", "nope", "d"),)).check()


def test_machine_pipeline(spark, tree, tmp_path):
    config = pipelines.configured("smd-baseline", {"root": tree, "lookback": 3, "validation_fraction": 0.25, "energy_samples": 8})
    report = pipelines.PIPELINES["smd-baseline"](spark, str(tmp_path / "run"), config)
    assert report["anomaly"]["validation"]["f1"] == 1.0  # nothing to find, nothing predicted


MACHINES = {"root": "somewhere", "machine_ids": ["a", "b"], "validation_fraction": 0.3, "lookback": 9, "horizon": 2, "stride": 4, "energy_samples": 8, "seed": 6}
SCORING = {"threshold_strategy": "per_machine_validation_quantile_985", "anomaly_persistence_window": 5, "anomaly_persistence_count": 2}
NEURAL = {"hidden_size": 5, "num_layers": 2, "n_components": 4, "epochs": 3, "batch_size": 32, "learning_rate": 0.5, "device": "cuda"}


@pytest.mark.parametrize(
    ("name", "params"),
    [
        ("synthetic-baseline", SMALL | {"season_length": 3, "n_regimes": 4, "ar_order": 3, "seed": 2}),
        ("synthetic-mdn", SMALL | NEURAL),
        ("synthetic-joint", SMALL | NEURAL | {"smoothness_weight": 0.3, "supervised_regime_weight": 0.4}),
        ("smd-baseline", MACHINES | {"season_length": 2}),
        ("smd-mdn", MACHINES | NEURAL | SCORING | {"anomaly_score_method": "channel_top3_mean_nll"}),
        ("smd-joint", MACHINES | NEURAL | SCORING | {"n_regimes": 4, "smoothness_weight": 0.1, "supervised_regime_weight": 1.0, "pseudo_regime_method": "window_kmeans", "pseudo_regime_max_iter": 7, "anomaly_score_method": "regime_switch"}),
    ],
)
def test_parameters(tmp_path, name, params):
    """Every parameter by its name, in a suite and on the command line."""
    (tmp_path / "suite.json").write_text(json.dumps({"name": "s", "jobs": [{"run_id": "r", "pipeline": name, "dataset": "d", "params": params, "notes": "n"}]}))
    loaded = suite.load_suite(str(tmp_path / "suite.json"))
    loaded.check()
    config = pipelines.configured(name, loaded.jobs[0].params)
    plain = {k: list(v) if isinstance(v, tuple) else v for k, v in vars(config).items()}
    assert {k: plain[k] for k in params} == params
    flags = [x for k, v in params.items() if k not in ("root", "machine_ids") for x in (f"--{k.replace('_', '-')}", str(v))]
    flags += [x for m in params.get("machine_ids", ()) for x in ("--machine-id", m)]
    said = vars(cli.parser().parse_args([name, *([params["root"]] if "root" in params else []), "out", *flags]))
    assert pipelines.configured(name, {k: v for k, v in said.items() if k in pipelines.DEFAULTS[name]}) == config


def test_parameters_out_of_range():
    assert pipelines.configured("synthetic-baseline").series_length == 3000 and pipelines.configured("synthetic-baseline").n_test_configs == 10
    assert pipelines.configured("smd-joint", {"root": "r"}).lookback == 100 and pipelines.configured("synthetic-mdn").hidden_size == 32
    for name, bad in [
        ("synthetic-mdn", {"season_length": 1}), ("smd-mdn", {"anomaly_score_method": "regime_switch"}), ("smd-joint", {"root": "r", "supervised_regime_weight": 0.1}), ("smd-joint", {"pseudo_regime_method": "magic"}), ("synthetic-joint", {"learning_rate": 0}),
        ("synthetic-joint", {"series_length": 32}), ("smd-baseline", {"validation_fraction": 1.0}), ("smd-mdn", {"anomaly_persistence_window": 1, "anomaly_persistence_count": 2}), ("smd-mdn", {"energy_samples": 1}), ("smd-mdn", {"device": ""}), ("smd-mdn", {"threshold_strategy": "guess"}),
    ]:
        with pytest.raises(ValueError):
            pipelines.configured(name, bad)


def test_spread_over_series(spark):
    """Of the synthetic baseline: differences run over the train series put one after another, not over windows."""
    c = pipelines.configured("synthetic-baseline", SMALL | {"season_length": 2, "seed": 5})
    rows, _, scaled = pipelines.synthetic_windows(spark, c, True)
    train = scaled.where("split = 'train'").orderBy("group_id", "t").collect()
    x = np.array([r["x"] for r in train])
    assert x.shape == (160, 2) and pipelines.series_spread(scaled, c) == pytest.approx(np.maximum((x[2:] - x[:-2]).std(axis=0), 1e-3))
    assert pipelines.window_spread(rows, c) != pytest.approx(pipelines.series_spread(scaled, c))


def test_artifacts_appear_whole(spark, tmp_path):
    from wavemark.sources import files

    root = f"file:{tmp_path}/run"  # a path that Hadoop's file systems know, and open() does not
    with pytest.raises(FileNotFoundError, match="no forecast"):
        reports.evaluate_run(spark, root)
    runs.write_json(f"{root}/a/b.json", {"x": float("nan"), "y": [1]})
    assert json.loads(files.read_text(f"{root}/a/b.json")) == {"x": None, "y": [1]}
    broken = spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("broken")).cast("long")).alias("id"))
    runs.write_table(spark.range(2).toDF("id"), root, "scores")
    with pytest.raises(Exception, match="broken"):
        runs.write_table(broken, root, "scores")
    with pytest.raises(Exception, match="broken"):
        runs.write_table(broken, root, "regimes")
    assert files.names(root) == ["a", "scores"] and {p.name for p in (tmp_path / "run").iterdir()} == {"a", "scores"}
    assert sorted(r[0] for r in runs.read_table(spark, root, "scores").collect()) == [0, 1] and runs.read_table(spark, root, "regimes") is None
    with pytest.raises(FileExistsError):
        runs.prepare_folder(root)
    files.delete(f"{root}/a")
    assert files.names(root) == ["scores"] and not files.exists(f"{root}/a")


def test_reports(spark):
    def rows(score, label):
        return spark.createDataFrame([(i, float(s), y, g) for i, (s, y, g) in enumerate(zip(score, label, [0] * len(score), strict=True))], "seq long, score double, label int, group_id int")

    got = reports.evaluate_anomaly(rows([0.1, 0.2, 0.3, 0.4], [0] * 4), rows([0.1, 0.35, 0.45], [0, 1, 1]), "validation_quantile_95")
    assert got["threshold"] == pytest.approx(0.385) and got["test"]["recall"] == 0.5
    assert reports.rescore_id("Run A", "per_machine_validation_quantile_98", reports.Persistence(5, 2)) == "run-a-per-machine-validation-quantile-98-w5-c2"
    assert runs.json_ready({1: float("nan"), "a": [float("inf"), 2]}) == {"1": None, "a": [None, 2]}
    assert cli.pair("a=1") == ("a", 1) and cli.pair("a=x") == ("a", "x") and cli.persistence("5:2") == reports.Persistence(5, 2)


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"s{i % 2}", f"2024-01-01 00:{i // 2:02d}:00", float(rng.normal()) + 9 * (i % 17 == 0)) for i in range(80)]
    events = spark.createDataFrame(rows, "series_id string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    settings = spark.createDataFrame([("s0", 1.0, 3.0), ("s1", 1.0, 3.0)], "series_id string, std double, threshold double")
    for k in range(2):
        events.where((F.minute("ts") >= 20 * k) & (F.minute("ts") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = alerts.alerts(stream, settings).writeStream.format("memory").queryName("alerted").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {(r["series_id"], r["ts"]): (r["score"], r["alert"]) for r in spark.table("alerted").collect()}
    want, last, hits = {}, {}, {}
    for r in events.orderBy("ts", "series_id").collect():
        s = r["series_id"]
        score = alerts.gaussian_score(r["value"] - last[s], 1.0) if s in last else None
        last[s] = r["value"]
        hits[s] = [*hits.get(s, []), int(score is not None and score >= 3.0)][-3:]
        want[s, r["ts"]] = (score, int(sum(hits[s]) >= 2))
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and (got[k][0] == pytest.approx(want[k][0]) or got[k][0] != got[k][0]) for k in want)
    assert alerts.episodes(spark.table("alerted")).count() >= 1


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
