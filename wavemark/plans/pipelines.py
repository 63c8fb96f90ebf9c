"""End-to-end runs: data, windows, a forecaster, scores, artifacts and a report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import baselines, clustering, failures, regimes, scaling, thresholds, windows
from ..operators.sequence import CHUNK, kept, numbered
from ..sources import machines, runs, synthetic
from . import neural, reports

PSEUDO_REGIMES = ("none", "window_kmeans")


@dataclass(frozen=True)
class PipelineConfig:
    """Parameters of all pipelines. Each takes those that DEFAULTS names, and has its own defaults.
    ``device`` is accepted and has no effect: Spark's executors train."""

    root: str = ""
    machine_ids: tuple[str, ...] | None = None
    validation_fraction: float = 0.2
    seed: int = 0
    n_train_configs: int = 4
    n_validation_configs: int = 1
    n_test_configs: int = 1
    series_length: int = 500
    burn_in: int = 50
    n_regimes: int = 3
    n_channels: int = 1
    ar_order: int = 2
    lookback: int = 32
    horizon: int = 1
    stride: int = 1
    season_length: int = 1
    hidden_size: int = 32
    num_layers: int = 1
    n_components: int = 3
    dropout: float = 0.0
    epochs: int = 5
    batch_size: int = 64
    learning_rate: float = 1e-3
    smoothness_weight: float = 0.0
    supervised_regime_weight: float = 0.0
    pseudo_regime_method: str = "none"
    pseudo_regime_max_iter: int = 50
    energy_samples: int = 64
    device: str = "cpu"
    anomaly_score_method: str = "mean_nll"
    threshold_strategy: str = "max_validation_f1"
    anomaly_persistence_window: int = 1
    anomaly_persistence_count: int = 1

    def check(self) -> None:
        counts = ("n_train_configs", "n_validation_configs", "n_test_configs", "n_channels", "ar_order", "lookback", "horizon", "stride", "season_length", "hidden_size", "num_layers", "n_components", "epochs", "batch_size", "pseudo_regime_max_iter")
        for name in counts:
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        for name in ("smoothness_weight", "supervised_regime_weight", "burn_in"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.learning_rate <= 0 or self.energy_samples < 2 or self.n_regimes < 2 or not self.device:
            raise ValueError("learning_rate must be positive, energy_samples and n_regimes at least 2, and device not empty")
        if not 0 < self.validation_fraction < 1:
            raise ValueError("validation_fraction must lie between 0 and 1")
        if not self.root and self.series_length < self.lookback + self.horizon + 1:
            raise ValueError("series_length must exceed lookback and horizon together")
        if self.pseudo_regime_method not in PSEUDO_REGIMES:
            raise ValueError(f"pseudo_regime_method must be one of {', '.join(PSEUDO_REGIMES)}")
        if self.supervised_regime_weight and self.root and self.pseudo_regime_method == "none":
            raise ValueError("a supervised regime loss on machines needs a pseudo_regime_method")
        if self.anomaly_score_method not in (*scores.FORECAST_METHODS, *scores.REGIME_METHODS):
            raise ValueError(f"unknown anomaly_score_method {self.anomaly_score_method!r}")
        thresholds.check_strategy(self.threshold_strategy)
        thresholds.check_persistence(self.anomaly_persistence_window, self.anomaly_persistence_count)

    def space(self) -> synthetic.ConfigSpace:
        return synthetic.ConfigSpace(self.n_regimes, self.n_channels, self.ar_order)


# What each pipeline takes, with its defaults.
_SCORING = {"anomaly_score_method": "mean_nll", "threshold_strategy": "max_validation_f1", "anomaly_persistence_window": 1, "anomaly_persistence_count": 1}
_SERIES = _SCORING | {"seed": 0, "n_train_configs": 4, "n_validation_configs": 1, "n_test_configs": 1, "series_length": 500, "burn_in": 50, "n_regimes": 3, "n_channels": 1, "ar_order": 2, "lookback": 32, "horizon": 1, "stride": 1, "energy_samples": 64}
_MACHINES = _SCORING | {"root": "", "machine_ids": None, "validation_fraction": 0.2, "seed": 0, "lookback": 100, "horizon": 1, "stride": 1, "energy_samples": 128}
_NEURAL = {"hidden_size": 32, "num_layers": 1, "n_components": 3, "dropout": 0.0, "epochs": 5, "batch_size": 64, "learning_rate": 1e-3, "device": "cpu"}
_JOINT = {"smoothness_weight": 0.1, "supervised_regime_weight": 0.0}
DEFAULTS: dict[str, dict] = {
    "synthetic-baseline": _SERIES | {"season_length": 1, "n_train_configs": 20, "n_validation_configs": 5, "n_test_configs": 10, "series_length": 3000, "lookback": 100, "energy_samples": 128},
    "synthetic-mdn": _SERIES | _NEURAL,
    "synthetic-joint": _SERIES | _NEURAL | _JOINT,
    "smd-baseline": _MACHINES | {"season_length": 1},
    "smd-mdn": _MACHINES | _NEURAL,
    "smd-joint": _MACHINES | _NEURAL | _JOINT | {"n_regimes": 3, "pseudo_regime_method": "none", "pseudo_regime_max_iter": 50},
}


def synthetic_windows(spark: SparkSession, c: PipelineConfig, rich_failures: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows of all splits, with ``seq`` in each; the scaler, fitted on all train series together;
    and the scaled series. Failures are injected into validation and test series."""
    raw = synthetic.generate(synthetic.draw_configs(spark, c.space(), c.n_train_configs, c.n_validation_configs, c.n_test_configs, c.seed), c.series_length, c.seed, c.burn_in)
    events = failures.default_events(c.series_length, rich_failures)
    hurt = failures.inject(raw.where("split != 'train'"), events, seed=c.seed + 10_000, shape=(c.series_length, c.n_channels))
    rows = raw.where("split = 'train'").unionByName(hurt)
    scaler = scaling.fit_scaler(rows.where("split = 'train'"), by=())
    scaled = scaling.scale(rows, scaler, by=())
    made = windows.make_windows(scaled, c.lookback, c.horizon, c.stride, by=["split", "group_id"])
    return _in_sequence(made), scaler, scaled


def machine_windows(spark: SparkSession, c: PipelineConfig) -> tuple[DataFrame, DataFrame]:
    rows = machines.load_machines(spark, c.root, c.machine_ids)
    scaler = scaling.fit_scaler(rows.where("split = 'train'"), ["machine_id"])
    return machines.windowed_machines(machines.prepare_machines(rows, c.validation_fraction), c.lookback, c.horizon, c.stride), scaler


def _in_sequence(made: DataFrame) -> DataFrame:
    parts = [numbered(made.where(F.col("split") == s), ["group_id"], ["start"], chunk=CHUNK) for s in ("train", "validation", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def series_spread(scaled: DataFrame, c: PipelineConfig) -> list[float]:
    """The seasonal differences' spread over the train series, put one after another."""
    place = F.col("group_id") * F.lit(c.series_length).cast("long") + F.col("t")
    rows = scaled.where("split = 'train'").select(place.alias("place"), "x")
    return list(baselines.fit_seasonal(rows, c.season_length, by=(), t="place").first()["std"])


def window_spread(rows: DataFrame, c: PipelineConfig) -> list[float]:
    """The seasonal differences' spread over the steps of the train windows, put one after another."""
    flat = windows.flatten(rows.where("split = 'train'"), lookback=c.lookback).select("place", F.col("x").cast("array<double>").alias("x"))
    return list(baselines.fit_seasonal(flat, c.season_length, by=(), t="place").first()["std"])


def _baseline(c: PipelineConfig, rows: DataFrame, std: list[float]) -> DataFrame:
    """The seasonal forecast with a constant spread."""
    made = baselines.forecast_seasonal(rows.where("split != 'train'"), c.season_length, c.horizon, F.array(*map(F.lit, std)))
    observed = F.get("target", F.col("h")).cast("array<double>")
    return made.select("split", "group_id", "seq", "h", observed.alias("observed"), "weights", F.col("means").cast("array<array<double>>").alias("means"), "stds", F.array().cast("array<double>").alias("probs"))


def _neural(c: PipelineConfig, rows: DataFrame, joint: bool) -> tuple[DataFrame, neural.Trained]:
    channels = len(rows.first()["window"][0])
    config = neural.ModelConfig(channels, c.horizon, c.hidden_size, c.n_components, c.n_regimes if joint else 0, c.num_layers, c.dropout)
    training = neural.TrainingConfig(epochs=c.epochs, batch_size=c.batch_size, rate=c.learning_rate, supervised=c.supervised_regime_weight if joint else 0.0, smoothness=c.smoothness_weight, seed=c.seed)
    model = neural.train(rows.where("split = 'train'"), config, training, rows.where("split = 'validation'"))
    return neural.predict(rows.where("split != 'train'"), model, ("split", "group_id", "seq")), model


def _run(spark: SparkSession, out: str, c: PipelineConfig, kind: str, on_machines: bool, overwrite: bool) -> dict:
    c.check()
    if on_machines and not c.root:
        raise ValueError("root must name the machines' folder")
    runs.prepare_folder(out, overwrite)
    if on_machines:
        (rows, scaler), scaled = machine_windows(spark, c), None
    else:
        rows, scaler, scaled = synthetic_windows(spark, c, kind == "baseline")
    with kept(rows) as rows:
        if kind == "joint" and c.pseudo_regime_method != "none":
            model = clustering.fit_pseudo_regimes(rows.where("split = 'train'"), c.n_regimes, c.seed, c.pseudo_regime_max_iter)
            rows = model.predict(rows.drop("regime_label"))
        if kind == "baseline":
            trained, std = None, window_spread(rows, c) if scaled is None else series_spread(scaled, c)
            forecast = _baseline(c, rows, std)
        else:
            forecast, trained = _neural(c, rows, kind == "joint")
        with kept(forecast) as forecast:
            _write_run(out, c, kind, rows, forecast, scaler, trained)
    persistence = reports.Persistence(c.anomaly_persistence_window, c.anomaly_persistence_count)
    return reports.evaluate_run(spark, out, output=f"{out}/metrics.json", strategy=c.threshold_strategy, persistence=persistence, samples=c.energy_samples, seed=c.seed)


def _write_run(out: str, c: PipelineConfig, kind: str, rows: DataFrame, forecast: DataFrame, scaler: DataFrame, trained: neural.Trained | None) -> None:
    """All artifacts of a run but its report."""
    test = forecast.where("split = 'test'")
    runs.write_table(test.drop("split"), out, "forecast")
    reports.write_mixture_diagnostics(f"{out}/mixture_diagnostics.json", validation=forecast.where("split = 'validation'"), test=test)
    if kind == "joint":
        reports.write_regime_diagnostics(f"{out}/regime_diagnostics.json", test.where("h = 0").select("seq", "probs"))
    keys = ["split", "group_id", "seq"]
    if c.anomaly_score_method in scores.FORECAST_METHODS:
        scored = scores.forecast_scores(forecast, c.anomaly_score_method, keys)
    else:
        once = forecast.where("h = 0").select(*keys, "probs")
        scored = scores.regime_scores(once, c.anomaly_score_method, by=["split"]).select(*keys, "score")
    labelled = scored.join(rows.select(*keys, F.col("anomaly_label").alias("label")), keys)
    runs.write_table(labelled, out, "scores", "split")
    guess = regimes.argmax(F.col("probs")) if kind == "joint" else F.lit(0).cast("long")
    truth = rows.where("split = 'test'").select("seq", F.col("regime_label").cast("long").alias("true_label"))
    runs.write_table(test.where("h = 0").select("seq", guess.alias("pred_label"), "probs").join(truth, "seq"), out, "regimes")
    runs.write_table(scaler, out, "scaler")
    runs.write_json(f"{out}/config.json", asdict(c))
    if trained:
        runs.write_json(f"{out}/training_history.json", {"train_loss": trained.train_loss, "validation_loss": trained.validation_loss})
        runs.write_json(f"{out}/model.json", {"config": asdict(trained.config), "weights": {k: v.tolist() for k, v in trained.weights.items()}})


Runner = Callable[..., dict]


def _runner(name: str) -> Runner:
    source, kind = name.split("-")

    def run(spark: SparkSession, out: str, config: PipelineConfig | None = None, overwrite: bool = False) -> dict:
        return _run(spark, out, config or configured(name), kind, source == "smd", overwrite)

    return run


PIPELINES: dict[str, Runner] = {name: _runner(name) for name in DEFAULTS}


def configured(pipeline: str, params: dict | None = None) -> PipelineConfig:
    """The configuration of a pipeline from plain parameters; one that it does not take is an
    error."""
    defaults, known = DEFAULTS[pipeline], dict(params or {})
    unknown = sorted(set(known) - set(defaults))
    if unknown:
        raise ValueError(f"unknown parameters of {pipeline}: {', '.join(unknown)}")
    if known.get("machine_ids") is not None:
        known["machine_ids"] = tuple(known["machine_ids"])
    kinds = {f.name: f.type for f in fields(PipelineConfig)}
    made = {k: float(v) if kinds[k] == "float" else v for k, v in (defaults | known).items()}
    config = replace(PipelineConfig(), **made)
    config.check()
    if not pipeline.endswith("joint") and config.anomaly_score_method not in scores.FORECAST_METHODS:
        raise ValueError(f"{pipeline} has no regimes to score by {config.anomaly_score_method}")
    return config
