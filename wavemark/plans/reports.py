"""Evaluation reports: composite plans over the artifacts of a run."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mixture
from ..functions.energy import energy_score
from ..functions.intervals import channel_coverage
from ..operators import diagnostics, ranges, regimes, selection, thresholds
from ..sources import files, runs


def evaluate_forecast(forecast: DataFrame, *, samples: int = 256, seed: int = 0, key: str = "seq") -> dict:
    """``nll``, ``channelwise_crps``, ``energy_score``, ``mae``, ``rmse``, ``interval_coverage_90``
    and ``diagnostics``, over all rows, steps and channels, in one pass over the forecast. A row that
    is no forecast (see ``mixture.valid``) fails the job."""
    columns = [F.col(c) for c in ("observed", "weights", "means", "stds")]
    forecast = checked_forecast(forecast)
    y, w, m, s = columns
    rows = forecast.select(
        mixture.nll(*columns).alias("nll"),
        energy_score("observed", "weights", "means", "stds", key, samples, seed).alias("energy"),
        F.arrays_zip(
            mixture.channel_crps(*columns).alias("crps"), mixture.absolute_errors(y, w, m).alias("error"), channel_coverage("observed", "weights", "means", "stds").alias("inside")
        ).alias("channels"),
    )
    flat = rows.select("nll", "energy", F.posexplode("channels").alias("d", "c"))
    once = F.col("d") == 0
    got = flat.agg(
        F.avg(F.when(once, F.col("nll"))).alias("nll"), F.avg("c.crps").alias("channelwise_crps"), F.avg(F.when(once, F.col("energy"))).alias("energy_score"),
        F.avg("c.error").alias("mae"), F.sqrt(F.avg(F.col("c.error") * F.col("c.error"))).alias("rmse"), F.avg("c.inside").alias("interval_coverage_90"),
    ).first()
    return got.asDict() | {"diagnostics": diagnostics.mixture_diagnostics(forecast).first().asDict(recursive=True)}


def checked_forecast(forecast: DataFrame) -> DataFrame:
    """The rows as they are; one that is no forecast fails the job."""
    good = F.coalesce(mixture.valid(*(F.col(c) for c in ("observed", "weights", "means", "stds"))), F.lit(False))
    return forecast.where(F.when(good, True).otherwise(F.raise_error(F.lit("a forecast needs finite values of one shape, weights that are not negative nor all zero, and positive deviations")).cast("boolean")))


def write_mixture_diagnostics(path: str, **splits: DataFrame | None) -> None:
    """The diagnostics of the forecasts of each split ('validation', 'test'), as JSON."""
    runs.write_json(path, {split: diagnostics.mixture_diagnostics(checked_forecast(df)).first().asDict(recursive=True) for split, df in splits.items() if df is not None})


def write_regime_diagnostics(path: str, posterior: DataFrame, by: Sequence[str] = ()) -> None:
    """The diagnostics of regime posteriors (``seq``, ``probs``), as JSON."""
    runs.write_json(path, regimes.posterior_diagnostics(posterior, by=by).first().asDict())


@dataclass(frozen=True)
class Persistence:
    window: int = 1
    count: int = 1


def evaluate_anomaly(validation: DataFrame, test: DataFrame, strategy: str = "max_validation_f1", persistence: Persistence = Persistence(), group: str = "group_id", areas: Mapping[str, float] | None = None) -> dict:
    """Threshold from the validation rows, predictions and persistence on both, range metrics,
    delays and false alarms on the test rows, and the threshold-free areas of its raw scores
    (``areas``, if they are known already).

    Rows have ``seq``, ``score``, ``label`` and, for strategies by group, ``group_id``. Ranges run
    over the whole sequence; persistence too, except that strategies by group restart it in each.
    """
    chosen = selection.select_threshold(validation, strategy, group)
    window, restart = (persistence.window, persistence.count), None if chosen.by_group is None else group
    thresholds.check_persistence(*window)

    def measured(df: DataFrame) -> dict:
        predicted = thresholds.predict(df, chosen.threshold) if chosen.by_group is None else thresholds.predict_by_group(df, chosen.by_group, group)
        return ranges.measures(predicted, persistence=window, restart=restart).first().asDict()

    found, before = measured(test), measured(validation)
    delay = {k: found.pop(k) for k in ("mean_delay", "median_delay", "detected", "missed")}
    alarms = found.pop("false_alarms_per_1000")
    if areas is None:
        areas = threshold_free(test)
    per_group = {r[group]: r["threshold"] for r in chosen.by_group.select(group, "threshold").collect()} if chosen.by_group is not None else None
    return {
        "strategy": strategy, "persistence": asdict(persistence), "threshold": chosen.threshold if per_group is None else per_group,
        "validation": {k: before[k] for k in ("precision", "recall", "f1")}, "test": found, "detection_delay": delay, "false_alarms_per_1000": alarms, "threshold_free": dict(areas),
    }


def threshold_free(test: DataFrame) -> dict[str, float]:
    return ranges.threshold_free(test, thresholds.candidates(test)).first().asDict()


def evaluate_regime(rows: DataFrame, truth: str = "true_label", pred: str = "pred_label") -> dict:
    """Agreement of labels as they are, false switches of the aligned ones, and their table."""
    mapping = regimes.align(rows, truth, pred)
    moved = regimes.aligned(rows, mapping, pred)
    cells = regimes.contingency(moved, truth, "aligned").orderBy("truth", "pred").collect()
    return {
        "adjusted_rand_index": regimes.adjusted_rand(rows, truth, pred).first()[0],
        "false_switch_rate_per_1000": regimes.false_switch_rate(moved, truth, "aligned").first()[0],
        "mapping": mapping,
        "confusion": [{"truth": r["truth"], "aligned": r["pred"], "n": r["n"]} for r in cells],
    }


def evaluate_run(spark: SparkSession, run_dir: str, *, output: str | None = None, strategy: str = "max_validation_f1", persistence: Persistence = Persistence(), samples: int = 256, seed: int = 0, skip: Sequence[str] = ()) -> dict:
    """The report of a run: the sections whose artifacts exist and are not skipped ('forecast',
    'anomaly', 'regime'). Written as JSON if ``output`` is given. A folder without any is an error."""
    report: dict = {}
    forecast, scores, labels = (runs.read_table(spark, run_dir, n) for n in ("forecast", "scores", "regimes"))
    if forecast is None and scores is None and labels is None:
        raise FileNotFoundError(f"{run_dir} has no forecast, scores or regimes")
    if forecast is not None and "forecast" not in skip:
        report["forecast"] = evaluate_forecast(forecast, samples=samples, seed=seed)
    if scores is not None and "anomaly" not in skip:
        report["anomaly"] = evaluate_anomaly(scores.where("split = 'validation'"), scores.where("split = 'test'"), strategy, persistence)
    if labels is not None and "regime" not in skip:
        report["regime"] = evaluate_regime(labels)
    if output:
        runs.write_json(output, report)
    return report


def rescore_id(base: str, strategy: str, persistence: Persistence) -> str:
    """The id of a rescored run: slugs of its base and strategy, and its persistence."""
    slug = lambda s: re.sub(r"[^a-z0-9]+", "-", s.lower()).strip("-")
    return f"{slug(base)}-{slug(strategy)}-w{persistence.window}-c{persistence.count}"


def rescore(
    spark: SparkSession, run_dir: str, output_root: str, jobs: Sequence[tuple[str, Persistence]], *, base: str | None = None, overwrite: bool = False, compare: str | None = None,
    pipeline: str | None = None, dataset: str | None = None, seed: int | None = None, notes: str | None = None,
) -> list[str]:
    """Score a run anew under each (strategy, persistence): a folder with metrics and a manifest
    for each, whose ``pipeline``, ``dataset``, ``seed`` and ``notes`` are the source's unless given
    (notes: unless given, what was done). Threshold-free areas do not depend on either, and are
    computed once. ``compare`` writes a table of all runs under the root."""
    for strategy, persistence in jobs:
        thresholds.check_strategy(strategy)
        thresholds.check_persistence(persistence.window, persistence.count)
    scores = runs.read_table(spark, run_dir, "scores")
    there = {r[0] for r in scores.select("split").distinct().collect()} if scores is not None else set()
    missing = [f"scores of {s}" for s in ("validation", "test") if s not in there]
    if missing:
        raise FileNotFoundError(f"{run_dir} has no {' and no '.join(missing)}")
    known = f"{run_dir}/manifest.json"
    said = runs.read_manifest(known) if files.exists(known) else runs.RunManifest(run_dir.rstrip("/").rpartition("/")[2], "unknown", "unknown")
    scores = scores.cache()
    try:
        validation, test = (scores.where(F.col("split") == s) for s in ("validation", "test"))
        areas, made = threshold_free(test), []
        for strategy, persistence in jobs:
            name = rescore_id(base or said.run_id, strategy, persistence)
            folder = f"{output_root}/{name}"
            if files.is_folder(folder):
                if not overwrite:
                    raise FileExistsError(folder)
                files.delete(folder)
            runs.write_json(f"{folder}/metrics.json", {"anomaly": evaluate_anomaly(validation, test, strategy, persistence, areas=areas)})
            done = notes or f"{run_dir} rescored by {strategy}, {persistence.count} of {persistence.window}"
            runs.write_manifest(f"{folder}/manifest.json", runs.RunManifest(name, pipeline or said.pipeline, dataset or said.dataset, said.seed if seed is None else seed, done))
            made.append(folder)
    finally:
        scores.unpersist()
    if compare:
        runs.write_comparison(runs.collect_runs(spark, output_root), compare)
    return made
