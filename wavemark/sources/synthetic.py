"""Seeded switching autoregressive series: a Markov chain of regimes, each with its own recursion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ConfigSpace:
    """Ranges from which configurations are drawn."""

    n_regimes: int = 3
    n_channels: int = 4
    ar_order: int = 2
    self_transition: tuple[float, float] = (0.92, 0.99)
    coefficient: tuple[float, float] = (-0.5, 0.5)
    intercept: tuple[float, float] = (-1.0, 1.0)
    noise_std: tuple[float, float] = (0.05, 0.3)

    def check(self) -> None:
        if self.n_regimes < 2 or self.n_channels < 1 or self.ar_order < 1:
            raise ValueError("at least two regimes, one channel and order one are needed")
        for low, high in (self.self_transition, self.coefficient, self.intercept, self.noise_std):
            if low >= high:
                raise ValueError("a range must rise")
        if self.self_transition[0] <= 0 or self.self_transition[1] >= 1 or self.noise_std[0] <= 0:
            raise ValueError("transitions lie between 0 and 1, and noise is positive")


def draw_config(space: ConfigSpace, seed: int) -> dict[str, list]:
    """One configuration; the order of draws is fixed: transitions, coefficients, intercepts,
    noise, first regime."""
    space.check()
    rng, k, d = np.random.default_rng(seed), space.n_regimes, space.n_channels
    moves = np.zeros((k, k))
    for i in range(k):
        stay = rng.uniform(*space.self_transition)
        rest = rng.dirichlet(np.ones(k - 1)) if k > 2 else np.ones(1)
        moves[i] = np.insert((1 - stay) * rest, i, stay)
    ar = rng.uniform(*space.coefficient, size=(k, space.ar_order, d))
    ar *= np.minimum(1.0, 0.95 / np.maximum(np.abs(ar).sum(axis=1, keepdims=True), 1e-12))
    level, noise = rng.uniform(*space.intercept, size=(k, d)), rng.uniform(*space.noise_std, size=(k, d))
    return {"transition": moves.tolist(), "ar": ar.tolist(), "intercept": level.tolist(), "noise": noise.tolist(), "first": int(rng.integers(k))}


CONFIG = "config_id string, split string, number int, transition array<array<double>>, ar array<array<array<double>>>, intercept array<array<double>>, noise array<array<double>>, first int"


def draw_configs(spark: SparkSession, space: ConfigSpace, train: int, validation: int, test: int, seed: int) -> DataFrame:
    """Configurations for disjoint splits, a row each; ``number`` counts in the split."""
    if min(train, validation, test) < 1:
        raise ValueError("each split needs a configuration")
    children = np.random.SeedSequence(seed).spawn(train + validation + test)
    places = [(s, i) for s, n in (("train", train), ("validation", validation), ("test", test)) for i in range(n)]
    rows = []
    for k, (child, (split, i)) in enumerate(zip(children, places, strict=True)):
        c = draw_config(space, int(child.generate_state(1, dtype=np.uint32)[0]))
        rows.append((f"synthetic-config-{k:04d}", split, i, c["transition"], c["ar"], c["intercept"], c["noise"], c["first"]))
    return spark.createDataFrame(rows, CONFIG)


def simulate(config: dict, length: int, seed: int, burn_in: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Observations and regimes. All regimes are drawn before the first observation."""
    rng, n = np.random.default_rng(seed), length + burn_in
    moves, ar, level, noise = (np.array(config[c]) for c in ("transition", "ar", "intercept", "noise"))
    regime = [int(config["first"])]
    while len(regime) < n:
        regime.append(int(rng.choice(len(moves), p=moves[regime[-1]])))
    x = np.zeros((n, level.shape[1]))
    for t, r in enumerate(regime):
        past = x[max(0, t - ar.shape[1]) : t][::-1]
        x[t] = level[r] + (ar[r, : len(past)] * past).sum(axis=0) + rng.normal(0.0, noise[r])
    return x[burn_in:], np.array(regime[burn_in:])


def generate(configs: DataFrame, length: int, seed: int, burn_in: int = 50) -> DataFrame:
    """The series of each configuration: ``series_id``, ``split``, ``group_id``, ``t``, ``x``,
    ``regime_label``, ``anomaly_label`` (0). A series' seed is ``seed`` plus 1000, 2000 or 3000 for
    its split, plus its number; each is made in one task."""
    if length < 1 or burn_in < 0:
        raise ValueError("length must be positive and burn_in not negative")
    base = {"train": 1000, "validation": 2000, "test": 3000}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                plain = row | {c: [np.stack([np.stack(b) if isinstance(b[0], np.ndarray) else b for b in a]) if isinstance(a[0], np.ndarray) else a for a in row[c]] for c in ("transition", "ar", "intercept", "noise")}
                x, regime = simulate(plain, length, seed + base[row["split"]] + row["number"], burn_in)
                yield pd.DataFrame({"series_id": row["config_id"], "split": row["split"], "group_id": row["number"], "t": np.arange(length), "x": list(x), "regime_label": regime, "anomaly_label": 0})

    return configs.repartition("config_id").mapInPandas(run, "series_id string, split string, group_id int, t long, x array<double>, regime_label long, anomaly_label int")
