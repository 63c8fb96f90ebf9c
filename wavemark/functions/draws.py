"""Random numbers by hashing counters, and forecasts stacked by their shape, for use inside Spark
tasks: a row's numbers come from a seed and its key, not from how rows are dealt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def uniforms(keys: np.ndarray, seed: int, n: int) -> np.ndarray:
    """``n`` numbers between 0 and 1 for each integer key."""
    start = spread(keys.astype(np.int64).view(np.uint64) + np.array([seed & 0xFFFFFFFF], np.uint64) * _SEED)
    return ((spread(start[:, None] + np.arange(1, n + 1, dtype=np.uint64) * _STEP) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def normals(keys: np.ndarray, seed: int, n: int) -> np.ndarray:
    """``n`` standard normal numbers for each integer key, of two uniform ones each."""
    u = uniforms(keys, seed, 2 * n)
    return np.sqrt(-2 * np.log(u[:, ::2])) * np.cos(2 * np.pi * u[:, 1::2])


def shapes(y: pd.Series, w: pd.Series, m: pd.Series, s: pd.Series) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """Rows of one shape (components, channels) at a time: their places, and observed values,
    weights, means and deviations as arrays."""
    kinds = w.map(len).to_numpy() << 32 | y.map(len).to_numpy()
    for kind in np.unique(kinds):
        at = np.flatnonzero(kinds == kind)
        flat = lambda c: np.concatenate([np.concatenate(v) for v in c.iloc[at]]).reshape(len(at), kind >> 32, -1)  # noqa: B023, E731
        yield at, (np.stack(y.iloc[at]), np.stack(w.iloc[at]), flat(m), flat(s))
