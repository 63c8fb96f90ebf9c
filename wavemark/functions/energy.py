"""The energy score of mixture forecasts, by seeded samples of each row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import normals, shapes, uniforms

#: Rows whose samples are held at a time: as many as have so many numbers, within these bounds.
_NUMBERS, _ROWS = 1 << 17, (64, 256)


def scores(y: np.ndarray, w: np.ndarray, m: np.ndarray, s: np.ndarray, keys: np.ndarray, samples: int, seed: int) -> np.ndarray:
    """For N rows: y N by D, w N by M, m and s N by M by D. Each row's component is drawn from a
    uniform number, its value from normal ones; all come from the seed and the row's key."""
    share = np.cumsum(w / w.sum(axis=1, keepdims=True), axis=1)
    drawn = uniforms(keys, seed, samples)
    part = np.minimum(sum((drawn >= share[:, c, None]).astype(np.int64) for c in range(w.shape[1])), w.shape[1] - 1)
    row = np.arange(len(y))[:, None]
    x = m[row, part] + s[row, part] * normals(keys, seed + 1, samples * y.shape[1]).reshape(len(y), samples, y.shape[1])
    error = x - y[:, None]
    length = np.abs(error.view(complex)[:, :, 0]) if y.shape[1] == 2 else np.linalg.norm(error, axis=2)
    return length.mean(axis=1) - mean_gaps(x) / 2


def mean_gaps(x: np.ndarray) -> np.ndarray:
    """For each row of x (N by samples by D) the mean distance of all ordered pairs of its samples.
    Each pair is taken once, those of all rows that lie equally far apart in one pass over arrays that
    keep samples of one place together. Two channels are one complex number."""
    n, samples, d = x.shape
    size = samples * n
    total, length, step = np.zeros(size), np.empty(size), np.empty(2 * size if d == 2 else size)
    flat = np.ascontiguousarray(x.transpose(1, 0, 2) if d == 2 else x.transpose(2, 1, 0)).reshape(1 if d == 2 else d, -1)
    for k in range(n, size, n):
        rest = size - k
        gap = length[:rest]
        if d == 2:
            np.subtract(flat[0, 2 * k :], flat[0, : 2 * rest], out=step[: 2 * rest])
            np.abs(step.view(complex)[:rest], out=gap)
        else:
            own = step[:rest]
            gap[:] = 0
            for channel in flat:
                np.subtract(channel[k:], channel[:rest], out=own)
                own *= own
                gap += own
            np.sqrt(gap, out=gap)
        total[:rest] += gap
    return np.ascontiguousarray(total.reshape(samples, n).T).sum(axis=1) * (2 / samples**2)


def energy_score(observed: str, weights: str, means: str, stds: str, key: str, samples: int = 256, seed: int = 0) -> Column:
    """E|X - y| - E|X - X'| / 2 in each row, over ``samples`` draws and all their ordered pairs. A
    row's draws come from the seed and its ``key`` (an integer), not from its place."""
    if samples < 2:
        raise ValueError("at least two samples are needed")

    @F.pandas_udf("double")
    def score(y: pd.Series, w: pd.Series, m: pd.Series, s: pd.Series, k: pd.Series) -> pd.Series:
        out, keys = np.zeros(len(y)), k.to_numpy().astype(np.int64)
        for rows, (own_y, own_w, own_m, own_s) in shapes(y, w, m, s):
            held = min(max(_NUMBERS // (samples * max(own_y.shape[1], 1)), _ROWS[0]), _ROWS[1])
            for a in range(0, len(rows), held):
                b = slice(a, a + held)
                out[rows[b]] = scores(own_y[b], own_w[b], own_m[b], own_s[b], keys[rows[b]], samples, seed)
        return pd.Series(out)

    return score(observed, weights, means, stds, key)
