"""Quantiles of mixture forecasts, and the coverage of central intervals.

A mixture's quantile has no closed form; it is read off a grid, in vectorised Python over Arrow
batches (as array expressions the search would be written out many times over).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .draws import shapes
from .gaussian import DENOMINATOR, FAR, NUMERATOR, ROOT_TWO_PI, SPLIT


#: Rows whose grids are held at a time.
_ROWS = 256


def normal_cdf(z: np.ndarray) -> np.ndarray:
    """The same approximation as ``gaussian.cdf``."""
    a = np.minimum(np.abs(z), FAR + 1)
    e = np.exp(-0.5 * a * a)
    with np.errstate(over="ignore"):
        near = e * np.polyval(NUMERATOR, a) / np.polyval(DENOMINATOR, a)
    far = a + 0.65
    for k in (4, 3, 2, 1):
        far = a + k / far
    tail = np.where(a > FAR, 0.0, np.where(a < SPLIT, near, e / far / ROOT_TWO_PI))
    return np.where(z > 0, 1 - tail, tail)


def mixture_cdf(x: np.ndarray, w: np.ndarray, m: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Probability at or below points ``x`` (N by D by points) of N mixtures: weights N by M, means and
    deviations N by M by D."""
    share = w / w.sum(axis=1, keepdims=True)
    return sum(share[:, k, None, None] * normal_cdf((x - m[:, k, :, None]) / s[:, k, :, None]) for k in range(w.shape[1]))


def grid_quantiles(levels: tuple[float, ...], w: np.ndarray, m: np.ndarray, s: np.ndarray, n_grid: int) -> np.ndarray:
    """Quantiles (level by row by channel) of mixtures as in ``mixture_cdf``: each channel's distribution
    function is taken as a broken line through ``n_grid`` even points, from the lowest to the highest
    component mean, eight deviations beyond, and read backwards; levels beyond its ends give these."""
    ends = np.stack([(m - 8 * s).min(axis=1), (m + 8 * s).max(axis=1)])
    grid = np.moveaxis(np.linspace(*ends, n_grid), 0, -1)
    lines = zip(mixture_cdf(grid, w, m, s).reshape(-1, n_grid), grid.reshape(-1, n_grid), strict=True)
    found = np.array([np.interp(levels, heights, points) for heights, points in lines])
    return found.T.reshape(len(levels), *ends.shape[1:])


def channel_coverage(observed: str, weights: str, means: str, stds: str, level: float = 0.9, n_grid: int = 128) -> Column:
    """1 for each channel whose observed value lies in the central interval, ends included."""
    if n_grid < 128:
        raise ValueError("n_grid must be at least 128")
    if not 0 < level < 1:
        raise ValueError("level must lie between 0 and 1")
    levels = ((1 - level) / 2, (1 + level) / 2)

    @F.pandas_udf("array<int>")
    def inside(y: pd.Series, w: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        out: list = [None] * len(y)
        for rows, (own_y, own_w, own_m, own_s) in shapes(y, w, m, s):
            for a in range(0, len(rows), _ROWS):
                b = slice(a, a + _ROWS)
                low, high = grid_quantiles(levels, own_w[b], own_m[b], own_s[b], n_grid)
                for place, hit in zip(rows[b].tolist(), ((own_y[b] >= low) & (own_y[b] <= high)).astype(np.int32), strict=True):
                    out[place] = hit
        return pd.Series(out)

    return inside(observed, weights, means, stds)
