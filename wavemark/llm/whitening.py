"""Embedding whitening with an exact covariance, by digit-slice matrix products.

Vectors become whole numbers x. Their sums and products are gathered exactly:

* A block of vectors is split into limbs of LIMB bits. Limbs are below 2^LIMB, so a product of two
  slices over a block of BLOCK rows stays below 2^53 and BLAS, in float64, gives it without rounding.
* The products of all pairs of slices are shifted and added as whole numbers of any size, first over
  a task's blocks, then over all tasks: these numbers travel as base-2^32 digits, which Spark adds up
  by entry. What comes to the driver has a row for each pair of dimensions, however many vectors
  there are.
* n * sum(x_i x_j) - sum(x_i) sum(x_j) is then the sum of products of centred vectors, times n,
  without any rounding; one division gives each entry of the covariance, correctly rounded.

The eigenvectors of that matrix whiten the vectors in a second pass over them, a third one measures
what came out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written_table

LIMB = 18
#: Rows of a block: 2 * LIMB bits and these make 53.
BLOCK = 1 << (53 - 2 * LIMB)
_DIGIT = 32
#: Digits of a sum of products: 2 * 63 bits, and 2^31 rows for each task.
_DIGITS = 6
#: Numbers beyond count as this one, so that differences still have 64 bits.
_TOP = 1 << 61


def grid(vectors: np.ndarray, scale: float, shift: int) -> np.ndarray:
    """floor(scale * c) + shift as 64-bit numbers; numbers beyond these are the outermost ones."""
    floors = np.floor(vectors * scale)
    inside = np.abs(floors) < _TOP
    x = np.where(inside, floors, 0).astype(np.int64) + shift
    return np.where(inside, x, np.where(floors > 0, _TOP, -_TOP))


def slices(x: np.ndarray) -> list[np.ndarray]:
    """``x`` in limbs of LIMB bits, lowest first, as float64; the last one has the sign."""
    out, rest = [], x
    while True:
        if not len(rest) or (rest.max() < 1 << LIMB and rest.min() >= -(1 << LIMB)):
            return [*out, rest.astype(np.float64)]
        out.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB


def exact_gram(x: np.ndarray) -> np.ndarray:
    """The sum of outer products of the rows of ``x`` (int64), as a matrix of Python's numbers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    for at in range(0, len(x), BLOCK):
        limbs = slices(x[at : at + BLOCK])
        for k, low in enumerate(limbs):
            for m, high in enumerate(limbs[: k + 1]):
                part = (low.T @ high).astype(np.int64).astype(object)
                total += (part if m == k else part + part.T) * (1 << (LIMB * (k + m)))
    return total


def exact_sums(x: np.ndarray) -> np.ndarray:
    """The sums of the columns of ``x``, as Python's numbers."""
    low, high = x & ((1 << 31) - 1), x >> 31
    return low.sum(axis=0).astype(object) + high.sum(axis=0).astype(object) * (1 << 31)


def digits(value: int) -> list[int]:
    """``value`` in base 2^32, lowest first; the last digit has the sign."""
    out = [(value >> (_DIGIT * k)) & ((1 << _DIGIT) - 1) for k in range(_DIGITS - 1)]
    return [*out, value >> (_DIGIT * (_DIGITS - 1))]


def number(parts: list[int]) -> int:
    return sum(int(d) << (_DIGIT * k) for k, d in enumerate(parts))


def matrices(lists: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of a batch that are whole vectors of ``width`` finite numbers: their places, and
    the vectors as float64, some megabytes at a time."""
    rows = max(1, (1 << 20) // width)
    for first in range(0, len(lists), rows):
        part = lists.slice(first, rows)
        good = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(part), width), False).to_numpy(zero_copy_only=False))
        flat = part.take(pa.array(good)).flatten().cast(pa.float64())
        vectors = flat.to_numpy(zero_copy_only=False).reshape(-1, width)  # nulls are NaN here
        whole = np.isfinite(vectors).all(axis=1)
        yield good[whole] + first, vectors[whole]


@dataclass(frozen=True)
class Whitening:
    """What maps vectors: the number ``n`` of fitted vectors, the exact ``sums`` of their whole
    numbers, the covariance's ``values`` (falling) and unit ``vectors`` (one for each row)."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    scale: float
    shift: int

    @property
    def width(self) -> int:
        return len(self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """The components of rows of whole numbers; NaN for a component without variance. The mean
        is taken off in two parts, so that large means leave no rounding."""
        whole = [s // self.n for s in self.sums]
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        centred = (x - np.array(whole, np.int64)).astype(np.float64) - rest
        spread = np.where(self.values > 0, self.values, np.nan)
        return centred @ self.vectors.T / np.sqrt(spread)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S)^2 of each row, exact."""
        if not len(x):
            return []
        far = max(abs(int(x.max())), abs(int(x.min())))
        kind = np.int64 if self.n * far + max(map(abs, self.sums)) < 2**63 else object
        y = x.astype(kind) * self.n - np.array(self.sums, kind)
        widest = max(abs(int(y.max())), abs(int(y.min())))
        y = y.astype(np.int64 if widest * widest * self.width < 2**63 else object)
        return (y * y).sum(axis=1).tolist()


def whole_vector(vector: Column) -> Column:
    """True for vectors without null and non-finite entries; false for null."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")) & ~F.isnan(c.cast("double")))
    return F.coalesce(finite, F.lit(False))


def dimension(df: DataFrame, vector: str) -> int | None:
    """The length of most whole vectors (of several such lengths the greatest); null without any."""
    counts = df.where(whole_vector(F.col(vector))).groupBy(F.size(vector).alias("width")).agg(F.count("*").alias("n"))
    best = counts.agg(F.max(F.struct("n", "width")).alias("best")).first()["best"]
    return None if best is None else best["width"]


def _gathered(df: DataFrame, vector: str, width: int, scale: float, shift: int) -> tuple[int, list[int], np.ndarray]:
    """The number of vectors, and the exact sums and products of their whole numbers."""
    upper = [(i, j) for i in range(width) for j in range(i, width)]
    schema = "i int, j int, " + ", ".join(f"d{k} long" for k in range(_DIGITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, gram = 0, np.zeros(width, object), np.zeros((width, width), object)
        waiting, held = [], 0

        def add() -> None:
            nonlocal gram, waiting, held
            if waiting:
                gram = gram + exact_gram(np.concatenate(waiting))
            waiting, held = [], 0

        for batch in batches:
            for _, vectors in matrices(batch.column(0), width):
                x = grid(vectors, scale, shift)
                n, sums = n + len(x), sums + exact_sums(x)
                waiting.append(x)
                held += x.size
                if held > 1 << 21:
                    add()
        add()
        if n:
            rows = [(-1, -1, n), *((-1, j, int(s)) for j, s in enumerate(sums)), *((i, j, int(gram[i, j])) for i, j in upper)]
            flat = np.array([digits(v) for _, _, v in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(flat[:, k]) for k in range(_DIGITS))], ["i", "j", *(f"d{k}" for k in range(_DIGITS))])

    parts = df.select(vector).mapInArrow(run, schema)
    n, sums, gram = 0, [0] * width, np.zeros((width, width), object)
    for row in parts.groupBy("i", "j").agg(*(F.sum(f"d{k}").alias(f"d{k}") for k in range(_DIGITS))).collect():
        value = number(row[2:])
        if row["j"] < 0:
            n = value
        elif row["i"] < 0:
            sums[row["j"]] = value
        else:
            gram[row["i"], row["j"]] = gram[row["j"], row["i"]] = value
    return n, sums, gram


def fit_whitening(df: DataFrame, *, components: int = 8, vector: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> Whitening | None:
    """The whitening of all whole vectors of ``df`` of its most frequent length; null if there are
    none, or they have no dimension. The driver holds numbers by pairs of dimensions alone."""
    width = dimension(df, vector)
    if not width:
        return None
    n, sums, gram = _gathered(df, vector, width, scale, shift)
    centred = gram * n - np.outer(np.array(sums, object), np.array(sums, object))
    covariance = np.array([[int(v) / (n * n) for v in row] for row in centred], np.float64)
    values, vectors = np.linalg.eigh(covariance)
    trace = sum(int(centred[i, i]) for i in range(width)) / (n * n)
    values, vectors = values[::-1][:components], vectors.T[::-1][:components]
    none = values <= width * np.finfo(np.float64).eps * max(float(values[0]), 0.0)
    return Whitening(n, sums, trace, np.where(none, 0.0, values), vectors, scale, shift)


def identity_error(df: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the covariance of all whitened vectors less the identity, over
    the components that have variance. The vectors are centred before they are multiplied; what
    rounding leaves of their mean is taken off too."""
    k = len(model.values)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = [f"m{i}" for i in range(k)] + [f"p{i}_{j}" for i, j in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(names))
        for batch in batches:
            for _, vectors in matrices(batch.column(0), model.width):
                w = model.whiten(grid(vectors, model.scale, model.shift))
                product = w.T @ w
                total += np.concatenate([w.sum(axis=0), [product[i, j] for i, j in pairs]])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names)

    sums = df.select(vector).mapInArrow(run, ", ".join(f"{c} double" for c in names)).agg(*(F.sum(c).alias(c) for c in names)).first()
    mean = [sums[f"m{i}"] / model.n for i in range(k)]
    errors = [abs(sums[f"p{i}_{j}"] / model.n - mean[i] * mean[j] - (i == j)) for i, j in pairs]
    return float(np.nanmax(errors)) if not np.isnan(errors).all() else 0.0


def whiten_vectors(df: DataFrame, *, components: int = 8, id_col: str = "vec_id", vector: str = "embedding", scale: float = 1024.0, shift: int = 100_000, stable: bool = False) -> DataFrame:
    """A row for each whole vector of ``df`` and each component, from 1: the id under its own name,
    ``component``, ``n`` (fitted vectors), ``deviation`` (decimal, exact; null from 10^38 on),
    ``whitened``, ``explained`` (the component's share of the variance) and ``identity_error`` (one
    value: how far the covariance of all whitened vectors is from the identity).

    Vectors that are null, or hold null or non-finite entries, are left out, and so are vectors of
    another length than most have. Entries beyond 64-bit whole numbers count as the outermost of
    these. With fewer dimensions there are fewer components. A component without variance (equal
    vectors, one vector) has null ``whitened`` and an ``explained`` of 0, or null if none has any.
    Each row stands for itself: ids may be null or repeated, other columns are not read. Without
    whole vectors there are no rows.

    ``df`` is read four times and must give the same rows each time: ``stable=True`` says that it
    does (a scan of files), else it is first written to the shared folder."""
    rows = df.select(df[id_col].alias("row_id"), df[vector].alias("vector"))
    rows = rows if stable else written_table(rows, "vectors")
    schema = T.StructType([T.StructField(id_col, rows.schema["row_id"].dataType), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType())])
    model = fit_whitening(rows, components=components, vector="vector", scale=scale, shift=shift)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(rows, model, "vector"), len(model.values)
    shares = model.values / model.trace if model.trace > 0 else np.full(k, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            for places, vectors in matrices(batch.column("vector"), model.width):
                x = grid(vectors, model.scale, model.shift)
                exact = pa.array([Decimal(v) if v < 10**38 else None for v in model.deviations(x)], pa.decimal128(38, 0))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                ids = batch.column("row_id").take(pa.array(places))
                m = len(each)
                columns = [
                    ids.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(m, model.n, np.int64)), exact.take(each),
                    pa.array(model.whiten(x).ravel(), from_pandas=True), pa.array(np.tile(shares, len(x)), from_pandas=True), pa.array(np.full(m, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)
