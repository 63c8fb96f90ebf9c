"""Toxicity scores by a factorization machine over hashed terms.

Terms of a text are its words, lower-case and without marks at their ends, and the words' first
characters (insults appear inside compounds); each is hashed into a fixed number of buckets, and a
text is the set of its buckets. The machine adds to a linear score a weight for every pair of
buckets, the product of their short vectors, so that an insult next to a mention of a group can
weigh more than either. It is fitted to a bounded sample; buckets that tell nothing about the label
there have no weight, so a long text does not gather noise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, labelled_sample
from .rows import as_struct, unpacked
from .tokens import text_slices

BUCKETS = 1 << 18
PREFIX = 5
_ENDS = b"\"'`.,;:!?()[]{}<>#*$%&|~_-+=/\\"


def term_buckets(word: bytes) -> tuple[int, ...]:
    """The buckets of a word's terms: the word and its beginning."""
    word = word.strip(_ENDS)
    if not word:
        return ()
    text = word.decode("utf-8", "replace")
    return tuple({xxhash.xxh64_intdigest(t.encode(), seed) % BUCKETS for t, seed in ((text, 0), (text[:PREFIX], 1))})


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


@dataclass(frozen=True)
class Machine:
    buckets: np.ndarray  # sorted; the features are their positions
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, features: np.ndarray) -> float:
        """The probability of label 1 for a set of features."""
        v = self.vectors[features]
        total = self.bias + float(self.weights[features].sum()) + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


class _Features(dict):
    """The features of a word, as a number: 0 for none, else a place in ``sets``."""

    def __init__(self, buckets: np.ndarray, limit: int = 200_000):
        super().__init__({b"": 0})
        self.at, self.limit, self.sets = {int(b): i for i, b in enumerate(buckets)}, limit, [np.zeros(0, np.int64)]

    def __missing__(self, word: bytes) -> int:
        own = [self.at[b] for b in term_buckets(word) if b in self.at]
        number = 0
        if own:
            number = len(self.sets)
            self.sets.append(np.array(own))
        if own or len(self) < self.limit:
            self[word] = number
        return number

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        known = np.unique(numbers[numbers > 0])
        return np.unique(np.concatenate([self.sets[k] for k in known])) if len(known) else self.sets[0]


def informative(rows: list[np.ndarray], y: np.ndarray, most: int, least: int) -> np.ndarray:
    """The buckets that tell most about the label, by the log-likelihood ratio of their presence,
    among those in ``least`` rows or more."""
    flat, label = np.concatenate(rows), np.repeat(y, [*map(len, rows)])
    a = np.bincount(flat[label == 1], minlength=BUCKETS).astype(float)
    b = np.bincount(flat[label == 0], minlength=BUCKETS).astype(float)
    pos, n = y.sum(), len(y)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    there = a + b
    gain = part(a, there * pos / n) + part(b, there * (n - pos) / n) + part(pos - a, (n - there) * pos / n) + part(n - pos - b, (n - there) * (n - pos) / n)
    gain[there < least] = 0
    best = np.argsort(-gain, kind="stable")[:most]
    return np.sort(best[gain[best] > 6.0])


def gradient(x: np.ndarray, y: np.ndarray, importance: np.ndarray, params: list[np.ndarray], decay: float) -> list[np.ndarray]:
    """The gradient, by bias, weights and vectors, of the logistic loss of rows of 0/1 features,
    each times its importance, plus half of ``decay`` times the squares of weights and vectors. In
    a row's score every pair of features counts once: half of the squared sum less the squares."""
    bias, w, v = params
    sums = x @ v
    total = bias + x @ w + 0.5 * ((sums**2).sum(axis=1) - x @ (v**2).sum(axis=1))
    error = (1 / (1 + np.exp(-np.clip(total, -30, 30))) - y).astype(x.dtype) * importance
    return [np.array([error.sum()]), x.T @ error + decay * w, x.T @ (error[:, None] * sums) - v * (x.T @ error)[:, None] + decay * v]


def fit_machine(rows: list[np.ndarray], y: np.ndarray, *, factors: int = 4, most: int = 512, least: int = 6, steps: int = 150, rate: float = 0.05, decay: float = 2e-5, weight: float = 2.0, seed: int = 5) -> Machine:
    """Full-batch Adam on the logistic loss, in which a row of label 1 counts ``weight`` times.
    ``rows``: the buckets of each text. Without rows of
    both labels the machine gives every text the share of label 1 (0 without rows)."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
        return Machine(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))
    buckets = informative(rows, y, most, least)
    x = np.zeros((len(rows), len(buckets)), np.float32)
    for i, row in enumerate(rows):
        x[i, np.searchsorted(buckets, row[np.isin(row, buckets)])] = 1
    importance = (np.where(y == 1, weight, 1.0) / len(y)).astype(np.float32)
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(y.mean() / (1 - y.mean()))], np.float32), np.zeros(len(buckets), np.float32), rng.normal(0, 0.05, (len(buckets), factors)).astype(np.float32)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    for step in range(1, steps + 1):
        for p, g, (m, s) in zip(params, gradient(x, y, importance, params, decay), moments, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return Machine(buckets, float(params[0][0]), params[1].astype(float), params[2].astype(float))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = 12_000, **options) -> Machine:
    """A machine learnt from at most ``sample`` labelled rows, none of them held out. Only the
    sampled texts' bucket numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column("text")):
                rows = [sorted({x for w in set(words_of(t)) for x in term_buckets(w)}) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("label").slice(a, b - a), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "label", "buckets"])

    chosen = labelled_sample(docs, labels, label, sample, learn_only=True)
    schema = T.StructType([chosen.schema["doc_id"], T.StructField("label", T.IntegerType()), T.StructField("buckets", T.ArrayType(T.IntegerType()))])
    got = chosen.mapInArrow(run, schema).toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    lists = got["buckets"].combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows = [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return fit_machine(rows, got["label"].to_numpy().astype(float), **options)


def score(machine: Machine, text: Column) -> Column:
    """The probability of label 1 for a text; only texts go to Python. The model is a fixed number
    of weights, whatever the input."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = _Features(machine.buckets)
        for batch in batches:
            yield pa.array([machine.score(features.of(t)) for _, _, texts in text_slices(batch) for t in texts], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "double")(text.cast("string"))


def score_toxicity(df: DataFrame, machine: Machine, *, threshold: float = 0.3, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, unchanged, with ``score`` (0 to 1, higher: label 1 likelier) and
    ``predicted`` (1 at ``threshold`` and above, else 0); where a kept column has such a name, the
    added one gets an underscore behind it. Every row gives one row, also repeated rows and null
    ids; a null or empty text has the score of no terms. An empty table gives no rows."""
    own = df.select(as_struct(keep).alias("row"), score(machine, F.col(f"`{text_col}`")).alias("score"))
    return unpacked(own.withColumn("predicted", (F.col("score") >= threshold).cast("int")), "row", ("score", "predicted"))


def without_toxic(df: DataFrame, machine: Machine, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that score below ``threshold``, each as it is."""
    return df.where(score(machine, F.col(f"`{text_col}`")) < threshold)


__all__ = ["Machine", "fit_machine", "fit_toxicity", "held_out", "score_toxicity", "without_toxic"]
