"""All thresholds of a score at once: the component tree of a sequence.

As a threshold falls, runs of rows at or above it only grow and merge. The runs of all thresholds are
therefore the nodes of a tree, at most one for each row, and a node is a run for the thresholds from
its own lowest row down to its higher neighbour. One pass with a stack finds them; each adds its share
of true rows where it begins to be a run, and takes it off where it ends. Sums of these steps along
falling thresholds are the numbers and mean shares of runs at every threshold.

``level`` says when a row is reached: levels ascend as thresholds fall, a row of level l is predicted
from l on, and one of level infinity never.

Long sequences are cut into chunks. A chunk knows its inner runs; of those that touch an edge it keeps
the staircase of sizes by level, which is all that its neighbours need. Two neighbours' summaries make
one, in any grouping, so edges are put together in two rounds of few short rows each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sequence import CHUNK

NEVER = float("inf")
#: The level of what holds at every threshold.
ALWAYS = float("-inf")
#: Chunks whose edges one task puts together.
FAN = 4096

#: Sums by level. ``runs`` and ``share``: predicted runs and their shares of true rows. ``found``: parts
#: of true runs. ``pos``, ``neg``: rows. ``true_runs``, ``all_pos``, ``all_neg``: totals.
SUMS = ("runs", "share", "found", "pos", "neg", "true_runs", "all_pos", "all_neg")
Steps = dict[float, list[float]]
Stair = list[tuple[float, int, int]]


def _steps() -> Steps:
    return defaultdict(lambda: [0.0] * len(SUMS))


def _run(steps: Steps, first: float, last: float, size: int, hits: int) -> None:
    """A run of ``size`` rows, ``hits`` of them true, from level ``first`` up to ``last``."""
    if size and first < last:
        for level, sign in ((first, 1), (last, -1)):
            if level < NEVER:
                steps[level][0] += sign
                steps[level][1] += sign * hits / size


def _true_run(steps: Steps, size: int, levels: Iterable[tuple[float, int]]) -> None:
    steps[ALWAYS][5] += 1
    for level, n in levels:
        if level < NEVER:
            steps[level][2] += n / size


@dataclass
class Edges:
    """What the neighbours of a stretch of ``size`` rows, ``hits`` of them true, need to know.
    ``left``: (level, size, hits) of the predicted run at its left edge, for each level at which
    that grows; ``right`` likewise; both end with the whole stretch. ``first`` and ``last``: rows by
    level of the true runs at its edges; both the same, and ``full``, if all rows are true."""

    size: int
    hits: int
    left: Stair = field(default_factory=list)
    right: Stair = field(default_factory=list)
    first: dict[float, int] = field(default_factory=dict)
    last: dict[float, int] = field(default_factory=dict)

    @property
    def full(self) -> bool:
        return self.hits == self.size


def stretch(levels: Sequence[float], truth: Sequence[int], steps: Steps) -> Edges:
    """The edges of consecutive rows; their inner runs go to ``steps``."""
    top, sizes, hits, left = [], [], [], []  # runs that reach the last row so far, the widest first
    for level, true in zip(levels, truth, strict=True):
        n, h = 0, 0
        while top and top[-1] < level:
            own, n, h = top.pop(), n + sizes.pop(), h + hits.pop()
            if top:
                _run(steps, own, min(top[-1], level), n, h)
            else:
                left.append((own, n, h))
        if top and top[-1] == level:
            sizes[-1] += n + 1
            hits[-1] += h + true
        else:
            top.append(level)
            sizes.append(n + 1)
            hits.append(h + true)
    right, n, h = [], 0, 0
    while top:
        n, h = n + sizes.pop(), h + hits.pop()
        right.append((top.pop(), n, h))
    made = Edges(n, h, [*left, right[-1]], right)
    _rows(np.asarray(levels, float), np.asarray(truth, np.int8), steps, made)
    return made


def _counts(levels: np.ndarray) -> dict[float, int]:
    values, n = np.unique(levels, return_counts=True)
    return dict(zip(values.tolist(), n.tolist(), strict=True))


def _rows(levels: np.ndarray, truth: np.ndarray, steps: Steps, made: Edges) -> None:
    """Rows by level, and true runs: the inner ones to ``steps``, the others to the edges."""
    for column, flags in ((3, truth == 1), (4, truth == 0)):
        for level, n in _counts(levels[flags]).items():
            if level < NEVER:
                steps[level][column] += n
        steps[ALWAYS][column + 3] += int(flags.sum())
    edges = np.flatnonzero(np.diff(truth, prepend=0, append=0))
    begins, ends = edges[::2], edges[1::2]
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        own = _counts(levels[a:b])
        if a == 0:
            made.first = own
        if b == len(truth):
            made.last = own
        if a and b < len(truth):
            _true_run(steps, b - a, own.items())


def _across(right: Stair, left: Stair, stop: float) -> Iterator[tuple[float, int, int]]:
    """(level, size, hits) of the run that two stairs make together, below the level ``stop``."""
    at = [0, 0]
    for level in sorted({m for m, _, _ in [*right, *left] if m < stop}):
        for k, stair in enumerate((right, left)):
            while at[k] < len(stair) and stair[at[k]][0] <= level:
                at[k] += 1
        a, b = (stair[i - 1] if i else (level, 0, 0) for stair, i in zip((right, left), at, strict=True))
        yield level, a[1] + b[1], a[2] + b[2]


def _closed(steps: Steps, stairs: Iterator[tuple[float, int, int]], stop: float) -> None:
    for (a, n, h), (b, _, _) in pairwise([*stairs, (stop, 0, 0)]):
        _run(steps, a, b, n, h)


def _grown(whole: tuple[float, int, int], stair: Stair, near: Stair) -> Stair:
    """The stair ``near``, of which ``whole`` is the last step, that goes on with the neighbour's."""
    top, size, hits = whole
    inside = [s for s in stair if s[0] <= top]
    base = inside[-1] if inside else (top, 0, 0)
    return [*near[:-1], (top, size + base[1], hits + base[2]), *((m, size + n, hits + h) for m, n, h in stair if m > top)]


def _added(a: dict[float, int], b: dict[float, int]) -> dict[float, int]:
    return {k: a.get(k, 0) + b.get(k, 0) for k in {**a, **b}}


def joined(a: Edges, b: Edges, steps: Steps) -> Edges:
    """The edges of two neighbours as one; runs across their border that end on both sides go to
    ``steps``."""
    stop = min(a.right[-1][0], b.left[-1][0])
    _closed(steps, _across(a.right, b.left, stop), stop)
    middle = _added(a.last, b.first)
    first, last = a.first, b.last
    if middle and not a.full and not b.full:
        _true_run(steps, sum(middle.values()), middle.items())
    if a.full:
        first = middle
    if b.full:
        last = middle
    return Edges(a.size + b.size, a.hits + b.hits, _grown(a.left[-1], b.left, a.left), _grown(b.right[-1], a.right, b.right), first, last)


def ended(a: Edges, steps: Steps) -> None:
    """Nothing comes before or after: what touches an edge ends there."""
    stop = a.left[-1][0]
    for stair in (a.left, a.right):
        _closed(steps, iter(stair[:-1]), stop)
    _run(steps, stop, NEVER, a.size, a.hits)
    for own in (a.first,) if a.full else (a.first, a.last):
        if own:
            _true_run(steps, sum(own.values()), own.items())


_STAIRS = ("left", "right", "first", "last")
_PARTS = (("level", "double"), ("size", "bigint"), ("hits", "bigint"))
_DDL = ", ".join(["chunk bigint", "level double", *(f"{c} double" for c in SUMS), "size bigint", "hits bigint", *(f"{s}_{c} array<{t}>" for s in _STAIRS for c, t in _PARTS)])
_ARROW = {"double": pa.float64(), "bigint": pa.int64()}
_SCHEMA = pa.schema([(n, pa.list_(_ARROW[t[6:-1]]) if t.startswith("array") else _ARROW[t]) for n, t in (c.split(" ") for c in _DDL.split(", "))])


def _table(chunk: int, steps: Steps, edges: Edges | None) -> pa.Table:
    """A row for each level of ``steps``, and one for the edges, which alone has a size."""
    rows = [{"chunk": chunk, "level": level, **dict(zip(SUMS, own, strict=True))} for level, own in steps.items()]
    if edges is not None:
        row = {"chunk": chunk, "size": edges.size, "hits": edges.hits}
        stairs = {"left": edges.left, "right": edges.right, **{s: [(m, n, 0) for m, n in getattr(edges, s).items()] for s in ("first", "last")}}
        for name, stair in stairs.items():
            for k, (c, _) in enumerate(_PARTS):
                row[f"{name}_{c}"] = [x[k] for x in stair]
        rows.append(row)
    return pa.Table.from_pylist(rows, _SCHEMA)


def _edges(row: dict) -> Edges:
    stair = lambda s: list(zip(*(row[f"{s}_{c}"] for c, _ in _PARTS), strict=True))
    return Edges(row["size"], row["hits"], stair("left"), stair("right"), *({m: n for m, n, _ in stair(s)} for s in ("first", "last")))


def _round(parts: DataFrame, fan: int | None) -> DataFrame:
    """Edges of ``fan`` neighbours as one (of all, and ended, without a number). Steps pass through,
    dealt over tasks as they are over chunks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["_key"])
        if not table["size"][0].is_valid:
            return table
        rows, steps = table.sort_by("chunk").to_pylist(), _steps()
        whole = _edges(rows[0])
        for row in rows[1:]:
            whole = joined(whole, _edges(row), steps)
        if fan is None:
            ended(whole, steps)
        return _table(rows[0]["chunk"] // (fan or 1), steps, whole if fan else None)

    own = F.floor(F.col("chunk") / fan) if fan else F.lit(0).cast("long")
    key = F.when(F.col("size").isNotNull(), own).otherwise(-1 - F.col("chunk"))
    return parts.withColumn("_key", key).groupBy("_key").applyInArrow(run, _DDL)


def level_steps(df: DataFrame, level: Column, truth: Column, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """``level`` and its SUMS, for each level at which one of them changes. ``seq`` counts 0, 1, 2,
    ... without gaps; ``level`` is a double that is never null, ``truth`` 0 or 1. Rows are exchanged
    once, by chunk. An empty table gives no rows.

    The edges of a chunk have a step for each level at which the run at its edge grows: at most as
    many as there are levels, and about the logarithm of the chunk's rows if scores come in random
    order; a sequence that only rises or falls has as many as rows."""

    def run(table: pa.Table) -> pa.Table:
        table, steps = table.sort_by("_s"), _steps()
        edges = stretch(table["_l"].to_pylist(), table["_t"].to_pylist(), steps)
        return _table(table["_chunk"][0].as_py(), steps, edges)

    rows = df.select(F.col(seq).alias("_s"), level.alias("_l"), truth.cast("int").alias("_t"), F.floor(F.col(seq) / chunk).alias("_chunk"))
    parts = rows.groupBy("_chunk").applyInArrow(run, _DDL)
    merged = _round(_round(parts, FAN), None)
    return merged.groupBy("level").agg(*(F.sum(c).alias(c) for c in SUMS))


def with_rates(sums: DataFrame) -> DataFrame:
    """Range precision, recall and f1 and the pointwise counts of sums up to each level. Without
    runs, predicted or true, precision and recall are 1; with runs on the other side only, 0."""
    p, r = F.try_divide("share", "runs"), F.try_divide("found", "true_runs")
    neither = (F.col("runs") == 0) & (F.col("true_runs") == 0)
    value = lambda x: F.when(neither, 1.0).otherwise(F.coalesce(x, F.lit(0.0)))
    long = lambda c: F.round(c).cast("long")
    found = sums.withColumns({"precision": value(p), "recall": value(r), "tp": long(F.col("pos")), "fp": long(F.col("neg")), "tn": long(F.col("all_neg") - F.col("neg")), "fn": long(F.col("all_pos") - F.col("pos"))})
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0)
    return found.withColumns({"f1": f1, "fpr": F.coalesce(F.try_divide("neg", "all_neg"), F.lit(0.0))})


def at_candidates(steps: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """The sums up to each of at most 64 candidates, whose numbers are the levels: ``cand_ix``,
    ``threshold`` and SUMS."""
    own = steps.sparkSession.createDataFrame(list(enumerate(map(float, thresholds))), "cand_ix int, threshold double")
    table = own.withColumn("level", F.col("cand_ix").cast("double")).join(steps, "level", "full")
    upto = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    sums = table.select("cand_ix", "threshold", *(F.coalesce(F.sum(c).over(upto), F.lit(0.0)).alias(c) for c in SUMS))
    # What is left of runs that have ended is rounding; their number is exact.
    return sums.where("cand_ix is not null").withColumn("share", F.when(F.col("runs") == 0, 0.0).otherwise(F.col("share")))
