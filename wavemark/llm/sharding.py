"""A uniform shuffle of a table into shards of exact sizes.

The communication matrix says how many rows of each input partition go to each bin; a shard is a
run of bins. Given the partitions' row counts and the bins' exact sizes, a uniformly random shuffle
makes the matrix multivariate hypergeometric, so its rows are drawn from that law: each task draws
its own by walking down a binary tree over the partitions, with generators seeded by tree node, and
no matrix is ever held anywhere. A task then permutes its rows over its bins, the rows are
exchanged once, bins in order and evenly over the tasks, and each bin is permuted again by a random
key. Bin sizes are exact, so a row's slot in its shard is the bin's known offset plus its rank in the
bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import written_table

#: numpy draws hypergeometric variates up to this population.
_MOST = 1_000_000_000


def _two_way(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric variate for any population: beyond numpy's, by inversion of the mass within
    twelve standard deviations of the mode, from ratios of neighbouring masses."""
    if good + bad < _MOST:
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = int((n + 1) * (good + 1) / (total + 2))
    spread = int(12 * np.sqrt(n * (good / total) * (bad / total) * max(total - n, 1) / (total - 1))) + 12
    low, high = max(0, n - bad, mode - spread), min(n, good, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    ratio = np.log((good - k) / (k + 1) * (n - k) / (bad - n + k + 1))
    mass = np.exp(np.concatenate([[0.0], np.cumsum(ratio)]) - max(0.0, float(np.cumsum(ratio).max(initial=0.0))))
    return low + int(np.searchsorted(np.cumsum(mass), rng.random() * mass.sum()))


def draw_counts(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows each bin gets, when every choice of places is equally likely."""
    if int(room.sum()) < _MOST:
        return rng.multivariate_hypergeometric(room, n, method="marginals")
    if len(room) == 1:
        return np.array([n], np.int64)
    half = len(room) // 2
    left = _two_way(rng, int(room[:half].sum()), int(room[half:].sum()), n)
    return np.concatenate([draw_counts(rng, room[:half], left), draw_counts(rng, room[half:], n - left)])


def matrix_row(before: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix. ``before``: rows of all partitions before each,
    and of all. The same tree of draws serves every row, so the rows add up to ``sizes``."""
    low, high, room = 0, len(before) - 1, sizes
    while high - low > 1:
        middle = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = draw_counts(rng, room, int(before[middle] - before[low]))
        low, high, room = (low, middle, left) if part < middle else (middle, high, room - left)
    return room


def even_sizes(rows: int, n: int) -> np.ndarray:
    return np.arange(n, dtype=np.int64) * 0 + rows // n + (np.arange(n) < rows % n)


def shuffle_to_shards(df: DataFrame, n_shards: int, *, seed: int = 0, rows_per_bin: int = 4096, most_bins: int = 1 << 18, stable: bool = False) -> DataFrame:
    """``df`` with ``shard`` (int, 0 to n_shards - 1) and ``slot`` (long, gapless from 0 in the
    shard). Shard sizes differ by one at most, and every assignment of rows to slots is equally
    likely. The same rows in the same partitions and the same seed give the same result.

    All columns are kept; columns of the input named ``shard`` or ``slot`` are replaced. Null
    values, repeated rows and ties need no care: rows are dealt by place, not by value. An empty
    table gives no rows; with fewer rows than shards, some shards are empty.

    The table is read twice, first for the partitions' row counts (one number for each partition
    comes to the driver). So its partitions must hold the same rows each time: a scan of files does
    (``stable=True``); anything else is written to the shared folder first. A partition whose count
    differs from the first reading fails the job rather than lose rows.
    """
    df = df.drop("shard", "slot")
    if not stable:
        df = written_table(df, "to-shard")
    kept = df.columns
    df = df.toDF(*(f"c{i}" for i in range(len(kept))))  # names that need no quotes, until the end
    counted = dict(df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    parts = max(counted, default=-1) + 1
    before = np.concatenate([[0], np.cumsum([counted.get(p, 0) for p in range(parts)])]).astype(np.int64)
    rows = int(before[-1])
    shard_sizes = even_sizes(rows, n_shards)
    per_shard = int(min(max(1, -(-rows // (n_shards * rows_per_bin))), max(1, most_bins // n_shards)))
    sizes = np.concatenate([even_sizes(int(s), per_shard) for s in shard_sizes])
    offsets = np.concatenate([np.cumsum(sizes[i : i + per_shard]) - sizes[i : i + per_shard] for i in range(0, len(sizes), per_shard)])
    shared = df.sparkSession.sparkContext.broadcast((before, sizes, offsets))
    names = df.columns
    mark = "_" + max(names, key=len, default="")
    added = [T.StructField(f"{mark}{x}", t) for x, t in (("bin", T.LongType()), ("offset", T.LongType()), ("key", T.LongType()), ("part", T.LongType()), ("at", T.LongType()))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        before, sizes, offsets = shared.value
        part, at, bins = TaskContext.get().partitionId(), 0, None
        expected = int(before[part + 1] - before[part]) if part < len(before) - 1 else 0
        for batch in batches:
            if bins is None:
                rng = np.random.default_rng([seed, 1, part])
                bins = np.repeat(np.arange(len(sizes)), matrix_row(before, sizes, part, seed)) if expected else np.zeros(0, np.int64)
                rng.shuffle(bins)
            n = batch.num_rows
            if at + n > expected:
                break
            mine = bins[at : at + n]
            key = rng.integers(-(1 << 63), (1 << 63) - 1, n, endpoint=True)
            new = [mine, offsets[mine], key, np.full(n, part), np.arange(at, at + n)]
            at += n
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, new)], [*names, *(f.name for f in added)])
        else:
            if at == expected:
                return
        raise RuntimeError(f"partition {part} held {expected} rows when they were counted, and others now")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0  # the bin that the batch before ended in, and how many of its rows came
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, offset = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.diff(bins, prepend=-1))
            ranks = np.arange(len(bins)) - np.repeat(first, np.diff(np.append(first, len(bins))))
            ranks[bins == last] += seen
            last, seen = int(bins[-1]), int(ranks[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array((bins // per_shard).astype(np.int32)), pa.array(offset + ranks)], [*names, "shard", "slot"])

    dealt = df.mapInArrow(deal, T.StructType([*df.schema.fields, *added]))
    of = [F.col(f"`{f.name}`") for f in added]
    tasks = max(1, min(len(sizes), 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = dealt.repartitionById(tasks, F.floor(of[0] * tasks / len(sizes)).cast("int")).sortWithinPartitions(of[0], *of[2:])
    return placed.select(of[0], of[1], *(F.col(f"`{n}`") for n in names)).mapInArrow(rank, T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])).toDF(*kept, "shard", "slot")
