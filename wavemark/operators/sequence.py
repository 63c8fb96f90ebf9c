"""Windows over long dense sequences.

A sequence is numbered 0, 1, 2, ... by a column. A window over it without a partition key would put
every row in one task; here rows are dealt in chunks of the numbering, each with copies of the last
few rows of the chunk before, which is all that a trailing frame needs. Running sums take a second,
small table of one row for each chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 1 << 16


@contextmanager
def kept(df: DataFrame) -> Iterator[DataFrame]:
    """``df``, computed once for all that happens inside."""
    cached = df.cache()
    try:
        yield cached
    finally:
        cached.unpersist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` over all cores, however few bytes they are: for work that takes long
    for each row."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "seq", chunk: int | None = None) -> DataFrame:
    """Number all rows from 0 in the order of ``groups``, then ``order``: a row number in each group
    plus the rows of all groups before it. ``chunk`` cuts long groups: the first column of ``order``
    must then be a whole number, and rows that fall into one multiple of ``chunk`` are ranked
    together. The counts, a row for each group or piece of one, are added up in one task."""
    keys = list(groups)
    if chunk:
        df = df.withColumn("_piece", F.floor(F.col(order[0]) / chunk))
        keys.append("_piece")
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*keys, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_inside", inside).join(offsets, keys).withColumn(name, (F.col("_before") + F.col("_inside") - 1).cast("long")).drop("_inside", "_before", "_piece")


def trailing(df: DataFrame, seq: str, back: int, build: Callable[[WindowSpec], dict[str, Column]], by: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """Add columns that look back at most ``back`` rows: ``build`` gets the window, in the order of
    ``seq`` within ``by``."""
    if back >= chunk:
        chunk = 2 * back
    own = F.floor(F.col(seq) / chunk)
    places = F.when(F.pmod(F.col(seq), F.lit(chunk)) >= chunk - back, F.array(own, own + 1)).otherwise(F.array(own))
    spread = df.withColumn("_chunk", F.explode(places))
    window = Window.partitionBy(*by, "_chunk").orderBy(seq)
    return spread.select("*", *(c.alias(n) for n, c in build(window).items())).where(F.col("_chunk") == own).drop("_chunk")


def running_sums(df: DataFrame, seq: str, values: Mapping[str, Column], by: Sequence[str] = (), chunk: int = CHUNK, piece: Column | None = None) -> DataFrame:
    """Add, under each name, the sum of a value over all rows of the sequence up to each row.
    ``piece``: where to cut the sequence, a number that does not fall along it; by default at
    multiples of ``chunk``."""
    spread = df.select("*", *(v.alias(f"_v_{n}") for n, v in values.items()), (F.floor(F.col(seq) / chunk) if piece is None else piece).alias("_chunk"))
    totals = spread.groupBy(*by, "_chunk").agg(*(F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values))
    earlier = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_chunk", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_e_{n}") for n in values))
    upto = Window.partitionBy(*by, "_chunk").orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    inside = spread.select("*", *(F.sum(f"_v_{n}").over(upto).alias(f"_i_{n}") for n in values))
    return inside.join(totals, [*by, "_chunk"]).select(*(f"`{c}`" for c in df.columns), *((F.col(f"_i_{n}") + F.col(f"_e_{n}")).alias(n) for n in values))


def running_sum(df: DataFrame, seq: str, value: Column, name: str, by: Sequence[str] = (), chunk: int = CHUNK) -> DataFrame:
    """``running_sums`` of one value."""
    return running_sums(df, seq, {name: value}, by, chunk)
