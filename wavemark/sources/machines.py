"""Telemetry of machines in a tree of text files: train/, test/ and test_label/, a comma-separated
file for each machine in each."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import scaling, windows
from . import files

PARTS = ("train", "test", "test_label")


def _name():
    return F.url_decode(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1))


def _plain(name: str) -> str:
    """A name as it stands, where a path may hold patterns."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", name)


def _lines(spark: SparkSession, root: str, part: str, names: Sequence[str]) -> DataFrame:
    """``machine_id``, ``t``, ``n_lines`` and ``line``: the lines of each machine's file that are not
    blank, numbered from 0 in the order of the file. Only these machines' files are read.

    Spark reads a long file in byte ranges. The lines of each are counted; a range's first number is
    the sum of the counts before it, and its lines are numbered in a task of their own."""
    there = [n for n in names if files.exists(f"{root}/{part}/{n}.txt")]
    if not there:
        return spark.createDataFrame([], "machine_id string, t long, n_lines long, line string")
    read = spark.read.text([f"{root}/{part}/{_plain(n)}.txt" for n in there])
    rows = read.select(_name().alias("machine_id"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("row"), F.trim("value").alias("line")).where("line != ''")
    counts = rows.groupBy("machine_id", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("machine_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("machine_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy("machine_id")).alias("n_lines"))
    inside = F.row_number().over(Window.partitionBy("machine_id", "range").orderBy("row")) - 1
    numbered = rows.withColumn("inside", inside).join(firsts, ["machine_id", "range"])
    return numbered.select("machine_id", (F.col("first") + F.col("inside")).cast("long").alias("t"), "n_lines", "line")


def machine_ids(spark: SparkSession, root: str) -> DataFrame:
    """The machines that have all three files, in order of their names. A missing folder fails."""
    found = [spark.read.option("pathGlobFilter", "*.txt").format("binaryFile").load(f"{root}/{p}").select(_name().alias("machine_id")) for p in PARTS]
    return found[0].intersect(found[1]).intersect(found[2]).orderBy("machine_id")


def load_matrix(lines: DataFrame) -> DataFrame:
    """``machine_id``, ``group_id``, ``t``, ``x``. A file of a single line is one channel, a step for
    each of its values; one of a single column has one channel. Values that are no finite numbers
    fail."""
    rows = lines.withColumn("x", F.split("line", ",").cast("array<double>"))
    steps = F.when(F.col("n_lines") == 1, F.transform("x", lambda v, i: F.struct(i.cast("long").alias("t"), F.array(v).alias("x")))).otherwise(F.array(F.struct("t", "x")))
    return scaling.finite_rows(rows.select("machine_id", "group_id", F.explode(steps).alias("s")).select("machine_id", "group_id", "s.t", "s.x"))


def load_labels(lines: DataFrame) -> DataFrame:
    """``machine_id``, ``t``, ``label``; labels other than 0 and 1 fail, also 0.7. A single line may
    hold them all."""
    flat = lines.select("machine_id", F.col("t").alias("_line"), F.posexplode(F.split("line", ",")).alias("k", "v"))
    label = F.when(F.trim("v").isin("0", "1"), F.trim("v").cast("int")).otherwise(F.raise_error(F.lit("labels must be 0 or 1")).cast("int"))
    return flat.select("machine_id", (F.col("_line") + F.col("k")).alias("t"), label.alias("label"))


def load_machines(spark: SparkSession, root: str, ids: Sequence[str] | None = None) -> DataFrame:
    """``machine_id``, ``group_id`` (the machine's place: by name, or as given), ``split`` ('train',
    'test'), ``t``, ``x``, ``anomaly_label`` (0 in train) and ``regime_label`` (0). A machine one of
    whose files is missing or has no lines fails the job, as do test rows and labels of different
    number."""
    names = [r[0] for r in machine_ids(spark, root).collect()] if ids is None else list(ids)
    if not names:
        raise ValueError("no machines")
    machines = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "machine_id string, group_id int")

    def of(part: str) -> DataFrame:
        """The lines of a part; a machine without any keeps a row, which fails."""
        lines = _lines(spark, root, part, names)
        whole = machines.join(lines, "machine_id", "left")
        found = F.when(F.col("t").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"an empty file, or none, in {part}: "), "machine_id")).cast("boolean"))
        return whole.where(found)

    test = load_matrix(of("test")).join(load_labels(of("test_label")), ["machine_id", "t"], "full")
    whole = F.col("x").isNotNull() & F.col("label").isNotNull()
    test = test.where(F.when(whole, True).otherwise(F.raise_error(F.lit("test rows and labels differ in number")).cast("boolean")))
    train = load_matrix(of("train")).withColumn("label", F.lit(0)).withColumn("split", F.lit("train"))
    rows = train.unionByName(test.withColumn("split", F.lit("test")))
    return rows.select("machine_id", "group_id", "split", "t", "x", F.col("label").alias("anomaly_label"), F.lit(0).alias("regime_label"))


def prepare_machines(rows: DataFrame, validation: float = 0.2) -> DataFrame:
    """Scale each machine by its whole train file, then cut the train file's tail off as
    'validation'."""
    train = rows.where("split = 'train'")
    scaled = scaling.scale(rows, scaling.fit_scaler(train, ["machine_id"]), ["machine_id"])
    cut = scaling.split_tail(scaled.where("split = 'train'").drop("split"), validation, ["machine_id"])
    n = cut.where("split = 'train'").groupBy("machine_id").agg(F.count("*").alias("_n"))
    tail = cut.where("split = 'validation'").join(n, "machine_id").withColumn("t", F.col("t") - F.col("_n")).drop("_n")
    return cut.where("split = 'train'").unionByName(tail).unionByName(scaled.where("split = 'test'"))


def windowed_machines(rows: DataFrame, lookback: int, horizon: int, stride: int = 1) -> DataFrame:
    """Windows of prepared machines, rounded to 32 bits, with ``seq`` in each split: machines in
    their order, one after another."""
    from ..operators.sequence import CHUNK, numbered

    made = windows.make_windows(rows, lookback, horizon, stride, by=["split", "group_id"], single=True)
    splits = [numbered(made.where(F.col("split") == s), ["group_id"], ["start"], chunk=CHUNK) for s in ("train", "validation", "test")]
    return splits[0].unionByName(splits[1]).unionByName(splits[2])
