"""The folder that the driver and all executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, all tasks must run in this
    process (tests, one machine): then a temporary folder is made and set as the context's
    checkpoint folder; on a cluster that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written_table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends here, and
    a lost executor costs no recomputation of what is above."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def place(scan: DataFrame) -> Column:
    """What tells each row of a scan of Parquet files apart, the same however the files are split
    and however often they are read: a struct of a hash of the file's path and the row's number in
    the file."""
    said = scan.metadataColumn("_metadata")
    return F.struct(F.xxhash64(said["file_path"]).alias("file"), said["row_index"].alias("row"))
