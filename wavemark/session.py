"""Sessions, and the package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; ``conf`` overrides them
    (``spark_sql_shuffle_partitions="64"`` sets ``spark.sql.shuffle.partitions``)."""
    builder = SparkSession.builder.appName("wavemark")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context."""
    context = spark.sparkContext
    if getattr(context, "_wavemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="wavemark-"), "wavemark.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    context._wavemark_shipped = True
