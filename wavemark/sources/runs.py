"""Runs on disk: their artifacts, metrics and manifests, and tables that compare them.

A run is a folder on any file system that Spark can write to: tables ``forecast``, ``scores`` (by
split), ``regimes`` and ``scaler`` as Parquet, and small JSON files. Each of them appears whole or not
at all. Comparing reads the JSON files of any number of runs by Spark.
"""

from __future__ import annotations

import csv
import io
import json
import math
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files

LEADING = ("run_dir", "manifest.run_id", "manifest.pipeline")


@dataclass(frozen=True)
class RunManifest:
    run_id: str
    pipeline: str
    dataset: str
    seed: int | None = None
    notes: str | None = None

    def check(self) -> None:
        if not (self.run_id and self.pipeline and self.dataset):
            raise ValueError("run_id, pipeline and dataset must not be empty")


def json_ready(value):
    """Keys as text, and null for numbers that are not finite."""
    if isinstance(value, Mapping):
        return {str(k): json_ready(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [json_ready(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def write_json(path: str, value) -> None:
    files.write_text(path, json.dumps(json_ready(value), indent=2, sort_keys=True))


def write_manifest(path: str, manifest: RunManifest) -> None:
    manifest.check()
    write_json(path, asdict(manifest))


def read_manifest(path: str) -> RunManifest:
    said = json.loads(files.read_text(path))
    seed, notes = said.get("seed"), said.get("notes")
    return RunManifest(str(said["run_id"]), str(said["pipeline"]), str(said["dataset"]), None if seed is None else int(seed), None if notes is None else str(notes))


def prepare_folder(path: str, overwrite: bool = False) -> None:
    """A folder for a run: a non-empty one is an error, unless overwritten (other files stay)."""
    if files.is_folder(path) and files.names(path) and not overwrite:
        raise FileExistsError(path)
    files.make_folder(path)


def write_table(df: DataFrame, run_dir: str, name: str, by: str | None = None) -> None:
    """An artifact of a run: ``forecast``, ``scores`` (``by='split'``), ``regimes`` or ``scaler``."""
    with files.replacing(f"{run_dir}/{name}") as hidden:
        (df.write.partitionBy(by) if by else df.write).parquet(hidden)


def read_table(spark: SparkSession, run_dir: str, name: str) -> DataFrame | None:
    """An artifact, or None if the run does not have it."""
    return spark.read.parquet(f"{run_dir}/{name}") if files.is_folder(f"{run_dir}/{name}") else None


def flat_columns(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """The leaves of nested columns, by dotted names."""
    out = []
    for f in schema.fields:
        out += flat_columns(f.dataType, f"{prefix}{f.name}.") if isinstance(f.dataType, T.StructType) else [(f"{prefix}{f.name}", f.dataType)]
    return out


def flatten(df: DataFrame, prefix: str = "") -> DataFrame:
    """Nested columns as columns with dotted names; arrays as JSON text."""
    made = []
    for name, kind in flat_columns(df.schema):
        column = F.col(".".join(f"`{p}`" for p in name.split(".")))
        made.append((F.to_json(column) if isinstance(kind, (T.ArrayType, T.MapType)) else column).alias(prefix + name))
    return df.select(*made)


def _found(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The paths of all files of a name under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")


def _json_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).option("multiLine", True).json(root)
    folder = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/+", "/"), r"/[^/]*$", "")
    return read.withColumn("run_dir", folder)


def collect_runs(spark: SparkSession, root: str) -> DataFrame:
    """A row for each folder under ``root`` with a metrics.json: ``run_dir``, the metrics, and the
    manifest's fields where there is one, in the order of ``comparison_columns``."""
    if files.exists(root) and not files.is_folder(root):
        raise ValueError("runs are folders")
    metrics = _json_files(spark, root, "metrics.json")
    flat = flatten(metrics)
    if not _found(spark, root, "manifest.json").isEmpty():
        said = _json_files(spark, root, "manifest.json")
        own = said.select(F.col("run_dir"), *(F.col(c).alias(f"manifest.{c}") for c in said.columns if c != "run_dir"))
        flat = flat.join(own, "run_dir", "left")
    return flat.select(*(f"`{c}`" for c in comparison_columns(flat.columns))).orderBy("run_dir")


def comparison_columns(names: list[str]) -> list[str]:
    """The leading columns first, the rest by name."""
    return [c for c in LEADING if c in names] + sorted(c for c in names if c not in LEADING)


def comparison_table(frames: list[DataFrame]) -> DataFrame:
    """All rows under all columns, nulls where a frame lacks one."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.select(*(f"`{c}`" for c in comparison_columns(merged.columns)))


def write_comparison(df: DataFrame, path: str) -> None:
    """One CSV or JSON file, by the path's ending. A comparison has a row for each run."""
    rows, names = [r.asDict() for r in df.collect()], df.columns
    if path.endswith(".json"):
        write_json(path, rows)
    elif path.endswith(".csv"):
        out = io.StringIO()
        writer = csv.DictWriter(out, names)
        writer.writeheader()
        writer.writerows({k: "" if v is None else v for k, v in r.items()} for r in rows)
        files.write_text(path, out.getvalue())
    else:
        raise ValueError("a comparison is written as .csv or .json")
