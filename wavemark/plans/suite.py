"""Suites: lists of jobs, each a pipeline with parameters, run one after another."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import SparkSession

from ..sources import runs
from .pipelines import PIPELINES, configured


@dataclass(frozen=True)
class SuiteJob:
    run_id: str
    pipeline: str
    dataset: str
    params: dict = field(default_factory=dict)
    notes: str | None = None

    def check(self) -> None:
        if not self.run_id:
            raise ValueError("a job needs a run_id")
        if self.pipeline not in PIPELINES:
            raise ValueError(f"unknown pipeline {self.pipeline!r}; choose one of {', '.join(sorted(PIPELINES))}")
        configured(self.pipeline, self.params)


@dataclass(frozen=True)
class Suite:
    name: str
    jobs: tuple[SuiteJob, ...]

    def check(self) -> None:
        ids = [j.run_id for j in self.jobs]
        if not self.name or not ids or len(set(ids)) < len(ids):
            raise ValueError("a suite needs a name, and jobs with run_ids of their own")
        for job in self.jobs:
            job.check()


def load_suite(path: str) -> Suite:
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    jobs = tuple(SuiteJob(str(j["run_id"]), str(j["pipeline"]), str(j.get("dataset", j["pipeline"])), dict(j.get("params", {})), j.get("notes")) for j in said["jobs"])
    return Suite(str(said["name"]), jobs)


def with_overrides(suite: Suite, overrides: Mapping) -> Suite:
    return replace(suite, jobs=tuple(replace(j, params={**j.params, **overrides}) for j in suite.jobs))


def run_suite(spark: SparkSession, suite: Suite, output_root: str, *, compare: str | None = None, overwrite: bool = False) -> list[str]:
    """Run all jobs, write a manifest for each, and a table of all runs under the root if asked."""
    suite.check()
    made = []
    for job in suite.jobs:
        folder = f"{output_root}/{job.run_id}"
        config = configured(job.pipeline, job.params)
        PIPELINES[job.pipeline](spark, folder, config, overwrite)
        runs.write_manifest(f"{folder}/manifest.json", runs.RunManifest(job.run_id, job.pipeline, job.dataset, config.seed, job.notes))
        made.append(folder)
    if compare:
        runs.write_comparison(runs.collect_runs(spark, output_root), compare)
    return made
