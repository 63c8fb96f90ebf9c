"""Command line: ``python -m wavemark.cli COMMAND``."""

from __future__ import annotations

import argparse
import json

from .operators.thresholds import STRATEGIES
from .plans import reports, suite
from .plans.pipelines import DEFAULTS, PIPELINES, configured
from .session import session
from .sources import runs


def pair(text: str) -> tuple[str, object]:
    """KEY=VALUE; the value as JSON if it is, else as text."""
    key, equals, value = text.partition("=")
    if not key or not equals:
        raise argparse.ArgumentTypeError(f"{text!r} is not KEY=VALUE")
    try:
        return key, json.loads(value)
    except ValueError:
        return key, value


def persistence(text: str) -> reports.Persistence:
    """WINDOW:COUNT."""
    try:
        window, count = map(int, text.split(":"))
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is not WINDOW:COUNT") from None
    return reports.Persistence(window, count)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="wavemark")
    commands = top.add_subparsers(dest="command", required=True)
    for name, defaults in DEFAULTS.items():
        p = commands.add_parser(name, help=f"run the {name} pipeline")
        if "root" in defaults:
            p.add_argument("root")
        p.add_argument("output_dir")
        for key, value in defaults.items():
            if key == "machine_ids":
                p.add_argument("--machine-id", action="append", dest=key, default=argparse.SUPPRESS)
            elif key != "root":
                p.add_argument(f"--{key.replace('_', '-')}", type=type(value), default=argparse.SUPPRESS, help=f"default: {value}")
        p.add_argument("--set", type=pair, action="append", default=[], metavar="KEY=VALUE")
        p.add_argument("--overwrite", action="store_true")
    p = commands.add_parser("run-suite")
    p.add_argument("suite")
    p.add_argument("--output-root", required=True)
    p.add_argument("--compare")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--set", type=pair, action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--dry-run", action="store_true")
    p = commands.add_parser("compare-runs")
    p.add_argument("root")
    p.add_argument("--output", required=True)
    p = commands.add_parser("evaluate")
    p.add_argument("run_dir")
    p.add_argument("--output", help="default: metrics.json in the run's folder")
    p.add_argument("--energy-samples", type=int, default=256)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--threshold-strategy", choices=STRATEGIES, default="max_validation_f1")
    p.add_argument("--persistence", type=persistence)
    p.add_argument("--persistence-window", type=int, default=1)
    p.add_argument("--persistence-count", type=int, default=1)
    for section in ("forecast", "anomaly", "regime"):
        p.add_argument(f"--skip-{section}", action="append_const", dest="skip", const=section, default=[])
    p = commands.add_parser("rescore-anomaly")
    p.add_argument("source_run_dir")
    p.add_argument("--output-root", required=True)
    p.add_argument("--compare")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--strategy", choices=STRATEGIES, action="append")
    p.add_argument("--persistence", type=persistence, action="append")
    p.add_argument("--run-id-prefix")
    p.add_argument("--pipeline")
    p.add_argument("--dataset")
    p.add_argument("--seed", type=int)
    p.add_argument("--notes")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "run-suite":
        jobs = suite.with_overrides(suite.load_suite(a.suite), dict(a.set))
        jobs.check()
        if not a.dry_run:
            suite.run_suite(session(), jobs, a.output_root, compare=a.compare, overwrite=a.overwrite)
    elif a.command == "compare-runs":
        runs.write_comparison(runs.collect_runs(session(), a.root), a.output)
    elif a.command == "evaluate":
        kept = a.persistence or reports.Persistence(a.persistence_window, a.persistence_count)
        report = reports.evaluate_run(session(), a.run_dir, output=a.output or f"{a.run_dir}/metrics.json", strategy=a.threshold_strategy, persistence=kept, samples=a.energy_samples, seed=a.seed, skip=a.skip)
        print(json.dumps(runs.json_ready(report), indent=2, sort_keys=True))
    elif a.command == "rescore-anomaly":
        jobs = [(s, p) for s in a.strategy or ["validation_quantile_99"] for p in a.persistence or [reports.Persistence()]]
        reports.rescore(session(), a.source_run_dir, a.output_root, jobs, base=a.run_id_prefix, overwrite=a.overwrite, compare=a.compare, pipeline=a.pipeline, dataset=a.dataset, seed=a.seed, notes=a.notes)
    else:
        said = {k: v for k, v in vars(a).items() if k in DEFAULTS[a.command]}
        PIPELINES[a.command](session(), a.output_dir, configured(a.command, said | dict(a.set)), a.overwrite)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
