"""Choice of a threshold on validation scores, by any of the named strategies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges, thresholds
from .quantiles import exact_quantiles


@dataclass(frozen=True)
class Selected:
    """``threshold`` for all rows, or ``by_group`` (group, threshold); and the range metrics that
    the predictions have on the validation rows."""

    threshold: float | None
    by_group: DataFrame | None
    metrics: dict[str, float]


def _metrics(predicted: DataFrame, seq: str) -> dict[str, float]:
    return ranges.range_metrics(predicted, seq=seq).first().asDict()


def _at(df: DataFrame, threshold: float, seq: str) -> Selected:
    return Selected(threshold, None, _metrics(thresholds.predict(df, threshold), seq))


def by_range_f1(df: DataFrame, seq: str = "seq") -> Selected:
    """The candidate with the best f1; ties by recall, precision, then the higher threshold."""
    swept = ranges.sweep_ranges(df, thresholds.candidates(df), seq=seq)
    best = swept.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "cand_ix").first()
    return Selected(best["threshold"], None, {k: best[k] for k in ("precision", "recall", "f1")})


def by_quantile(df: DataFrame, level: float, seq: str = "seq") -> Selected:
    return _at(df, exact_quantiles(df, "score", [level])[0], seq)


def by_group_quantile(df: DataFrame, level: float, group: str = "group_id", seq: str = "seq") -> Selected:
    found = thresholds.group_quantiles(df, level, group)
    return Selected(None, found, _metrics(thresholds.predict_by_group(df, found, group), seq))


def by_target_recall(df: DataFrame, target: float, fallback: float = 0.95, seq: str = "seq") -> Selected:
    """Among candidates whose range recall reaches the target, the best precision; ties by recall,
    f1, then the higher threshold. Without positives the fallback quantile; if none reaches it,
    the best f1."""
    if df.where("label = 1").isEmpty():
        return by_quantile(df, fallback, seq)
    swept = ranges.sweep_ranges(df, thresholds.candidates(df), seq=seq)
    best = swept.where(F.col("recall") >= target).orderBy(F.desc("precision"), F.desc("recall"), F.desc("f1"), "cand_ix").first()
    return Selected(best["threshold"], None, {k: best[k] for k in ("precision", "recall", "f1")}) if best else by_range_f1(df, seq)


MEASURES = ("precision", "recall", "f1")


def select_thresholds(df: DataFrame, strategies: Sequence[str] = thresholds.STRATEGIES, group: str = "group_id", seq: str = "seq") -> dict[str, Selected]:
    """What ``select_threshold`` finds for each strategy. All global thresholds, the candidates and
    the quantiles, are measured by one sweep; those by group in one plan, in which rows are exchanged
    once for each of these strategies. ``df`` is read several times, but no more often for more
    strategies."""
    for s in strategies:
        thresholds.check_strategy(s)
    levels = {s: thresholds.GLOBAL_QUANTILES[s] for s in strategies if s in thresholds.GLOBAL_QUANTILES}
    targets = {s: thresholds.TARGET_RECALLS[s] for s in strategies if s in thresholds.TARGET_RECALLS}
    if targets and df.where("label = 1").isEmpty():
        levels |= {s: fallback for s, (_, fallback) in targets.items()}
        targets = {}
    by_group = [s for s in strategies if s in thresholds.GROUP_QUANTILES]
    best = [s for s in strategies if s not in levels and s not in by_group]

    made: dict[str, Selected] = {}
    if levels or best:
        candidates = thresholds.candidates(df) if best else []
        quantiles = dict(zip(levels, exact_quantiles(df, "score", list(levels.values())), strict=True)) if levels else {}
        rows = df.withColumn("score", thresholds.finite()) if levels else df
        found = {r["threshold"]: r for r in ranges.sweep(rows, sorted({*candidates, *quantiles.values()}, reverse=True), seq=seq).collect()}
        chosen = lambda t: Selected(t, None, {k: found[t][k] for k in MEASURES})
        made |= {s: chosen(t) for s, t in quantiles.items()}
        order = lambda *names: lambda t: (*(-found[t][k] for k in names), -t)
        for s in best:
            reaching = [t for t in candidates if s in targets and found[t]["recall"] >= targets[s][0]]
            made[s] = chosen(min(reaching, key=order("precision", "recall", "f1")) if reaching else min(candidates, key=order("f1", "recall", "precision")))
    if by_group:
        found = thresholds.group_quantiles_at(df, [thresholds.GROUP_QUANTILES[s] for s in by_group], group)
        predicted = thresholds.predict_by_group_each(df.select(group, seq, "score", "label"), found, by_group, group)
        measured = {r["strategy"]: r for r in ranges.range_metrics(predicted, seq=seq, by=["strategy"]).collect()}
        for k, s in enumerate(by_group):
            made[s] = Selected(None, found.select(group, F.col("thresholds")[k].alias("threshold")), {m: measured[s][m] for m in MEASURES})
    return {s: made[s] for s in strategies}


def select_threshold(df: DataFrame, strategy: str, group: str = "group_id", seq: str = "seq") -> Selected:
    """``df``: validation rows with ``seq``, ``score``, ``label`` and, for the strategies by group,
    the group."""
    thresholds.check_strategy(strategy)
    if strategy in thresholds.GLOBAL_QUANTILES:
        return by_quantile(df, thresholds.GLOBAL_QUANTILES[strategy], seq)
    if strategy in thresholds.GROUP_QUANTILES:
        return by_group_quantile(df, thresholds.GROUP_QUANTILES[strategy], group, seq)
    if strategy in thresholds.TARGET_RECALLS:
        return by_target_recall(df, *thresholds.TARGET_RECALLS[strategy], seq=seq)
    return by_range_f1(df, seq)
