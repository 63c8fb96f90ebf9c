"""Agreement of regime labels, and diagnostics of regime posteriors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mixture import entropy, normalized_entropy
from .sequence import trailing


def whole_label(df: DataFrame, name: str) -> Column:
    """The label as it is; one that is null or no whole number fails the job."""
    kind, value = df.schema[name].dataType, F.col(name)
    kind = kind if isinstance(kind, T.IntegralType) else T.LongType()
    whole = value.isNotNull() & F.coalesce(value.cast("double") == F.floor(value.cast("double")), F.lit(False))
    return F.when(whole, value.cast(kind)).otherwise(F.raise_error(F.lit(f"{name} must be whole numbers")).cast(kind))


def contingency(df: DataFrame, truth: str = "true_label", pred: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """Rows by true and predicted label."""
    return df.groupBy(*by, whole_label(df, truth).alias("truth"), whole_label(df, pred).alias("pred")).agg(F.count("*").alias("n"))


def adjusted_rand(df: DataFrame, truth: str = "true_label", pred: str = "pred_label", by: Sequence[str] = ()) -> DataFrame:
    """``ari``: 1 for fewer than two rows, or where chance alone decides."""
    cells = contingency(df, truth, pred, by)
    pairs = lambda c: F.sum(c * (c - 1) / 2.0)
    inside = cells.groupBy(*by).agg(pairs(F.col("n")).alias("i"), F.sum("n").alias("n"))
    for side in ("truth", "pred"):
        own = cells.groupBy(*by, side).agg(F.sum("n").alias("m")).groupBy(*by).agg(pairs(F.col("m")).alias(side))
        inside = inside.join(own, list(by)) if by else inside.crossJoin(F.broadcast(own))  # one row
    whole = F.col("n") * (F.col("n") - 1) / 2.0
    expected = F.try_divide(F.col("truth") * F.col("pred"), whole)
    ari = F.try_divide(F.col("i") - expected, (F.col("truth") + F.col("pred")) / 2.0 - expected)
    return inside.select(*by, F.when(F.col("n") < 2, 1.0).otherwise(F.coalesce(ari, F.lit(1.0))).alias("ari"))


def assign(cost: Sequence[Sequence[float]]) -> list[tuple[int, int]]:
    """The cheapest matching of rows to columns of a small matrix, by shortest augmenting paths;
    every row is matched if there are columns enough, else every column."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if n > m:
        return sorted((i, j) for j, i in assign([list(c) for c in zip(*cost, strict=True)]))
    infinite = float("inf")
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, came, seen = [infinite] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while owner[at]:
            seen[at] = True
            row, step, nearest = owner[at], infinite, 0
            for j in range(1, m + 1):
                if not seen[j]:
                    reduced = cost[row - 1][j - 1] - u[row] - v[j]
                    if reduced < least[j]:
                        least[j], came[j] = reduced, at
                    if least[j] < step:
                        step, nearest = least[j], j
            for j in range(m + 1):
                if seen[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nearest
        while at:
            owner[at], at = owner[came[at]], came[at]
    return sorted((owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j])


def align(df: DataFrame, truth: str = "true_label", pred: str = "pred_label") -> dict[int, int]:
    """The mapping of predicted to true labels with the most agreement. A predicted label left over
    maps to the smallest true one. Only the table of label pairs comes to the driver."""
    cells = {(r["pred"], r["truth"]): r["n"] for r in contingency(df, truth, pred).collect()}
    preds, truths = sorted({p for p, _ in cells}), sorted({t for _, t in cells})
    pairs = assign([[-float(cells.get((p, t), 0)) for t in truths] for p in preds]) if cells else []
    return dict.fromkeys(preds, truths[0] if truths else 0) | {preds[i]: truths[j] for i, j in pairs}


def aligned(df: DataFrame, mapping: dict[int, int], pred: str = "pred_label", name: str = "aligned") -> DataFrame:
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return df.withColumn(name, F.coalesce(F.try_element_at(table, F.col(pred)), F.lit(min(mapping.values()))))


def switch_points(df: DataFrame, label: str, seq: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """The rows whose label differs from that of the row before."""
    return trailing(df, seq, 1, lambda w: {"_was": F.lag(label).over(w)}, by).where(F.col(label) != F.col("_was")).drop("_was")


def false_switch_rate(df: DataFrame, truth: str = "true_label", pred: str = "pred_label", seq: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """``false_switches_per_1000``: predicted switches where the truth stays, for each thousand
    steps at which it stays; 0 without such steps."""
    steps = trailing(df, seq, 1, lambda w: {"_t": F.lag(truth).over(w), "_p": F.lag(pred).over(w)}, by)
    stays = F.col(truth) == F.col("_t")
    return steps.groupBy(*by).agg(F.coalesce(F.try_divide(1000.0 * F.count_if(stays & (F.col(pred) != F.col("_p"))), F.count_if(stays).cast("double")), F.lit(0.0)).alias("false_switches_per_1000"))


def argmax(probabilities: Column) -> Column:
    """The first index of the largest probability."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("long")


def posterior_diagnostics(df: DataFrame, probabilities: str = "probs", seq: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """Mean entropy, mean normalised entropy, mean confidence, and how often the likeliest regime
    changes along the sequence."""
    p = F.col(probabilities)
    marked = df.withColumn("_best", argmax(p))
    steps = trailing(marked, seq, 1, lambda w: {"_was": F.lag("_best").over(w)}, by)
    return steps.groupBy(*by).agg(F.avg(entropy(p)).alias("mean_entropy"), F.avg(normalized_entropy(p)).alias("mean_normalized_entropy"), F.avg(F.array_max(p)).alias("mean_confidence"), F.count_if(F.col("_best") != F.col("_was")).alias("switches"))
