"""Ranges of anomalies: islands in a dense sequence, and the measures over them.

A sequence table has ``seq`` (0, 1, 2, ... without gaps) and 0/1 columns. Islands of one column are
disjoint, so the overlap of an island with all islands of another is the other's count inside it:
measures need an aggregate over islands, and no join of ranges. The measures of two columns mark both
columns' islands in one pass over chunks of the sequence, whose summaries are put together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import component_tree
from .sequence import CHUNK, running_sum, running_sums, trailing


def binary(flag: str) -> Column:
    """The flag as it is; a value other than 0 and 1 fails the job."""
    value = F.col(flag).cast("int")
    return F.when(F.col(flag).isin(0, 1), value).otherwise(F.raise_error(F.lit(f"{flag} must be 0 or 1")).cast("int"))


def island_numbers(df: DataFrame, flag: str, name: str = "island", seq: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """The rows where ``flag`` is 1, with the number of their run."""
    starts = trailing(df, seq, 1, lambda w: {"_was": F.coalesce(F.lag(flag).over(w), F.lit(0))}, by)
    return running_sum(starts, seq, ((F.col(flag) == 1) & (F.col("_was") == 0)).cast("long"), name, by).where(F.col(flag) == 1).drop("_was")


def ranges(df: DataFrame, flag: str, seq: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of 1, half-open: ``start``, ``end``."""
    return island_numbers(df, flag, seq=seq, by=by).groupBy(*by, "island").agg(F.min(seq).alias("start"), (F.max(seq) + 1).alias("end")).drop("island")


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))


def _chunks(df: DataFrame, seq: str, back: int, chunk: int) -> DataFrame:
    """``df`` with ``_chunk``, in which each chunk has copies of the last ``back`` rows before it,
    and ``_own``: false for copies."""
    if back >= chunk:
        raise ValueError("a chunk must be longer than the persistence window")
    own = F.floor(F.col(seq) / chunk)
    places = F.when(F.pmod(F.col(seq), F.lit(chunk)) >= chunk - back, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn("_chunk", F.explode(places)).withColumn("_own", F.col("_chunk") == own)


def _summaries(rows: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """A row for each chunk of each group: ``closed``, sums over the runs inside, and ``edges``, the
    runs at its first or last row. Runs are found by windows within the chunk."""
    w = Window.partitionBy(*keys, "_chunk").orderBy("_s")
    begins = {f"_n{c}": ((F.col(c) == 1) & (F.coalesce(F.lag(c).over(w), F.lit(0)) == 0)).cast("long") for c in ("_t", "_p")}
    marked = rows.withColumns(begins).withColumns({c: F.sum(c).over(w) for c in begins})

    def part(side: str, own: str, other: str) -> Column:
        return F.when(F.col(own) == 1, F.struct(F.lit(side).alias("side"), F.col(f"_n{own}").alias("island"), F.col(other).alias("hit")))

    # Each row counts once as a row (side 'n': is it normal), and once in each run it is in.
    normal = F.struct(F.lit("n").alias("side"), F.lit(0).cast("long").alias("island"), (1 - F.col("_t")).alias("hit"))
    flat = marked.select(*keys, "_chunk", "_s", "_t", F.explode(F.filter(F.array(part("t", "_t", "_p"), part("p", "_p", "_t"), normal), lambda x: x.isNotNull())).alias("m")).select(*keys, "_chunk", "_s", "_t", "m.*")
    runs = flat.groupBy(*keys, "_chunk", "side", "island").agg(
        F.count("*").alias("size"), F.sum("hit").alias("hits"), F.min("_s").alias("start"), F.max("_s").alias("stop"),
        F.min(F.when(F.col("hit") == 1, F.col("_s"))).alias("hit"), F.min(F.struct("_s", "_t"))["_t"].alias("first"),
    )
    at_start, at_end = F.pmod("start", F.lit(chunk)) == 0, F.pmod("stop", F.lit(chunk)) == chunk - 1
    touches = (F.col("side") != "n") & (at_start | at_end)
    inside = lambda c: (F.col("side") == c) & ~touches
    share = F.col("hits") / F.col("size")
    closed = F.struct(
        F.count_if(inside("p")).alias("n_p"), F.sum(F.when(inside("p"), share)).alias("p"), F.count_if(inside("t")).alias("n_t"), F.sum(F.when(inside("t"), share)).alias("r"),
        F.count_if(inside("p") & (F.col("first") == 0)).alias("alarms"), F.sum(F.when(F.col("side") == "n", F.col("hits"))).alias("normals"),
        F.count_if(inside("t") & F.col("hit").isNull()).alias("missed"), F.collect_list(F.when(inside("t"), F.col("hit") - F.col("start"))).alias("delays"),
    )
    edges = F.collect_list(F.when(touches, F.struct(at_start.alias("at_start"), at_end.alias("at_end"), "side", "size", "hits", "start", "hit", "first")))
    return runs.groupBy(*keys, "_chunk").agg(closed.alias("closed"), edges.alias("edges"))


def measures(df: DataFrame, truth: str = "label", pred: str = "pred", seq: str = "seq", by: Sequence[str] = (), *, persistence: tuple[int, int] = (1, 1), restart: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """All range measures in one row, or one for each group: ``precision``, ``recall`` and ``f1``
    over ranges (1 for a side without ranges if the other has none either, else 0); ``mean_delay``
    and ``median_delay`` from the start of a true range to its first hit (null without one), and how
    many are ``detected`` and ``missed``; ``false_alarms_per_1000``: predicted ranges that start at
    a normal row, for each thousand normal rows (0 without normal rows).

    ``persistence``, (window, count), filters the predictions first, as ``thresholds.persist`` does;
    it starts anew with each value of ``restart``, whose rows stand together.

    Rows are exchanged once, by group and chunk of the sequence. What a chunk knows of its runs is
    one short row; runs over its edges are put together from these."""
    keys, (window, count) = list(by), persistence
    own = F.col(restart) if restart else F.lit(0)
    rows = df.select(*keys, F.col(seq).alias("_s"), binary(truth).alias("_t"), binary(pred).alias("_p"), own.alias("_r"))
    rows = _chunks(rows, "_s", window - 1, chunk)
    if window > 1:
        near = Window.partitionBy(*keys, "_chunk", "_r").orderBy("_s").rowsBetween(1 - window, 0)
        rows = rows.withColumn("_p", (F.sum("_p").over(near) >= count).cast("int"))
    parts = _summaries(rows.where("_own"), keys, chunk).withColumn("closed", F.struct("closed.*", F.lit(True).alias("whole")))

    # Edges in order: a run goes on where one reaches a chunk's end and the next one's start.
    none = F.lit(None)
    empty = F.struct(F.lit(False).alias("at_start"), F.lit(False).alias("at_end"), F.lit("n").alias("side"), none.cast("long").alias("size"), none.cast("long").alias("hits"), none.cast("long").alias("start"), none.cast("long").alias("hit"), none.cast("int").alias("first"))
    entry = lambda edge, closed: F.struct(edge.alias("e"), closed.alias("closed"))
    nothing = F.when(F.lit(False), F.col("closed"))
    listed = F.concat(F.array(entry(empty, F.col("closed"))), F.transform("edges", lambda e: entry(e, nothing)))
    flat = parts.select(*keys, "_chunk", F.explode(listed).alias("x")).select(*keys, "_chunk", "x.e.*", "x.closed")
    order = Window.partitionBy(*keys, "side").orderBy("_chunk", F.desc("at_start"))
    before = F.lag(F.struct("_chunk", "at_end")).over(order)
    follows = F.col("at_start") & F.coalesce((before["_chunk"] == F.col("_chunk") - 1) & before["at_end"], F.lit(False))
    chained = flat.withColumn("_go", follows).withColumn("_chain", F.sum((~F.col("_go")).cast("long")).over(order))
    runs = chained.groupBy(*keys, "side", "_chain").agg(
        (F.sum("hits") / F.sum("size")).alias("share"), (F.min("hit") - F.min("start")).alias("delay"), F.min(F.struct("start", "first"))["first"].alias("first"), F.first("closed", ignorenulls=True).alias("closed"),
    )

    is_p, is_t = F.col("side") == "p", F.col("side") == "t"
    one = lambda flag: flag.cast("long")
    edge = F.struct(
        one(is_p).alias("n_p"), F.when(is_p, F.col("share")).alias("p"), one(is_t).alias("n_t"), F.when(is_t, F.col("share")).alias("r"), one(is_p & (F.col("first") == 0)).alias("alarms"), F.lit(0).cast("long").alias("normals"),
        one(is_t & F.col("delay").isNull()).alias("missed"), F.when(is_t & F.col("delay").isNotNull(), F.array("delay")).otherwise(F.array().cast("array<long>")).alias("delays"), F.lit(True).alias("whole"),
    )
    every = runs.select(*keys, F.coalesce("closed", edge).alias("m")).select(*keys, "m.*")
    # A row of sums, and one for each delay: these are as many as detected true ranges.
    spread = every.select(*keys, *(c for c in ("n_p", "p", "n_t", "r", "alarms", "normals", "missed")), F.posexplode_outer(F.concat(F.array(none.cast("long")), "delays")).alias("at", "delay"))
    sums = lambda c: F.coalesce(F.sum(F.when(F.col("at") == 0, F.col(c))), F.lit(0))
    found = spread.groupBy(*keys).agg(
        F.try_divide(sums("p"), sums("n_p")).alias("p"), F.try_divide(sums("r"), sums("n_t")).alias("r"), F.avg("delay").alias("mean_delay"), F.median("delay").alias("median_delay"),
        F.count("delay").alias("detected"), sums("missed").alias("missed"), F.coalesce(F.try_divide(1000.0 * sums("alarms"), sums("normals").cast("double")), F.lit(0.0)).alias("false_alarms_per_1000"),
    )
    neither = F.col("p").isNull() & F.col("r").isNull()
    value = lambda c: F.when(neither, 1.0).otherwise(F.coalesce(F.col(c), F.lit(0.0)))
    done = found.withColumn("precision", value("p")).withColumn("recall", value("r")).withColumn("f1", f1(F.col("precision"), F.col("recall")))
    return done.select(*keys, "precision", "recall", "f1", "mean_delay", "median_delay", "detected", "missed", "false_alarms_per_1000")


def range_metrics(df: DataFrame, truth: str = "label", pred: str = "pred", seq: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """``precision``, ``recall`` and ``f1`` of ``measures``."""
    return measures(df, truth, pred, seq, by).select(*by, "precision", "recall", "f1")


def confusion(df: DataFrame, truth: str = "label", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """Counts and rates. Precision is 1 without predictions, recall 1 without positives, the false
    positive rate 0 without negatives."""
    t, p = binary(truth) == 1, binary(pred) == 1
    counts = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    rate = lambda a, b, empty: F.coalesce(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(empty))
    return counts.withColumn("precision", rate("tp", "fp", 1.0)).withColumn("recall", rate("tp", "fn", 1.0)).withColumn("fpr", rate("fp", "tn", 0.0))


def detection_delay(df: DataFrame, truth: str = "label", pred: str = "pred", seq: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """``mean_delay``, ``median_delay``, ``detected`` and ``missed`` of ``measures``."""
    return measures(df, truth, pred, seq, by).select(*by, "mean_delay", "median_delay", "detected", "missed")


def false_alarm_rate(df: DataFrame, truth: str = "label", pred: str = "pred", seq: str = "seq", by: Sequence[str] = ()) -> DataFrame:
    """``false_alarms_per_1000`` of ``measures``."""
    return measures(df, truth, pred, seq, by).select(*by, "false_alarms_per_1000")


# Sweeps over at most 64 candidate thresholds, descending, or over all scores.

#: Pieces of the distinct scores in sweeps over all of them.
PIECES = 256


def _candidate_table(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(map(float, thresholds))), "cand_ix int, threshold double")


def _reached(thresholds: Sequence[float], score: str) -> Column:
    """The number of the first candidate at or below the score: the row is predicted from there on."""
    table = F.array(*(F.lit(float(c)) for c in thresholds))
    return F.size(F.filter(table, lambda c: c > F.col(score)))


def sweep_points(df: DataFrame, thresholds: Sequence[float], score: str = "score", truth: str = "label") -> DataFrame:
    """Counts and rates at each candidate (``cand_ix``, ``threshold``): rows are counted once by
    the first candidate that they reach, and added up along the candidates."""
    counted = df.groupBy(_reached(thresholds, score).alias("cand_ix")).agg(F.sum(binary(truth)).alias("p"), F.sum(1 - binary(truth)).alias("n"))
    rows = _candidate_table(df, thresholds).join(F.broadcast(counted), "cand_ix", "full")
    upto, whole = Window.orderBy("cand_ix").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("cand_ix").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    add = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    counts = rows.select("cand_ix", "threshold", add("p", upto).alias("tp"), add("n", upto).alias("fp"), (add("n", whole) - add("n", upto)).alias("tn"), (add("p", whole) - add("p", upto)).alias("fn"))
    return with_rates(counts.where("threshold is not null"))


def sweep(df: DataFrame, thresholds: Sequence[float], score: str = "score", truth: str = "label", seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """At each candidate the counts of rows (``tp``, ``fp``, ``tn``, ``fn``, ``fpr``) and the range
    measures (``precision``, ``recall``, ``f1``): one pass over the rows, see ``component_tree``."""
    reached = _reached(thresholds, score)
    level = F.when(reached < len(thresholds), reached.cast("double")).otherwise(F.lit(component_tree.NEVER))
    steps = component_tree.level_steps(df, level, binary(truth), seq, chunk)
    found = component_tree.with_rates(component_tree.at_candidates(steps, thresholds))
    return found.select("cand_ix", "threshold", "tp", "fp", "tn", "fn", "fpr", "precision", "recall", "f1")


def sweep_ranges(df: DataFrame, thresholds: Sequence[float], score: str = "score", truth: str = "label", seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """Range precision and recall, f1, and the pointwise false positive rate at each candidate."""
    return sweep(df, thresholds, score, truth, seq, chunk).select("cand_ix", "threshold", "fpr", "precision", "recall", "f1")


def sweep_all_scores(df: DataFrame, score: str = "score", truth: str = "label", seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """``threshold`` and the columns of ``sweep`` at every distinct score of ``df``, however many
    there are. Sums along falling thresholds are running sums over the distinct scores, in pieces cut
    by approximate quantiles; null scores are never reached."""
    edges = sorted({-q for q in df.approxQuantile(score, [i / PIECES for i in range(1, PIECES)], 0.5 / PIECES)})
    piece = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col("level"))) if edges else F.lit(0)
    level = F.coalesce(-F.col(score).cast("double"), F.lit(component_tree.NEVER))
    steps = component_tree.level_steps(df, level, binary(truth), seq, chunk)
    sums = running_sums(steps, "level", {f"_{c}": F.col(c) for c in component_tree.SUMS}, piece=piece)
    sums = sums.where(F.col("level") > component_tree.ALWAYS).select((-F.col("level")).alias("threshold"), *(F.col(f"_{c}").alias(c) for c in component_tree.SUMS))
    clean = sums.withColumn("share", F.when(F.round("runs") == 0, 0.0).otherwise(F.col("share"))).withColumn("runs", F.round("runs"))
    return component_tree.with_rates(clean).select("threshold", "tp", "fp", "tn", "fn", "fpr", "precision", "recall", "f1")


def step_area(points: DataFrame, x: str = "recall", y: str = "precision") -> DataFrame:
    """``area`` under the envelope of a curve: for each step of x, the highest y at or beyond it.
    For curves of at most 64 points."""
    best = points.groupBy(F.col(x).alias("x")).agg(F.max(y).alias("y"))
    up, down = Window.orderBy("x"), Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    steps = best.withColumn("e", F.max("y").over(down)).withColumn("before", F.lag("x", 1, 0.0).over(up))
    return steps.agg(F.coalesce(F.sum((F.col("x") - F.col("before")) * F.col("e")), F.lit(0.0)).alias("area"))


def trapezoid_area(points: DataFrame, x: str = "fpr", y: str = "recall", order: str = "cand_ix") -> DataFrame:
    """``area`` by trapezoids over the points in the order of x, then ``order``."""
    w = Window.orderBy(x, order)
    steps = points.withColumn("x2", F.lead(x).over(w)).withColumn("y2", F.lead(y).over(w))
    return steps.agg(F.coalesce(F.sum((F.col("x2") - F.col(x)) * (F.col(y) + F.col("y2")) / 2), F.lit(0.0)).alias("area"))


def threshold_free(df: DataFrame, thresholds: Sequence[float], score: str = "score", truth: str = "label", seq: str = "seq") -> DataFrame:
    """``average_precision``, ``roc_auc``, ``vus_pr`` and ``vus_roc``. The last two are areas of the
    range curve. One sweep gives both curves; its rows, one for each candidate, are all that comes to
    the driver."""
    swept = gathered(sweep(df, thresholds, score, truth, seq))
    points = with_rates(swept.select("cand_ix", "tp", "fp", "tn", "fn"))
    areas = {"average_precision": step_area(points), "roc_auc": trapezoid_area(points), "vus_pr": step_area(swept), "vus_roc": trapezoid_area(swept)}
    found = {name: area.first()["area"] for name, area in areas.items()}
    return df.sparkSession.createDataFrame([tuple(found.values())], ", ".join(f"{n} double" for n in found))


def gathered(rows: DataFrame) -> DataFrame:
    """A table of a row for each candidate, computed once and held by the driver."""
    return rows.sparkSession.createDataFrame(rows.toArrow())
