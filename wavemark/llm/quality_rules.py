"""Quality rules: an ordered decision list of threshold conjunctions, learnt from labels.

Sequential covering: a rule against bad documents is grown on two thirds of the labelled rows, one
threshold condition at a time by information gain, then pruned from its end on the other third; it
joins the list if it is precise enough, what it covers is set aside, and the next rule is grown. The
list becomes one Spark conditional expression, so that each verdict can be read as a rule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import labelled_sample
from .rows import as_struct, unpacked
from .shingles import hashed_words, windows
from .tokens import text_slices

#: n_marks counts marks of punctuation, n_echoes words equal to the word before them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_echoes")
_SPACES = [9, 10, 11, 12, 13, 32]
_SYMBOLS = list(b"#*$%&|<>")
_MARKS = list(b"!?.,;:")


def repeated_words(hashes: np.ndarray, width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found twice or more in the text."""
    if len(hashes) <= width:
        return 0
    rows, _ = windows(hashes, np.array([len(hashes)]), width)
    _, back, counts = np.unique(rows, return_inverse=True, return_counts=True)
    if len(counts) == len(rows):
        return 0
    change = np.zeros(len(hashes) + 1, np.int64)
    twice = np.flatnonzero(counts[back] > 1)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + width, -1)
    return int((np.cumsum(change) > 0).sum())


def count_texts(texts: list[str | None]) -> np.ndarray:
    """A row of COUNTS for each text."""
    encoded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, sizes = hashed_words(encoded)
    out, at = np.zeros((len(texts), len(COUNTS)), np.int64), 0
    for row, raw, n in zip(out, encoded, sizes.tolist(), strict=True):
        words, at = hashes[at : at + n], at + n
        bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        lines = [x for x in raw.split(b"\n") if x.strip()]
        row[:] = (
            n,
            len(raw) - bytes_of[128:192].sum() - bytes_of[_SPACES].sum(),
            bytes_of[_SYMBOLS].sum(),
            len(lines),
            len(lines) - len(set(lines)),
            repeated_words(words),
            bytes_of[65:91].sum(),
            bytes_of[_MARKS].sum(),
            (words[1:] == words[:-1]).sum(),
        )
    return out


def counts_of(text: Column) -> Column:
    """A struct of COUNTS of a whole text; only texts go to Python."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *(count_texts(texts) for _, _, texts in text_slices(batch))])
            yield pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T], list(COUNTS))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ", ".join(f"{c} long" for c in COUNTS))(text.cast("string"))


def _counted(df: DataFrame, text_col: str, keep: Sequence[str]) -> DataFrame:
    """``row`` (the columns ``keep``) and COUNTS."""
    own = df.select(as_struct(keep).alias("row"), counts_of(F.col(f"`{text_col}`")).alias("counts"))
    return own.select("row", *(F.col(f"counts.{c}") for c in COUNTS))


def with_counts(df: DataFrame, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, unchanged, and the counts of each row's whole text (COUNTS, all long;
    where a kept column has such a name, the count gets an underscore behind it). Words are runs of
    characters other than 0x20 and 0x09 to 0x0D; a null text counts as the empty one."""
    return unpacked(_counted(df, text_col, keep), "row", COUNTS)


#: Name of a statistic: the counts that it is the ratio of.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "upper_share": ("n_upper", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "echo_share": ("n_echoes", "n_words"),
}


def statistic(name: str) -> Column:
    """A statistic of a row that has the counts: a ratio, 0 where there is nothing to divide by."""
    if name in RATIOS:
        return F.coalesce(F.try_divide(*(F.col(c).cast("double") for c in RATIOS[name])), F.lit(0.0))
    return F.col(name).cast("double")


STATISTICS = (*RATIOS, "n_words")


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        own = x[:, STATISTICS.index(self.name)]
        return own > self.threshold if self.above else own <= self.threshold

    def column(self) -> Column:
        own = statistic(self.name)
        return own > self.threshold if self.above else own <= self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for condition in rule:
        held &= condition.holds(x)
    return held


def _best_condition(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The condition with the most information gain over the rows, if any gains."""
    p, n = int(bad.sum()), int((~bad).sum())
    before, best, found = np.log2(p / (p + n)), 1e-9, None
    for k, name in enumerate(STATISTICS):
        order = np.argsort(x[:, k], kind="stable")
        values, hits = x[order, k], np.cumsum(bad[order])
        cuts = np.flatnonzero(values[1:] > values[:-1])
        for above in (False, True):
            inside = hits[cuts] if not above else p - hits[cuts]
            size = cuts + 1 if not above else len(values) - cuts - 1
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(inside > 0, inside * (np.log2(inside / size) - before), 0)
            if len(gain) and gain.max() > best:
                at = cuts[int(gain.argmax())]
                best, found = gain.max(), Condition(name, above, float((values[at] + values[at + 1]) / 2))
    return found


def learn_rules(x: np.ndarray, bad: np.ndarray, *, conditions: int = 3, rules: int = 12, precision: float = 0.95, least: int = 5, seed: int = 7) -> list[Rule]:
    """The decision list against the bad rows. A rule must have ``precision`` over all rows left,
    and cover ``least`` bad ones. Rows of one kind only give the empty list."""
    grow = np.random.default_rng(seed).random(len(x)) < 2 / 3
    left, found = np.ones(len(x), bool), []
    while len(found) < rules:
        on, rule = left & grow, ()
        if not bad[on].any() or bad[on].all():
            break
        while len(rule) < conditions and not bad[on].all() and (more := _best_condition(x[on], bad[on])):
            rule, on = (*rule, more), on & more.holds(x)
        if not rule:
            break

        def worth(r: Rule, rows: np.ndarray = left & ~grow) -> float:
            own = bad[rows & covered(r, x)]
            return (2 * own.sum() - len(own)) / len(own) if len(own) else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        own = left & covered(rule, x)
        if bad[own].sum() < least or bad[own].mean() < precision:
            break
        found.append(rule)
        left &= ~own
    return found


def decision_list(rules: list[Rule]) -> Column:
    """True for rows that no rule speaks against; the first rule that covers a row decides."""
    verdict = None
    for rule in rules:
        held = F.lit(True)
        for condition in rule:
            held = held & condition.column()
        verdict = (F if verdict is None else verdict).when(held, F.lit(False))
    return F.lit(True) if verdict is None else verdict.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def fit_quality_rules(docs: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = 20_000, **options) -> list[Rule]:
    """Rules learnt from at most ``sample`` labelled documents (label 0: bad) that pass the base
    conditions. Only their counts come to the driver."""
    rows = with_counts(labelled_sample(docs, labels, label, sample, learn_only=False), keep=("doc_id", "label")).where(~base_failed())
    got = rows.select("label", "doc_id", *(statistic(n).alias(f"s_{n}") for n in STATISTICS)).toPandas().sort_values(["doc_id", "label"])
    return learn_rules(got[[f"s_{n}" for n in STATISTICS]].to_numpy(np.float64), got["label"].to_numpy() == 0, **options)


def _judged(df: DataFrame, rules: list[Rule], text_col: str, keep: Sequence[str]) -> DataFrame:
    return _counted(df, text_col, keep).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & decision_list(rules))


def judge_quality(df: DataFrame, rules: list[Rule], keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keep``, unchanged, the counts, ``base_failed`` and ``kept``: false if the base
    conditions fail, else the decision list's verdict; where a kept column has such a name, the
    added one gets an underscore behind it. Every row of ``df`` gives one row, also repeated rows
    and null ids; a null or empty text has no words and fails. An empty table gives no rows."""
    return unpacked(_judged(df, rules, text_col, keep), "row", (*COUNTS, "base_failed", "kept"))


def without_bad(df: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, each as it is."""
    return unpacked(_judged(df, rules, text_col, df.columns).where("kept"), "row", ())
