"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into dictionary phrases (LZ78 over code points): the longest known phrase, and one
code point more, is the next phrase and becomes known. The phrases of a text are the patterns a
compressor would learn from it, so texts that share much of their phrase sets compress well
together. The fingerprint is the smallest hashes of the phrase set, a minimum-hash signature whose
comparison estimates the overlap of the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import dealt, range_bounds, range_number
from .shingles import mix, sorted_distinct
from .tokens import text_slices

#: Smallest hashes kept.
SIZE = 128
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@dataclass(frozen=True)
class Parse:
    """``ends``: where each phrase ends. ``settled``: how many of the phrases depend on nothing
    beyond the middle of the text."""

    ends: list[int]
    settled: int


def parse(text: str, half: int | None = None, before: tuple[list[int], set[str]] | None = None) -> Parse:
    """The phrases of ``text``. ``before``: the first phrases, known already, and their set."""
    ends, known = before if before else ([], set())
    at, n, length = (ends[-1] if ends else 0), len(text), 4
    settled = None
    while at < n:
        # The set holds every prefix of its phrases, so the longest match is where membership ends.
        if text[at : at + length] in known:
            while at + length < n and text[at : at + length + 1] in known:
                length += 1
        else:
            length -= 1
            while length and text[at : at + length] not in known:
                length -= 1
        end = at + length + 1
        if half is not None and settled is None and end > half:
            settled = len(ends)
        if end > n:  # what is left is a known phrase
            break
        known.add(text[at:end])
        ends.append(end)
        at = end
        length = min(max(length, 2), n - at)
    return Parse(ends, len(ends) if settled is None else settled)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(2 * n, base)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def smallest(text: str, ends: list[int], size: int = SIZE) -> np.ndarray:
    """The ``size`` smallest of the 32-bit hashes of the phrases that end at ``ends``."""
    if not ends:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    up, down = _power(len(points) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    stop = np.array(ends)
    start = np.concatenate([[0], stop[:-1]])
    hashes = (mix((sums[stop] - sums[start]) * down[start]) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * size:
        hashes = hashes[hashes <= np.partition(hashes, 2 * size)[2 * size]]
    return sorted_distinct(hashes)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """The share of the union's smallest hashes that both have; 1 for two empty texts."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    merged = np.sort(np.concatenate([a, b]))
    double = merged[1:] == merged[:-1]
    first = np.concatenate([[True], ~double])
    union = int(first.sum())
    both = np.concatenate([double, [False]])[first]
    return float(both[: min(size, union)].mean())


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype("<u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), "<u4")


def fingerprint(text: str | None) -> str:
    """Eight hexadecimal digits for each kept hash, ascending; empty for an empty text."""
    text = text or ""
    return as_text(smallest(text, parse(text).ends))


def fingerprint_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fingerprint`` of each row, without a shuffle; null texts count as empty."""
    own = df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text"))
    schema = T.StructType([own.schema["doc_id"], T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t) for _, _, texts in text_slices(batch.column(1)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], schema.names)

    return own.mapInArrow(run, schema)


def with_successors(df: DataFrame, rows_per_range: int = 2048) -> DataFrame:
    """(doc_id, text) as ranges in ascending order of doc_id (nulls first, equal ids by text, null
    texts first), each followed by copies, ``halo``, of the row that comes next: the first of the
    following range, and after the last row of all the first of all."""
    bounds = range_bounds(df, "doc_id", rows_per_range)
    keyed = df.select("doc_id").withColumn("range_id", range_number(F.col("doc_id"), bounds))
    found = keyed.groupBy("range_id").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("has_null")).orderBy("range_id").collect()
    first = [-np.inf if r["has_null"] else float(r["least"]) for r in found]
    before = [found[i - 1]["range_id"] for i in range(len(found))]  # the range before the first is the last

    @F.pandas_udf("long")
    def halo_of(keys):
        import pandas as pd

        values, edges = keys.to_numpy(np.float64, na_value=-np.inf), np.array(first)
        at = np.minimum(np.searchsorted(edges, values), len(edges) - 1)
        return pd.Series(np.where(edges[at] == values, np.array(before)[at], -1))

    places = F.array(F.struct(range_number(F.col("doc_id"), bounds).alias("range_id"), F.lit(False).alias("halo")), F.struct(halo_of(F.col("doc_id").cast("double")).alias("range_id"), F.lit(True).alias("halo")))
    if not found:
        return df.select("doc_id", "text", F.lit(0).cast("long").alias("range_id"), F.lit(False).alias("halo"))
    placed = df.withColumn("p", F.explode(F.filter(places, lambda p: p["range_id"] >= 0))).select("doc_id", "text", "p.range_id", "p.halo")
    return dealt(placed, len(bounds) + 1).sortWithinPartitions("range_id", "halo", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())


def compare_with_edits(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edit and the next document, in ascending order of integer ids
    (nulls first, equal ids by text); after the last comes the first.

    The edit replaces the last floor(n/2) code points by the first as many, or all, of the next
    document. Columns: ``doc_id``, ``edited`` (that text), ``n_chars``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``. Null texts count as empty; two empty
    texts are alike, an empty and another are not. Other columns are not read. Texts are exchanged
    once; the parse of a text's first half serves its edit too.
    """
    own = with_successors(df.select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")))
    schema = T.StructType([
        own.schema["doc_id"], T.StructField("edited", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # a document that waits for the next one
        out: list[tuple] = []
        size = 0
        for batch, (a, b, texts) in ((batch, part) for batch in batches for part in text_slices(batch.column(1))):
            ids, halos = (batch.column(c).slice(a, b - a).to_pylist() for c in (0, 3))
            for doc, text, halo in zip(ids, texts, halos, strict=True):
                if halo and held is None:
                    continue
                text = text or ""
                half = len(text) - len(text) // 2
                parsed = parse(text, half)
                hashes = smallest(text, parsed.ends)
                if held is not None:
                    their, their_text, their_half, their_parse, their_hashes = held
                    edited = their_text[:their_half] + text[: len(their_text) - their_half]
                    ends = their_parse.ends[: their_parse.settled]
                    known = {their_text[a:b] for a, b in zip([0, *ends], ends, strict=False)}
                    changed = smallest(edited, parse(edited, before=(ends, known)).ends)
                    out.append((their, edited, len(their_text), as_text(their_hashes), as_text(changed), likeness(their_hashes, changed), likeness(their_hashes, hashes)))
                    size += len(edited)
                held = None if halo else (doc, text, half, parsed, hashes)
                if size > 4_000_000:
                    yield _batch(out, schema)
                    out, size = [], 0
        if out:
            yield _batch(out, schema)

    return own.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)
