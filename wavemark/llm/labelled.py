"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; false for null ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, *, learn_only: bool) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents, chosen by a hash of the id.
    ``learn_only``: none of the held-out ones. Labels other than 0 and 1, null ids, and ids that
    ``labels`` has with both labels are left out; of documents that share an id, the one with the
    smallest text counts. What is broadcast is at most ``most`` pairs of numbers."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if learn_only:
        rows = rows.where(~held_out(F.col("doc_id")))
    clear = rows.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other")).where("label = other")
    chosen = clear.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
