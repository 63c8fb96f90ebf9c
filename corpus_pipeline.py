"""A corpus cleaned and packed: toxic documents go, bad ones go, one of each group of near
duplicates stays, and what is left is packed into sequences.

Each stage takes the documents that its predecessor kept and works on all of them. Stages learn
from the tables beside them in ``sf_dir``; a document without a label is judged like any other.

All stages decide by row. Rows that repeat an id, or have none, are documents of their own, judged
by their texts: of equal or near equal texts one row stays, that with the smallest id. Columns other
than ``doc_id`` and ``text`` pass through unchanged, whatever their names. Null and empty texts are
too short for the quality rules and go there. An empty table gives no sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wavemark.llm import near_dedup, packing, quality_rules, toxicity
from wavemark.llm.queries import SEQUENCE, byte_bpe, table
from wavemark.llm.storage import written_table
from wavemark.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    machine = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, machine)


def without_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rules = quality_rules.fit_quality_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.without_bad(docs, rules)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack_documents(docs, byte_bpe(), capacity=SEQUENCE)


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", without_bad),
    ("near duplicates", without_near_duplicates),
    ("packing", packed),
]

#: Learnt stages have no SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
