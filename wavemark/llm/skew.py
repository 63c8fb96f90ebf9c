"""Left joins on a key that may hold a third of the left rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the left rows on, so there are at most 1,000 hot keys.
HOT_SHARE = 1000
SALTS = 64


def hot_keys(counts: DataFrame, key: str, n: str, rows: int) -> DataFrame:
    """The hot keys of a table of counts by key: those of a thousandth of all ``rows`` or more. At
    most HOT_SHARE of them, whatever the input, which makes them fit to broadcast."""
    return counts.where((F.col(n) > 1) & (F.col(n) * HOT_SHARE >= rows)).select(key)


def left_join_spread(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "left", parts: int = SALTS) -> DataFrame:
    """``left`` joined to ``right``. Rows of hot keys are dealt over ``parts`` tasks by ``spread``,
    an integer expression over ``left``, and the rows of ``right`` that they need are repeated for
    each (``right`` should have few for each key); the others are joined by the key alone. Null keys
    match nothing and are dealt over tasks too."""
    marked = F.broadcast(hot.select(F.col(key), F.lit(parts).alias("_salts")))
    salts = F.when(F.col(key).isNull(), parts).otherwise(F.coalesce("_salts", F.lit(1)))
    dealt = left.join(marked, key, "left").withColumn("_salt", F.pmod(spread, salts).cast("int")).drop("_salts")
    copies = right.join(marked, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")
