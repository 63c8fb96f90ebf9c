"""Rows that keep all their columns beside added ones, whatever these are called."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_name(name: str, taken: Iterable[str]) -> str:
    """``name``, or with as many underscores behind it as make it differ from those taken."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name += "_"
    return name


def as_struct(keep: Iterable[str]) -> Column:
    """The columns ``keep`` as one, in which no name can clash with those of helper columns."""
    return F.struct(*(F.col(f"`{c}`") for c in keep))


def unpacked(df: DataFrame, row: str, added: Iterable[str]) -> DataFrame:
    """The columns inside ``row`` as they were, then those ``added``, under free names."""
    names = [f.name for f in df.schema[row].dataType.fields]
    out = [F.col(f"{row}.`{n}`").alias(n) for n in names]
    for a in added:
        names.append(free_name(a, names))
        out.append(F.col(a).alias(names[-1]))
    return df.select(*out)
