"""The catalogue: each query beside the SQL that says the same."""

from __future__ import annotations

from . import evaluation, forecasting, series

QUERIES = series.QUERIES | forecasting.QUERIES | evaluation.QUERIES
ORACLE_SQL = series.ORACLE_SQL | forecasting.ORACLE_SQL | evaluation.ORACLE_SQL
