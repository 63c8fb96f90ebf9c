"""Windows of series as a table function for SQL.

    SELECT * FROM windows(TABLE(series) PARTITION BY series_id ORDER BY (t), 24, 2, 1)

gives what ``operators.windows.make_windows`` does for tables of ``series_id``, ``t``, ``x``,
``regime_label`` and ``anomaly_label``: a row for each window, with the key of its series. The rows of
a series stream through a buffer of ``lookback + horizon`` rows, and a window is made only where the
stride wants one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_COLUMNS = ("series_id", "t", "x", "regime_label", "anomaly_label")


@udtf
class Windows:
    @staticmethod
    def analyze(rows: AnalyzeArgument, lookback: AnalyzeArgument, horizon: AnalyzeArgument, stride: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("windows needs a TABLE argument")
        missing = set(_COLUMNS) - {f.name for f in rows.dataType.fields}
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        for name, argument in (("lookback", lookback), ("horizon", horizon), ("stride", stride)):
            if not argument.isConstantExpression or argument.value is None or argument.value < 1:
                raise ValueError(f"{name} must be a constant of at least 1")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        many = T.ArrayType(kinds["x"])
        fields = (("series_id", kinds["series_id"]), ("start", T.LongType()), ("window", many), ("target", many), ("regime_label", kinds["regime_label"]), ("anomaly_label", kinds["anomaly_label"]))
        return AnalyzeResult(T.StructType([T.StructField(n, k) for n, k in fields]))

    def __init__(self) -> None:
        self._seen: deque[Row] = deque()

    def eval(self, rows: Row, lookback: int, horizon: int, stride: int) -> Iterator[tuple]:
        seen = self._seen
        seen.append(rows)
        if len(seen) > lookback + horizon:
            seen.popleft()
        if len(seen) == lookback + horizon and seen[0]["t"] % stride == 0:
            own = list(seen)
            ahead = [r["anomaly_label"] for r in own[lookback:] if r["anomaly_label"] is not None]
            yield own[0]["series_id"], own[0]["t"], [r["x"] for r in own[:lookback]], [r["x"] for r in own[lookback:]], own[lookback - 1]["regime_label"], max(ahead, default=None)


def register(spark: SparkSession, name: str = "windows") -> None:
    """Make the function known to the session's SQL."""
    spark.udtf.register(name, Windows)
