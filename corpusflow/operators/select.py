"""Model / candidate selection: keep the best candidate(s) by a metric (WIN3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_by(metrics: DataFrame, metric: str = "f1", group_cols: list[str] | None = None,
            tie_cols: list[str] | None = None, keep: int = 1) -> DataFrame:
    """The ``keep`` best rows per group by ``metric`` (descending), ties broken by ``tie_cols``.

    ``row_number`` over ``partitionBy(group)`` – the candidate table holds one row per candidate, so
    groups are small; Spark plans the filter as a window group limit.
    """
    order = [F.col(metric).desc_nulls_last()] + [F.col(c) for c in (tie_cols or [])]
    w = Window.partitionBy(*(group_cols or [])).orderBy(*order)
    return metrics.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")
