"""Top-k operators.

The reference orders by one metric without a tie-break; results here always add the
grouping key as a tie-break so that they are deterministic.

* ``top_k``           - one global ranking: ``orderBy().limit()`` plans as
                        TakeOrderedAndProject (each task keeps k rows, no full sort).
* ``top_k_per_group`` - the batch form of a per-shop call: ``row_number`` over the
                        group with ``rank <= k``; Spark inserts a partial WindowGroupLimit
                        before the shuffle, so even a hot shop ships at most k rows per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order(metric: str, tie: list[str]) -> list[Column]:
    return [F.col(metric).desc()] + [F.col(t).asc_nulls_first() for t in tie]


def top_k(df: DataFrame, metric: str, tie: list[str], k: int) -> DataFrame:
    return df.orderBy(*_order(metric, tie)).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], metric: str, tie: list[str], k: int,
                    rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*_order(metric, tie))
    return (df.withColumn(rank_col, F.row_number().over(w).cast("long"))
              .filter(F.col(rank_col) <= k))


def clamp_limit(limit: int | None, default: int = 10, maximum: int = 100) -> int:
    """Limit rule of the reports: <= 0 or > maximum falls back to the default."""
    if limit is None or limit <= 0 or limit > maximum:
        return default
    return limit
