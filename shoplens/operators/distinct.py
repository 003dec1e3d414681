"""Exact distinct counts without the Expand blow-up.

``COUNT(DISTINCT x) FILTER (WHERE c_i)`` for several filters i is planned by Spark as an
Expand that copies every input row once per distinct group before the shuffle. When all
the distinct counts are over the same column (the funnel: distinct sessions per stage)
the same result comes from two ordinary aggregations:

1. group by (keys, x) and take ``max(c_i)`` per filter - partial aggregation collapses
   the many events of one session map-side, and a hot key is spread over its x values;
2. group by keys and ``sum`` the flags.

Exact as long as x is not NULL (rows with a NULL x are dropped in step 1).

Two distinct counts over different columns take the same two steps each, on rows that are already one
for each pair, and are put together by a union and a last aggregation over one row a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flag_distinct_counts(df: DataFrame, keys: list[str], col: str,
                         flags: dict[str, Column], extra_aggs: dict[str, Column] | None = None,
                         extra_sums: list[str] | None = None) -> DataFrame:
    """Distinct ``col`` per key for each named flag, via two ordinary aggregations.

    ``extra_aggs`` are additive per-(key, col) aggregates (e.g. counts) that are summed in
    step 2 under the same name."""
    extra_aggs = extra_aggs or {}
    step1 = (df.filter(F.col(col).isNotNull())
               .groupBy(*keys, col)
               .agg(*[F.max(c.cast("int")).alias(n) for n, c in flags.items()],
                    *[a.alias(n) for n, a in extra_aggs.items()]))
    names = list(flags) + list(extra_aggs) + list(extra_sums or [])
    return step1.groupBy(*keys).agg(*[F.sum(n).cast("long").alias(n) for n in names])


def pair_distinct_counts(pairs: DataFrame, keys: list[str], first: tuple[str, str, Column], second: tuple[str, str, Column],
                         sums: dict[str, str]) -> DataFrame:
    """Distinct counts of two columns, and sums, without an Expand.

    ``first`` and ``second`` are (result, column, which rows count); NULLs of the column don't. ``sums`` are
    results by column. ``pairs`` should have few rows for each pair of the columns: it is aggregated twice."""
    zero, results = F.lit(0).cast("long"), [first[0], second[0], *sums]
    parts = []
    for name, column, counts in (first, second):
        own = sums if name == first[0] else {}
        each = pairs.groupBy(*keys, column).agg(
            F.max((counts & F.col(column).isNotNull()).cast("int")).alias(name), *[F.sum(c).alias(n) for n, c in own.items()])
        parts.append(each.select(*keys, *[(F.col(r) if r == name or r in own else zero).cast("long").alias(r) for r in results])
                     .groupBy(*keys).agg(*[F.sum(r).alias(r) for r in results]))
    return parts[0].unionByName(parts[1]).groupBy(*keys).agg(*[F.sum(r).cast("long").alias(r) for r in results])
