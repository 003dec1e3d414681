"""Batch sessionization with an inactivity gap, safe for hot keys.

A new session starts when the gap to the previous event of the same key is at least
``gap_s`` seconds (the session cookie lives ``gap_s`` and is renewed at every event).

A plain ``lag`` + running ``sum`` over ``partitionBy(key)`` puts every event of a key in
one task; a key holding a third of all rows would serialise the job. Instead the
timeline of each key is cut into fixed time chunks:

1. inside each (key, chunk) partition: ``lag`` gives the in-chunk gap flags and a running
   count (chunks are small and many, so a hot key spreads over many tasks);
2. a per-(key, chunk) summary (first ts, last ts, number of in-chunk starts) is tiny; a
   window over the chunks of one key decides whether the chunk's first event starts a
   session (gap to the previous chunk's last event) and gives the prefix count of
   sessions before the chunk;
3. the summary is joined back on (key, chunk): session_no = prefix + chunk-first flag +
   in-chunk running count. Exact, and equal to the single-window result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, keys: list[str], ts_col: str, tie: str, gap_s: int,
               chunk_s: int = 3600, out: str = "session_no") -> DataFrame:
    us = F.unix_micros(F.col(ts_col))
    gap_us = gap_s * 1_000_000
    d = df.withColumn("_us", us).withColumn("_chunk", F.floor(F.col("_us") / F.lit(chunk_s * 1_000_000)))
    w_in = Window.partitionBy(*keys, "_chunk").orderBy("_us", tie)
    d = d.withColumn("_prev", F.lag("_us").over(w_in))
    d = d.withColumn("_flag", F.when(F.col("_prev").isNotNull() & (F.col("_us") - F.col("_prev") >= gap_us), 1)
                              .otherwise(0))
    d = d.withColumn("_run", F.sum("_flag").over(w_in.rowsBetween(Window.unboundedPreceding, 0)))
    summ = d.groupBy(*keys, "_chunk").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"),
                                          F.sum("_flag").alias("_local"))
    w_ch = Window.partitionBy(*keys).orderBy("_chunk")
    prev_last = F.lag("_last").over(w_ch)
    summ = summ.withColumn("_head", F.when(prev_last.isNull() | (F.col("_first") - prev_last >= gap_us), 1)
                                     .otherwise(0))
    summ = summ.withColumn("_before", F.coalesce(
        F.sum(F.col("_head") + F.col("_local")).over(w_ch.rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)))
    j = d.join(summ.select(*keys, "_chunk", "_head", "_before"), [*keys, "_chunk"], "inner")
    return (j.withColumn(out, (F.col("_before") + F.col("_head") + F.col("_run")).cast("long"))
             .drop("_us", "_chunk", "_prev", "_flag", "_run", "_head", "_before"))
