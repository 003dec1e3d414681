"""Calendar densification: one row per key and time slot, zeros where nothing happened.

The dense frame is generated per key row with ``explode(sequence(...))`` over literal
window bounds (a generator, not a join), so its size is exactly the output size
(keys x slots). The facts are then attached with an equi-join on (key, slot).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_slots(start: dt.datetime, end: dt.datetime):
    """Column generating every UTC day in [start, end)."""
    last = (end - dt.timedelta(days=1)).date()
    first = start.date()
    return F.explode(F.sequence(F.lit(first), F.lit(last), F.expr("INTERVAL 1 DAY")))


def densify_days(keys: DataFrame, facts: DataFrame, key_cols: list[str], start: dt.datetime,
                 end: dt.datetime, value_cols: list[str], day_col: str = "day") -> DataFrame:
    """Every (key, day) of the window with the facts' values, zero-filled.

    ``facts`` must be unique on key_cols + [day_col]."""
    grid = keys.select(*key_cols, day_slots(start, end).alias(day_col))
    f = facts.filter((F.col(day_col) >= F.lit(start.date())) & (F.col(day_col) < F.lit(end.date())))
    out = grid.join(f, key_cols + [day_col], "left")
    return out.fillna(0, subset=value_cols)


def densify_buckets(keys: DataFrame, facts: DataFrame, key_cols: list[str], start: dt.datetime,
                    end: dt.datetime, width_s: int, value_cols: list[str]) -> DataFrame:
    """Every (key, bucket) of [start, end) in steps of ``width_s`` seconds, zero-filled.

    Buckets are keyed by floor(epoch / width_s); the label is the bucket start as
    ``yyyy-MM-dd'T'HH:mm`` in UTC."""
    first = int(start.replace(tzinfo=dt.timezone.utc).timestamp()) // width_s
    n = int((end - start).total_seconds()) // width_s
    grid = keys.select(*key_cols, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(first + n - 1).cast("long")))
                       .alias("bucket_idx"))
    out = grid.join(facts, key_cols + ["bucket_idx"], "left").fillna(0, subset=value_cols)
    label = F.date_format(F.timestamp_seconds(F.col("bucket_idx") * width_s), "yyyy-MM-dd'T'HH:mm")
    return out.withColumn("slot", label)
