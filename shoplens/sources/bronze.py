"""The bronze event table: Parquet, partitioned by ``event_month``.

* ``scan``        - time range / shop / event-type filters. The month predicate is added
                    explicitly so that partition pruning happens (Spark does not derive it
                    from ``created_at``); the ``created_at`` and ``shop_id`` filters reach the
                    Parquet reader as pushed filters (row-group min/max skipping).
* ``write``       - append, files sorted by (shop_id, created_at) inside each month so that
                    min/max statistics are selective for the report filters.
* ``drop_expired``    - delete the month folders that retention drops (``apply_retention`` is the same
                    rule as a filter): keep months from the month of (as_of - days): 30-61 days of history.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import parse_instant, sql_ts
from . import storage
from .table_log import TableLog

BRONZE_SCHEMA = (
    "id string, shop_id string, tenant_id string, session_id string, visitor_id string, "
    "event_type string, page_url string, page_title string, referrer string, utm_source string, "
    "utm_medium string, utm_campaign string, product_id string, product_name string, "
    "product_price_cents int, order_id string, order_total_cents int, event_timestamp timestamp, "
    "created_at timestamp, cost_price_cents int, category_id string, geo_country string, "
    "geo_subject string, geo_city string, event_month date")


def log(spark: SparkSession, path: str) -> TableLog:
    """The bronze table at ``path`` as a logged one (the streaming ingest writes it so)."""
    return TableLog(spark, path, BRONZE_SCHEMA, "event_month", ("shop_id", "created_at"))


def is_logged(spark: SparkSession, path: str) -> bool:
    return bool(storage.entries(spark, f"{path.rstrip('/')}/_log"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``: the current version of a logged one, else all its files."""
    return log(spark, path).read() if is_logged(spark, path) else spark.read.schema(BRONZE_SCHEMA).parquet(path)


def _month(t: dt.datetime) -> dt.date:
    return dt.date(t.year, t.month, 1)


def scan_filter(start=None, end=None, shop_id: str | None = None,
                event_types: tuple[str, ...] | None = None) -> Column:
    """Predicate of a bronze scan, with the derived partition predicate."""
    cond = F.lit(True)
    if start is not None:
        s = parse_instant(start)
        cond = cond & (F.col("event_month") >= F.lit(_month(s))) & \
            (F.col("created_at") >= F.to_timestamp(F.lit(sql_ts(s))))
    if end is not None:
        e = parse_instant(end)
        cond = cond & (F.col("event_month") <= F.lit(_month(e))) & \
            (F.col("created_at") < F.to_timestamp(F.lit(sql_ts(e))))
    if shop_id is not None:
        cond = cond & (F.col("shop_id") == shop_id)
    if event_types:
        cond = cond & F.col("event_type").isin(*event_types)
    return cond


def scan(bronze: DataFrame, start=None, end=None, shop_id: str | None = None,
         event_types: tuple[str, ...] | None = None) -> DataFrame:
    return bronze.filter(scan_filter(start, end, shop_id, event_types))


def write(df: DataFrame, path: str, mode: str = "append") -> None:
    """Batch append of events.

    ``REBALANCE(event_month)`` gives every write task rows of one month, so a backfill over
    years does not scatter small files into every month directory; AQE splits a month that
    is too big for one task into several (skew) and merges small ones - without the extra
    sampling pass over the input that a range repartition would cost. Within each file the
    rows are sorted by (shop_id, created_at) so that min/max statistics prune well.
    Streaming appends go to the table's log instead."""
    (df.hint("rebalance", "event_month")
       .sortWithinPartitions("event_month", "shop_id", "created_at")
       .write.mode(mode).partitionBy("event_month").parquet(path))


def retention_cutoff(as_of, days: int = 30) -> dt.date:
    t = parse_instant(as_of) - dt.timedelta(days=days)
    return _month(t)


def apply_retention(bronze: DataFrame, as_of, days: int = 30) -> DataFrame:
    """Rows of the month partitions that survive the retention drop (months strictly
    before the month of as_of - days are dropped). On a partitioned table this filter
    only lists the kept directories."""
    return bronze.filter(F.col("event_month") >= F.lit(retention_cutoff(as_of, days)))


def drop_expired(spark: SparkSession, path: str, as_of, days: int = 30) -> list[str]:
    """Take the months that retention drops out of the table, and return their folders' names. A logged table
    just no longer lists them (``vacuum`` deletes the files once nobody reads them); in a plain one they
    are deleted."""
    if is_logged(spark, path):
        return [f"event_month={m}" for m in log(spark, path).expire(retention_cutoff(as_of, days).isoformat())]
    cutoff = f"event_month={retention_cutoff(as_of, days).isoformat()}"
    gone = [f for f in storage.folders(spark, path) if f.startswith("event_month=") and f < cutoff
            and not f.endswith("__HIVE_DEFAULT_PARTITION__")]
    for folder in gone:
        storage.delete(spark, f"{path.rstrip('/')}/{folder}")
    return gone
