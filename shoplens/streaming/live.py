"""Live two-hour buckets (ST-4): traffic, deduplicated orders and net revenue of the day as it runs.

A windowed stream aggregation shows a bucket only once it is closed, and it can't take an order back whose
cancel comes late, nor count a cancel whose purchase comes later. Here each bronze micro-batch is
added to three logged tables, once however often it runs:

* ``pairs``  - (shop, bucket, session, visitor): page views, whether browsing;
* ``orders`` - (shop, bucket, order, type): the largest total;
* ``bought`` - (shop, order) with a purchase ever, dealt out by a hash.

All three add up, by sum, maximum and distinct, so compaction keeps them at about one row a key. ``read``
makes the buckets of any window from them: the open bucket is as good as the others, late events
count where they belong, and the result is that of ``reports.intraday_buckets`` over the same events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..constants import INTRADAY_BUCKET_SECONDS
from ..operators.orphan_guard import guarded_order_events
from ..plans import reports as R
from ..sources.table_log import TableLog
from .incremental import together

BUCKETS = 32
PAIRS = "shop_id string, bucket_idx bigint, session_id string, visitor_id string, pv bigint, br boolean, day date"
ORDERS = "shop_id string, bucket_idx bigint, order_id string, event_type string, order_total_cents int, day date"
BOUGHT = "shop_id string, order_id string, bucket int"


def _with_day(rows: DataFrame) -> DataFrame:
    return rows.withColumn("day", F.to_date(F.timestamp_seconds(F.col("bucket_idx") * INTRADAY_BUCKET_SECONDS)))


def _merged_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shop_id", "bucket_idx", "session_id", "visitor_id", "day").agg(
        F.sum("pv").alias("pv"), F.max("br").alias("br"))


def _merged_orders(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shop_id", "bucket_idx", "order_id", "event_type", "day").agg(
        F.max("order_total_cents").alias("order_total_cents"))


class LiveIntraday:
    """The tables below ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, root = spark, root.rstrip("/")
        self.pairs = TableLog(spark, f"{root}/pairs", PAIRS, "day", ("shop_id", "bucket_idx"), _merged_pairs)
        self.orders = TableLog(spark, f"{root}/orders", ORDERS, "day", ("shop_id", "bucket_idx"), _merged_orders)
        self.bought = TableLog(spark, f"{root}/bought", BOUGHT, "bucket", ("shop_id", "order_id"), lambda d: d.distinct())

    def add(self, events: DataFrame, writer: str, number: int) -> None:
        """Add a micro-batch of bronze events."""
        orders = events.filter(F.col("event_type").isin("purchase", "order_cancel") & F.col("order_id").isNotNull())
        bought = orders.filter(F.col("event_type") == "purchase").select(
            "shop_id", "order_id", F.pmod(F.xxhash64("shop_id", "order_id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
        # purchases first: a bucket that shows a cancel must know whether it was bought
        self.bought.append(bought.distinct(), writer, number)
        together([lambda: self.orders.append(_with_day(R.slot_orders(orders)), writer, number),
                  lambda: self.pairs.append(_with_day(R.slot_pairs(events)), writer, number)])
        together([table.compact for table in (self.bought, self.orders, self.pairs)])

    def read(self, start: dt.datetime, end: dt.datetime, shop_id: str | None = None, per_shop: bool = True,
             shops: DataFrame | None = None) -> DataFrame:
        """The buckets of [start, end), both on a bucket's border."""
        first, last = (int(t.replace(tzinfo=dt.timezone.utc).timestamp()) // INTRADAY_BUCKET_SECONDS for t in (start, end))

        def own(rows: DataFrame) -> DataFrame:
            rows = rows.filter(F.col("day").between(F.lit(start.date()), F.lit(end.date()))
                               & (F.col("bucket_idx") >= first) & (F.col("bucket_idx") < last))
            return rows if shop_id is None else rows.filter(F.col("shop_id") == shop_id)

        pairs, orders = _merged_pairs(own(self.pairs.read())), _merged_orders(own(self.orders.read()))
        counted = guarded_order_events(orders, bought=self.bought.read())
        base = R._shop_list(pairs, shop_id, shops) if per_shop else self.spark.range(1).select()
        return R.buckets_of(pairs, counted, base, start, end, per_shop)

    def expire(self, before: dt.date) -> None:
        """Days before ``before`` are no longer shown; what was bought is kept, as cancels may come any time."""
        for table in (self.pairs, self.orders):
            table.expire(before.isoformat())


def start(spark: SparkSession, bronze_path: str, root: str, checkpoint: str, trigger: str | None = "5 seconds",
          max_files_per_trigger: int = 100, keep_days: int = 2) -> StreamingQuery:
    """Stream a bronze folder into the live buckets; ``trigger=None`` processes what is there and stops. Days that end
    more than ``keep_days`` before a micro-batch's last event are no longer shown."""
    from ..sources.bronze import BRONZE_SCHEMA

    stream = spark.readStream.schema(BRONZE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).parquet(bronze_path)

    def handle(batch: DataFrame, batch_id: int) -> None:
        own = batch.sparkSession
        live = LiveIntraday(own, root)
        live.add(batch, own.sparkContext.getLocalProperty("sql.streaming.queryId"), batch_id)
        last = batch.agg(F.max(F.date_format("created_at", "yyyy-MM-dd"))).first()[0]
        if last is not None:
            live.expire(dt.date.fromisoformat(last) - dt.timedelta(days=keep_days))

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{checkpoint}/live").queryName("shoplens_live")
    return (w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)).start()
