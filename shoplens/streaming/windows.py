"""Event-time streaming aggregates over the bronze stream (ST-4, ST-5, ST-8).

All use a watermark on ``created_at`` and the append output mode, so state is dropped
once a window can no longer change.

* ``intraday_counts``  - tumbling two-hour windows per shop: page views, purchase rows,
  purchase revenue (additive counts; order dedup and the cancel guard need the bronze
  history and live in the batch / incremental path);
* ``daily_unique_sessions`` - exact distinct browsing sessions per shop and UTC day:
  ``dropDuplicatesWithinWatermark`` keeps the first event per (shop, day, session), then a
  daily window counts them (exact distinct is refused on streams; this dedup is not);
* ``visitor_sessions`` - inactivity-gap sessions (``session_window``) per shop and visitor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BROWSE_TYPES, SESSION_GAP_SECONDS


def intraday_counts(bronze_stream: DataFrame, watermark: str = "2 hours") -> DataFrame:
    is_p = F.col("event_type") == "purchase"
    return (bronze_stream.withWatermark("created_at", watermark)
            .groupBy(F.window("created_at", "2 hours").alias("w"), "shop_id")
            .agg(F.count_if(F.col("event_type") == "page_view").alias("page_views"),
                 F.count_if(is_p).alias("purchase_rows"),
                 F.coalesce(F.sum(F.when(is_p, F.col("order_total_cents"))), F.lit(0)).cast("long")
                 .alias("purchase_revenue_cents"))
            .select("shop_id", F.col("w.start").alias("window_start"), "page_views", "purchase_rows",
                    "purchase_revenue_cents"))


def daily_unique_sessions(bronze_stream: DataFrame, watermark: str = "25 hours") -> DataFrame:
    """The delay must cover a day so that a session's later events of the same day are
    still recognised as duplicates (state: one key per session and day)."""
    b = (bronze_stream.filter(F.col("event_type").isin(*BROWSE_TYPES))
         .withColumn("day", F.to_date("created_at"))
         .withWatermark("created_at", watermark)
         .dropDuplicatesWithinWatermark(["shop_id", "day", "session_id"]))
    return (b.groupBy(F.window("created_at", "1 day").alias("w"), "shop_id")
             .agg(F.count(F.lit(1)).alias("unique_sessions"))
             .select("shop_id", F.to_date(F.col("w.start")).alias("day"), "unique_sessions"))


def visitor_sessions(bronze_stream: DataFrame, gap_s: int = SESSION_GAP_SECONDS,
                     watermark: str = "1 hour") -> DataFrame:
    return (bronze_stream.filter(F.col("visitor_id").isNotNull())
            .withWatermark("created_at", watermark)
            .groupBy(F.session_window("created_at", f"{gap_s} seconds").alias("s"), "shop_id", "visitor_id")
            .agg(F.count(F.lit(1)).alias("events"))
            .select("shop_id", "visitor_id", F.col("s.start").alias("session_start"),
                    F.col("s.end").alias("session_end"), "events"))


def daily_unique_sessions_approx(bronze_stream: DataFrame, watermark: str = "2 hours",
                                 rsd: float = 0.01) -> DataFrame:
    """Approximate form: a HyperLogLog++ sketch per (day, shop) window; state is a fixed
    register array per window instead of one key per session."""
    b = bronze_stream.filter(F.col("event_type").isin(*BROWSE_TYPES)).withWatermark("created_at", watermark)
    return (b.groupBy(F.window("created_at", "1 day").alias("w"), "shop_id")
             .agg(F.approx_count_distinct("session_id", rsd).alias("unique_sessions"))
             .select("shop_id", F.to_date(F.col("w.start")).alias("day"), "unique_sessions"))
