"""Order-book operators: valid orders, orphan-cancel guard and order deduplication.

An ``order_cancel`` only counts when a ``purchase`` for the same (shop_id, order_id)
exists. Instead of an ``OR EXISTS`` (an ExistenceJoin over every order event) the guard
is a union of two narrow scans: all purchases, plus the cancels whose order was bought. The
small side goes first: the cancels' distinct orders are looked up among all purchases (a semi
join of two columns, a broadcast while the cancels are few), and only what was found is joined
back. Semi joins never multiply rows and ignore NULL keys like EXISTS does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _purchases(bronze: DataFrame, since: Column | None = None) -> DataFrame:
    p = bronze.filter((F.col("event_type") == "purchase") & F.col("order_id").isNotNull())
    if since is not None:
        p = p.filter(F.col("created_at") >= since)
        if "event_month" in p.columns:
            p = p.filter(F.col("event_month") >= F.trunc(F.to_date(since), "MM"))
    return p.select("shop_id", "order_id")


def valid_orders(bronze: DataFrame, since: Column | None = None) -> DataFrame:
    """Distinct (shop_id, order_id) that have a purchase (optionally created since ``since``)."""
    return _purchases(bronze, since).distinct()


def guarded_order_events(bronze: DataFrame, since: Column | None = None,
                         valid_since: Column | None = None, require_order_id: bool = True,
                         extra_filter: Column | None = None, bought: DataFrame | None = None) -> DataFrame:
    """Purchases plus cancels whose order has a purchase.

    ``since`` bounds the events themselves, ``valid_since`` bounds the purchases that
    make an order valid (None = all of bronze). ``bought`` (shop_id, order_id) is looked up
    instead of bronze's purchases, where an index has them."""
    ev = bronze.filter(F.col("event_type").isin("purchase", "order_cancel"))
    if require_order_id:
        ev = ev.filter(F.col("order_id").isNotNull())
    if since is not None:
        ev = ev.filter(F.col("created_at") >= since)
        if "event_month" in ev.columns:
            ev = ev.filter(F.col("event_month") >= F.trunc(F.to_date(since), "MM"))
    if extra_filter is not None:
        ev = ev.filter(extra_filter)
    purchases = ev.filter(F.col("event_type") == "purchase")
    cancels = ev.filter(F.col("event_type") == "order_cancel")
    asked = cancels.filter(F.col("order_id").isNotNull()).select("shop_id", "order_id").distinct()
    known = _purchases(bronze, valid_since) if bought is None else bought.select("shop_id", "order_id")
    bought = known.join(asked, ["shop_id", "order_id"], "left_semi").distinct()
    return purchases.unionByName(cancels.join(bought, ["shop_id", "order_id"], "left_semi"))


def net_order_aggs(prefix: str = "") -> list[Column]:
    """Net orders and revenue over deduplicated order rows (one per order and type).

    Cancels subtract; no floor at zero, a real reversal may go negative."""
    is_p = F.col("event_type") == "purchase"
    is_c = F.col("event_type") == "order_cancel"
    return [
        (F.count_if(is_p) - F.count_if(is_c)).alias(f"{prefix}order_count"),
        (F.coalesce(F.sum(F.when(is_p, F.col("order_total_cents"))), F.lit(0))
         - F.coalesce(F.sum(F.when(is_c, F.col("order_total_cents"))), F.lit(0)))
        .cast("long").alias(f"{prefix}total_revenue_cents"),
    ]
