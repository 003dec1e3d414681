"""Silver and gold views, recomputed from bronze.

Every function is ``bronze DataFrame (+ as_of) -> DataFrame``; ``as_of`` replaces the
database's ``now()`` so that results are reproducible. The rolling lower bounds are
parameters (``lookback``), default as in the service: 13 months for the daily views,
30 days for top products.

Scale notes
-----------
* Distinct counts are built so that the first shuffle is on (keys, session) or
  (keys, session, visitor) after a map-side partial aggregation: a hot shop or day is
  spread over its sessions, and the many events of one session collapse before the
  exchange.
* Full outer joins with null-safe keys are replaced by ``unionByName`` + ``groupBy``
  (groups NULLs together, one shuffle, no join).
* The orphan guard is a LEFT SEMI join on (shop_id, order_id) of cancels only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BROWSE_TYPES
from ..functions.periods import parse_instant, sql_ts
from ..functions.rates import div_trunc, pct_2dp
from ..operators.distinct import flag_distinct_counts, pair_distinct_counts
from ..operators.orphan_guard import guarded_order_events, net_order_aggs

DAILY_LOOKBACK = "13 MONTHS"
TOP_PRODUCTS_LOOKBACK = "30 DAYS"

TRAFFIC_KEYS = ["shop_id", "tenant_id", "day"]


def as_of_lit(as_of: str | dt.datetime) -> Column:
    return F.to_timestamp(F.lit(sql_ts(parse_instant(as_of))))


def lower_bound(as_of: str | dt.datetime, lookback: str | None) -> Column | None:
    """``as_of - INTERVAL lookback`` (month arithmetic clamps to the month end)."""
    if lookback is None:
        return None
    return as_of_lit(as_of) - F.expr(f"INTERVAL {lookback}")


def _since(bronze: DataFrame, bound: Column | None) -> DataFrame:
    """Lower time bound, plus the implied month-partition predicate (Spark does not
    derive partition pruning on ``event_month`` from a ``created_at`` filter)."""
    if bound is None:
        return bronze
    cond = F.col("created_at") >= bound
    if "event_month" in bronze.columns:
        cond = cond & (F.col("event_month") >= F.trunc(F.to_date(bound), "MM"))
    return bronze.filter(cond)


def _day() -> Column:
    return F.to_date("created_at").alias("day")


def _is_browse() -> Column:
    return F.col("event_type").isin(*BROWSE_TYPES)


# ---------------------------------------------------------------------------------------
# VW-1 daily_traffic
# ---------------------------------------------------------------------------------------
def daily_traffic(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK) -> DataFrame:
    """page_views, unique_sessions (browsing events only), unique_visitors (all events),
    new_sessions per (shop, tenant, day)."""
    b = _since(bronze, lower_bound(as_of, lookback)).select(
        "shop_id", "tenant_id", _day(), "session_id", "visitor_id", "event_type")
    et = F.col("event_type")
    # step 1: one row per (day, session, visitor) - events collapse map-side
    s1 = b.groupBy(*TRAFFIC_KEYS, "session_id", "visitor_id").agg(
        F.count_if(et == "page_view").alias("pv"),
        F.count_if(et == "session_start").alias("ns"),
        F.max(_is_browse()).alias("br"))
    return _traffic_of_pairs(s1, "ns")


def _traffic_of_pairs(pairs: DataFrame, new_sessions: str) -> DataFrame:
    """daily_traffic from rows by (keys, session, visitor): the distinct counts run on these reduced rows."""
    out = pair_distinct_counts(pairs, TRAFFIC_KEYS, ("unique_sessions", "session_id", F.col("br")),
                               ("unique_visitors", "visitor_id", F.lit(True)), {"page_views": "pv", "new_sessions": new_sessions})
    return out.select(*TRAFFIC_KEYS, "page_views", "unique_sessions", "unique_visitors", "new_sessions")


# ---------------------------------------------------------------------------------------
# VW-2 daily_orders
# ---------------------------------------------------------------------------------------
def deduped_orders(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK,
                   with_tenant: bool = True, bought: DataFrame | None = None) -> DataFrame:
    """One row per (shop[, tenant], day, order, type): max total, max session.

    The purchase that validates a cancel is looked up in all of bronze (no time bound), or in ``bought``."""
    ev = guarded_order_events(bronze, since=lower_bound(as_of, lookback), valid_since=None, bought=bought)
    keys = ["shop_id"] + (["tenant_id"] if with_tenant else []) + ["day", "order_id", "event_type"]
    return (ev.select("shop_id", "tenant_id", _day(), "order_id", "event_type",
                      "order_total_cents", "session_id")
              .groupBy(*keys)
              .agg(F.max("order_total_cents").alias("order_total_cents"),
                   F.max("session_id").alias("session_id")))


def daily_orders(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK) -> DataFrame:
    """Net orders and revenue per (shop, tenant, day); the average truncates toward zero."""
    return orders_from_dedup(deduped_orders(bronze, as_of, lookback))


# ---------------------------------------------------------------------------------------
# VW-3 daily_funnel
# ---------------------------------------------------------------------------------------
def daily_funnel(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK) -> DataFrame:
    """Distinct sessions per stage (stages are not ordered; cancels are ignored)."""
    b = _since(bronze, lower_bound(as_of, lookback)).select(
        "shop_id", "tenant_id", _day(), "session_id", "event_type")
    et = F.col("event_type")
    out = flag_distinct_counts(b, TRAFFIC_KEYS, "session_id", {
        "visits": _is_browse(),
        "product_views": et == "product_view",
        "add_to_cart": et == "add_to_cart",
        "checkout_starts": et == "checkout_start",
        "purchases": et == "purchase",
    })
    return out.select(*TRAFFIC_KEYS, "visits", "product_views", "add_to_cart",
                      "checkout_starts", "purchases")


# ---------------------------------------------------------------------------------------
# VW-4 daily_channel_attribution
# ---------------------------------------------------------------------------------------
def daily_channels(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK) -> DataFrame:
    """Sessions (session_start rows), raw purchase rows and their revenue per channel.

    Not deduplicated and not netted; the purchase event's own UTM gets the credit."""
    b = _since(bronze, lower_bound(as_of, lookback))
    is_p = F.col("event_type") == "purchase"
    return (b.select("shop_id", "tenant_id", _day(),
                     F.coalesce(F.col("utm_source"), F.lit("direct")).alias("channel"),
                     "utm_medium", "utm_campaign", "event_type", "order_total_cents")
             .groupBy(*TRAFFIC_KEYS, "channel", "utm_medium", "utm_campaign")
             .agg(F.count_if(F.col("event_type") == "session_start").alias("sessions"),
                  F.count_if(is_p).alias("orders"),
                  F.sum(F.when(is_p, F.col("order_total_cents"))).cast("long").alias("revenue_cents")))


# ---------------------------------------------------------------------------------------
# WN-1 session_geo and VW-5 daily_geo
# ---------------------------------------------------------------------------------------
GEO = ["geo_country", "geo_subject", "geo_city"]


def geo_rank() -> Column:
    """A browsing event's claim to be its session's canonical geo: the smallest one has it."""
    return F.struct(F.col("geo_country").isNull().alias("no_geo"), "created_at", "id", *GEO)


def session_days(bronze: DataFrame, as_of, lookback: str | None) -> DataFrame:
    """Per (shop, session): the canonical geo and the set of browsing days.

    Canonical geo = the earliest browsing event that has a country, else the earliest
    browsing event (ties broken by event id): ``min`` over a struct whose leading fields
    are the sort key, no window and no sort by time. The day set is bounded by the
    lookback window (at most ~400 days)."""
    b = (_since(bronze, lower_bound(as_of, lookback)).filter(_is_browse())
         .select("shop_id", "session_id", _day(), geo_rank().alias("m")))
    # one aggregation per session, partial map-side then final; together with the
    # collect_set it plans as an ObjectHashAggregate (hash-based, spills by sorting)
    return b.groupBy("shop_id", "session_id").agg(
        F.min("m").alias("m"), F.collect_set("day").alias("days"))


def session_geo(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK) -> DataFrame:
    return session_days(bronze, as_of, lookback).select(
        "shop_id", "session_id", *[F.col("m")[g].alias(g) for g in GEO])


def daily_geo(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK) -> DataFrame:
    """Sessions, net orders and revenue per (shop, day, country, subject, city).

    Each session maps to exactly one geo triple (its canonical browsing geo), each order to
    its session's triple (NULLs when unknown), so the counts are disjoint and additive."""
    return geo_of_sessions(session_days(bronze, as_of, lookback),
                           deduped_orders(bronze, as_of, lookback, with_tenant=False))


def without_tenant(dedup_with_tenant: DataFrame) -> DataFrame:
    """Per (shop, day, order, type) the max over tenants of the per-tenant maxima."""
    return dedup_with_tenant.groupBy("shop_id", "day", "order_id", "event_type").agg(
        F.max("order_total_cents").alias("order_total_cents"), F.max("session_id").alias("session_id"))


def geo_of_sessions(sd: DataFrame, oe: DataFrame) -> DataFrame:
    """daily_geo of sessions (canonical geo ``m``, browsing ``days``) and order rows by (shop, day, order, type)."""
    sg = sd.select("shop_id", "session_id", *[F.col("m")[g].alias(g) for g in GEO])
    sessions = (sd.select("shop_id", F.explode("days").alias("day"),
                          *[F.col("m")[g].alias(g) for g in GEO])
                  .groupBy("shop_id", "day", *GEO)
                  .agg(F.count(F.lit(1)).alias("sessions"),
                       F.lit(0).cast("long").alias("orders"),
                       F.lit(0).cast("long").alias("revenue_cents")))
    orders = (oe.join(sg, ["shop_id", "session_id"], "left")
                .groupBy("shop_id", "day", *GEO)
                .agg(*net_order_aggs())
                .select("shop_id", "day", *GEO, F.lit(0).cast("long").alias("sessions"),
                        F.col("order_count").alias("orders"),
                        F.col("total_revenue_cents").alias("revenue_cents")))
    return (sessions.unionByName(orders)
                    .groupBy("shop_id", "day", *GEO)
                    .agg(F.sum("sessions").cast("long").alias("sessions"),
                         F.sum("orders").cast("long").alias("orders"),
                         F.sum("revenue_cents").cast("long").alias("revenue_cents")))


# ---------------------------------------------------------------------------------------
# VW-6 dashboard_kpi
# ---------------------------------------------------------------------------------------
def dashboard_kpi(traffic: DataFrame, orders: DataFrame) -> DataFrame:
    """Traffic LEFT JOIN orders on (shop, day) - tenant is not part of the key.

    conversion_rate = round(orders / unique_sessions * 100, 2), uncapped."""
    o = orders.select("shop_id", "day", "order_count", "total_revenue_cents", "avg_order_cents")
    j = traffic.join(o, ["shop_id", "day"], "left")
    return j.select(
        "shop_id", "tenant_id", "day", "page_views", "unique_sessions", "unique_visitors",
        F.coalesce("order_count", F.lit(0)).cast("long").alias("order_count"),
        F.coalesce("total_revenue_cents", F.lit(0)).cast("long").alias("total_revenue_cents"),
        F.coalesce("avg_order_cents", F.lit(0)).cast("long").alias("avg_order_cents"),
        F.when(F.col("unique_sessions") > 0,
               pct_2dp("coalesce(order_count, 0)", "unique_sessions"))
        .otherwise(F.lit(0.0)).alias("conversion_rate"))


# ---------------------------------------------------------------------------------------
# VW-7 top_products
# ---------------------------------------------------------------------------------------
def top_products(bronze: DataFrame, as_of, lookback: str | None = TOP_PRODUCTS_LOOKBACK) -> DataFrame:
    """Net sales and revenue per (shop, tenant, product) over the lookback.

    The purchases that validate a cancel share the same bound, so a cancel whose purchase
    fell out of the window is an orphan here. Line items of one order are summed."""
    bound = lower_bound(as_of, lookback)
    ev = guarded_order_events(bronze, since=bound, valid_since=bound, require_order_id=False,
                              extra_filter=F.col("product_id").isNotNull())
    d = (ev.groupBy("shop_id", "tenant_id", "product_id", "order_id", "event_type")
           .agg(F.max("product_name").alias("product_name"),
                F.sum("product_price_cents").alias("product_price_cents")))
    is_p = F.col("event_type") == "purchase"
    is_c = F.col("event_type") == "order_cancel"
    return d.groupBy("shop_id", "tenant_id", "product_id").agg(
        F.max("product_name").alias("product_name"),
        (F.count_if(is_p) - F.count_if(is_c)).alias("sales_count"),
        (F.coalesce(F.sum(F.when(is_p, F.col("product_price_cents"))), F.lit(0))
         - F.coalesce(F.sum(F.when(is_c, F.col("product_price_cents"))), F.lit(0)))
        .cast("long").alias("total_revenue_cents"))


# ---------------------------------------------------------------------------------------
# mergeable uniques (AG-9, AG-10)
# ---------------------------------------------------------------------------------------
SKETCH_LG_K = 14


def daily_uniques(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK) -> DataFrame:
    """HyperLogLog sketches of each shop's and day's browsing sessions and visitors. Daily exact counts don't
    add up over days; these do, over any days, with a standard error of 0.6 %. At most 16 KB a sketch."""
    b = _since(bronze, lower_bound(as_of, lookback))
    return b.groupBy("shop_id", _day()).agg(
        F.hll_sketch_agg(F.when(_is_browse(), F.col("session_id")), SKETCH_LG_K).alias("sessions"),
        F.hll_sketch_agg("visitor_id", SKETCH_LG_K).alias("visitors"))


# ---------------------------------------------------------------------------------------
# VW-8 grain check and VW-9 reconciliation
# ---------------------------------------------------------------------------------------
GRAINS = {
    "daily_traffic": ["shop_id", "day"],
    "daily_orders": ["shop_id", "day"],
    "daily_funnel": ["shop_id", "day"],
    "daily_channel_attribution": ["shop_id", "day", "channel", "utm_medium", "utm_campaign"],
    "daily_geo": ["shop_id", "day", "geo_country", "geo_subject", "geo_city"],
    "dashboard_kpi": ["shop_id", "day"],
    "top_products": ["shop_id", "product_id"],
}


def grain_check(views: dict[str, DataFrame]) -> DataFrame:
    """Per view: rows, distinct grain keys (NULLs equal), largest group and the number of
    keys held by more than one row. A clean view has violations = 0."""
    parts = []
    for name, df in views.items():
        g = df.groupBy(*GRAINS[name]).count()
        parts.append(g.agg(
            F.sum("count").cast("long").alias("row_count"),
            F.count(F.lit(1)).alias("grain_keys"),
            F.coalesce(F.max("count"), F.lit(0)).cast("long").alias("max_rows_per_key"),
            F.count_if(F.col("count") > 1).alias("violations"))
            .select(F.lit(name).alias("view_name"), "*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def geo_reconcile(geo: DataFrame, traffic: DataFrame, orders: DataFrame) -> DataFrame:
    """Per (shop, day): daily_geo totals next to daily_traffic / daily_orders totals."""
    z = F.lit(0).cast("long")
    cols = ["geo_sessions", "traffic_sessions", "geo_orders", "view_orders",
            "geo_revenue_cents", "view_revenue_cents"]

    def side(df, **m):
        return df.select("shop_id", "day", *[(m[c] if c in m else z).alias(c) for c in cols])

    u = (side(geo, geo_sessions=F.col("sessions"), geo_orders=F.col("orders"),
              geo_revenue_cents=F.col("revenue_cents"))
         .unionByName(side(traffic, traffic_sessions=F.col("unique_sessions")))
         .unionByName(side(orders, view_orders=F.col("order_count"),
                           view_revenue_cents=F.col("total_revenue_cents"))))
    r = u.groupBy("shop_id", "day").agg(*[F.sum(c).cast("long").alias(c) for c in cols])
    return r.select("*",
                    (F.col("geo_sessions") - F.col("traffic_sessions")).alias("sessions_diff"),
                    (F.col("geo_orders") - F.col("view_orders")).alias("orders_diff"),
                    (F.col("geo_revenue_cents") - F.col("view_revenue_cents")).alias("revenue_diff"))


def all_views(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK,
              top_lookback: str | None = TOP_PRODUCTS_LOOKBACK) -> dict[str, DataFrame]:
    """The seven materialised views, silver first (lazy DataFrames)."""
    t = daily_traffic(bronze, as_of, lookback)
    o = daily_orders(bronze, as_of, lookback)
    return {
        "daily_traffic": t,
        "daily_orders": o,
        "daily_funnel": daily_funnel(bronze, as_of, lookback),
        "daily_channel_attribution": daily_channels(bronze, as_of, lookback),
        "daily_geo": daily_geo(bronze, as_of, lookback),
        "dashboard_kpi": dashboard_kpi(t, o),
        "top_products": top_products(bronze, as_of, top_lookback),
    }


# ---------------------------------------------------------------------------------------
# shared pass for the refresh: one bronze scan for traffic, funnel and channels
# ---------------------------------------------------------------------------------------
GRAIN_KEYS = TRAFFIC_KEYS + ["session_id", "visitor_id", "channel", "utm_medium", "utm_campaign"]


def activity_grain(bronze: DataFrame, as_of, lookback: str | None = DAILY_LOOKBACK) -> DataFrame:
    """Events collapsed to (shop, tenant, day, session, visitor, channel, medium, campaign)
    with the per-type counts the three browsing views need. Usually far smaller than
    bronze (a session's events share visitor and landing UTM), so it is written once and
    the views are derived from it instead of scanning bronze three times."""
    et = F.col("event_type")
    is_p = et == "purchase"
    b = _since(bronze, lower_bound(as_of, lookback)).select(
        "shop_id", "tenant_id", _day(), "session_id", "visitor_id",
        F.coalesce(F.col("utm_source"), F.lit("direct")).alias("channel"), "utm_medium", "utm_campaign",
        "event_type", "order_total_cents")
    return b.groupBy(*GRAIN_KEYS).agg(
        F.count_if(et == "page_view").alias("pv"),
        F.count_if(et == "session_start").alias("ss"),
        F.max(_is_browse()).alias("br"),
        F.max(et == "product_view").alias("f_pv"),
        F.max(et == "add_to_cart").alias("f_ac"),
        F.max(et == "checkout_start").alias("f_cs"),
        F.max(is_p).alias("f_pu"),
        F.count_if(is_p).alias("purchases"),
        F.sum(F.when(is_p, F.col("order_total_cents"))).alias("rev"),
        F.count(F.when(is_p, F.col("order_total_cents"))).alias("rev_n"))


def traffic_from_grain(g: DataFrame) -> DataFrame:
    return _traffic_of_pairs(g, "ss")


def funnel_from_grain(g: DataFrame) -> DataFrame:
    per_session = g.groupBy(*TRAFFIC_KEYS, "session_id").agg(
        *[F.max(F.col(c).cast("int")).alias(n) for c, n in (
            ("br", "visits"), ("f_pv", "product_views"), ("f_ac", "add_to_cart"),
            ("f_cs", "checkout_starts"), ("f_pu", "purchases"))])
    names = ["visits", "product_views", "add_to_cart", "checkout_starts", "purchases"]
    return per_session.groupBy(*TRAFFIC_KEYS).agg(*[F.sum(n).cast("long").alias(n) for n in names])


def channels_from_grain(g: DataFrame) -> DataFrame:
    return g.groupBy(*TRAFFIC_KEYS, "channel", "utm_medium", "utm_campaign").agg(
        F.sum("ss").cast("long").alias("sessions"),
        F.sum("purchases").cast("long").alias("orders"),
        F.when(F.sum("rev_n") > 0, F.sum("rev")).cast("long").alias("revenue_cents"))


def orders_from_dedup(d: DataFrame) -> DataFrame:
    """daily_orders from the deduplicated order rows (with tenant)."""
    agg = d.groupBy(*TRAFFIC_KEYS).agg(
        *net_order_aggs(),
        F.count_distinct(F.when(F.col("event_type") == "purchase", F.col("session_id")))
        .alias("ordering_sessions"))
    return agg.select(
        *TRAFFIC_KEYS, "order_count", "total_revenue_cents",
        F.when(F.col("order_count") > 0, div_trunc("total_revenue_cents", "order_count"))
        .otherwise(F.lit(0).cast("long")).alias("avg_order_cents"),
        "ordering_sessions")
