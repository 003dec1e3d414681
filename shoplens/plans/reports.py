"""Report functions over the views (and bronze for the live paths).

Each report is one job for **all shops**, keyed by ``shop_id``; the single-shop call
of the original service is the same plan with ``shop_id=`` given (a filter that Catalyst
pushes below the aggregations). Windows are resolved on the driver
(:mod:`shoplens.functions.periods`) and enter the plan as literals.

Reports that the service returns for every shop even without data (KPIs, summaries,
dense series) are left-joined to a shop list: the ``shops`` dimension where one is given, so a
shop without any event gets zeros too; else the one shop asked for, or the shops of the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import BROWSE_TYPES, FUNNEL_STAGES, INTRADAY_BUCKET_SECONDS
from ..functions.periods import parse_instant, previous_range, resolve_range, sql_ts
from ..functions.rates import (conversion_pct, div_round_half_away, pct_2dp, round_ratio_pct,
                               round_share, safe_rate)
from ..operators.densify import densify_buckets, densify_days
from ..operators.distinct import pair_distinct_counts
from ..operators.orphan_guard import guarded_order_events, net_order_aggs
from ..operators.topk import clamp_limit, top_k, top_k_per_group
from ..sources.bronze import scan_filter

Win = tuple[dt.datetime, dt.datetime]


def window(period: str, as_of, from_: str | None = None, to: str | None = None) -> Win:
    return resolve_range(period, parse_instant(as_of), from_, to)


def _days(df: DataFrame, w: Win) -> DataFrame:
    return df.filter((F.col("day") >= F.lit(w[0].date())) & (F.col("day") < F.lit(w[1].date())))


def _in_window(df: DataFrame, w: Win) -> Column:
    """Half-open window on created_at; on a partitioned bronze table the month predicate is
    added too, so only the window's month directories are listed and read."""
    if "event_month" in df.columns:
        return scan_filter(w[0], w[1])
    lo = F.to_timestamp(F.lit(sql_ts(w[0])))
    hi = F.to_timestamp(F.lit(sql_ts(w[1])))
    return (F.col("created_at") >= lo) & (F.col("created_at") < hi)


def _created(df: DataFrame, w: Win) -> DataFrame:
    return df.filter(_in_window(df, w))


def _shop(df: DataFrame, shop_id: str | None) -> DataFrame:
    return df if shop_id is None else df.filter(F.col("shop_id") == shop_id)


def shops_of(df: DataFrame, shop_id: str | None = None) -> DataFrame:
    """The shop list a report is produced for (one partial aggregate, tiny output)."""
    return _shop(df, shop_id).select("shop_id").distinct()


def _shop_list(df: DataFrame, shop_id: str | None, shops: DataFrame | None) -> DataFrame:
    """Who a report answers for: the given shop dimension, else the one shop asked for, else the
    shops of ``df``. A shop without events gets its zeros in the first two cases."""
    if shops is not None:
        return shops_of(shops, shop_id)
    if shop_id is not None:
        return df.sparkSession.range(1).select(F.lit(shop_id).alias("shop_id"))
    return shops_of(df)


def _zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0, subset=cols)


# ---------------------------------------------------------------------------------------
# KPI (RPT-1, RPT-8)
# ---------------------------------------------------------------------------------------
KPI_COLS = ["total_revenue_cents", "total_orders", "avg_order_cents", "unique_visitors",
            "unique_sessions", "page_views", "conversion_rate"]


def _kpi_aggs() -> list[Column]:
    return [
        F.sum("total_revenue_cents").alias("rev"), F.sum("order_count").alias("oc"),
        F.sum("unique_visitors").alias("uv"), F.sum("unique_sessions").alias("us"),
        F.sum("page_views").alias("pv"),
        F.sum(F.when(F.col("unique_visitors") > 0, F.col("order_count")).otherwise(0)).alias("oc_v"),
    ]


def _kpi_select(keys: list[str]) -> list[Column]:
    return [*keys,
            F.coalesce("rev", F.lit(0)).cast("long").alias("total_revenue_cents"),
            F.coalesce("oc", F.lit(0)).cast("long").alias("total_orders"),
            F.when(F.col("oc") > 0, div_round_half_away("rev", "oc"))
             .otherwise(F.lit(0).cast("long")).alias("avg_order_cents"),
            F.coalesce("uv", F.lit(0)).cast("long").alias("unique_visitors"),
            F.coalesce("us", F.lit(0)).cast("long").alias("unique_sessions"),
            F.coalesce("pv", F.lit(0)).cast("long").alias("page_views"),
            F.when(F.col("uv") > 0, F.least(pct_2dp("oc_v", "uv"), F.lit(100.0)))
             .otherwise(F.lit(0.0)).alias("conversion_rate")]


def kpi_windows(kpi: DataFrame, period: str, as_of, from_: str | None = None,
                to: str | None = None, shop_id: str | None = None,
                per_shop: bool = True, shops: DataFrame | None = None) -> DataFrame:
    """KPIs of the window and of the previous window in **one** pass over gold.

    The two windows never overlap (the previous one ends where the current starts), so
    each daily row is labelled with at most one window and aggregated once."""
    cur = window(period, as_of, from_, to)
    prev = previous_range(period, cur[0])
    g = _shop(kpi, shop_id)
    d = F.col("day")
    lab = (F.when((d >= F.lit(cur[0].date())) & (d < F.lit(cur[1].date())), F.lit("current"))
            .when((d >= F.lit(prev[0].date())) & (d < F.lit(prev[1].date())), F.lit("previous")))
    keys = ["shop_id", "window_name"] if per_shop else ["window_name"]
    agg = g.withColumn("window_name", lab).filter(F.col("window_name").isNotNull()).groupBy(*keys).agg(*_kpi_aggs())
    labels = F.explode(F.array(F.lit("current"), F.lit("previous"))).alias("window_name")
    grid = _shop_list(kpi, shop_id, shops).select("shop_id", labels) if per_shop else \
        kpi.sparkSession.range(1).select(labels)
    return grid.join(agg, keys, "left").select(*_kpi_select(keys))


def kpi_series(kpi: DataFrame, period: str, as_of, from_=None, to=None, shop_id=None,
               per_shop: bool = True, shops: DataFrame | None = None) -> DataFrame:
    """Dense daily series of the window (zeros on days without rows)."""
    w = window(period, as_of, from_, to)
    vals = ["total_revenue_cents", "total_orders", "unique_visitors", "unique_sessions", "page_views"]
    keys = ["shop_id"] if per_shop else []
    facts = (_days(_shop(kpi, shop_id), w).groupBy(*keys, "day").agg(
        F.sum("total_revenue_cents").cast("long").alias("total_revenue_cents"),
        F.sum("order_count").cast("long").alias("total_orders"),
        F.sum("unique_visitors").cast("long").alias("unique_visitors"),
        F.sum("unique_sessions").cast("long").alias("unique_sessions"),
        F.sum("page_views").cast("long").alias("page_views")))
    base = _shop_list(kpi, shop_id, shops) if per_shop else kpi.sparkSession.range(1).select()
    return densify_days(base, facts, keys, w[0], w[1], vals).select(*keys, "day", *vals)


def intraday_buckets(bronze: DataFrame, start: dt.datetime, end: dt.datetime,
                     shop_id: str | None = None, per_shop: bool = True,
                     shops: DataFrame | None = None) -> DataFrame:
    """Two-hour UTC buckets of [start, end), live from bronze, zero-filled.

    Orders are deduplicated per (bucket, shop, order, type); a cancel counts only when a
    purchase for the order exists anywhere in bronze (no window on that lookup)."""
    b = _created(_shop(bronze, shop_id), (start, end))
    ev = guarded_order_events(_shop(bronze, shop_id), valid_since=None,
                              extra_filter=_in_window(bronze, (start, end)))
    base = _shop_list(b, shop_id, shops) if per_shop else bronze.sparkSession.range(1).select()
    return buckets_of(slot_pairs(b), slot_orders(ev), base, start, end, per_shop)


def _bucket() -> Column:
    return F.floor(F.unix_micros("created_at") / F.lit(INTRADAY_BUCKET_SECONDS * 1_000_000)).alias("bucket_idx")


def slot_pairs(events: DataFrame) -> DataFrame:
    """Events by (shop, bucket, session, visitor): page views, and whether any was a browsing event."""
    et = F.col("event_type")
    return events.select("shop_id", _bucket(), "session_id", "visitor_id", "event_type") \
        .groupBy("shop_id", "bucket_idx", "session_id", "visitor_id") \
        .agg(F.count_if(et == "page_view").alias("pv"), F.max(et.isin(*BROWSE_TYPES)).alias("br"))


def slot_orders(order_events: DataFrame) -> DataFrame:
    """Order events by (shop, bucket, order, type), with the largest total."""
    return order_events.select("shop_id", _bucket(), "order_id", "event_type", "order_total_cents") \
        .groupBy("shop_id", "bucket_idx", "order_id", "event_type").agg(F.max("order_total_cents").alias("order_total_cents"))


def buckets_of(pairs: DataFrame, orders: DataFrame, base: DataFrame, start: dt.datetime, end: dt.datetime,
               per_shop: bool = True) -> DataFrame:
    """The buckets of [start, end) from ``slot_pairs`` and counted ``slot_orders``, zero-filled for ``base``."""
    kcols = ["shop_id"] if per_shop else []
    keys = [*kcols, "bucket_idx"]
    none = F.lit(0).cast("long")
    traffic = pair_distinct_counts(pairs, keys, ("unique_sessions", "session_id", F.col("br")),
                                   ("unique_visitors", "visitor_id", F.lit(True)), {"page_views": "pv"}).withColumns(
        {c: none for c in ("total_orders", "total_revenue_cents")})
    net = orders.groupBy(*keys).agg(*net_order_aggs()).select(
        *keys, *[none.alias(c) for c in ("page_views", "unique_sessions", "unique_visitors")],
        F.col("order_count").alias("total_orders"), "total_revenue_cents")
    vals = ["total_revenue_cents", "total_orders", "unique_visitors", "unique_sessions", "page_views"]
    facts = traffic.unionByName(net).groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in vals])
    return densify_buckets(base, facts, kcols, start, end, INTRADAY_BUCKET_SECONDS, vals).select(*kcols, "bucket_idx", "slot", *vals)


def dashboard_series(kpi: DataFrame, bronze: DataFrame, period: str, as_of, from_=None, to=None,
                     shop_id=None, per_shop: bool = True, shops: DataFrame | None = None) -> DataFrame:
    """The dashboard's series: intraday buckets for a single day still in bronze,
    otherwise dense days from gold (the choice is made on the driver)."""
    from ..functions.periods import use_intraday
    w = window(period, as_of, from_, to)
    if use_intraday(w[0], w[1], parse_instant(as_of)):
        return intraday_buckets(bronze, w[0], w[1], shop_id, per_shop, shops)
    return kpi_series(kpi, period, as_of, from_, to, shop_id, per_shop, shops)


# ---------------------------------------------------------------------------------------
# traffic (RPT-2)
# ---------------------------------------------------------------------------------------
def traffic_summary(traffic: DataFrame, w: Win, shop_id=None, shops: DataFrame | None = None) -> DataFrame:
    agg = _days(_shop(traffic, shop_id), w).groupBy("shop_id").agg(
        F.sum("unique_visitors").cast("long").alias("total_visitors"),
        F.sum("unique_sessions").cast("long").alias("total_sessions"),
        F.sum("page_views").cast("long").alias("total_page_views"))
    return _zero_fill(_shop_list(traffic, shop_id, shops).join(agg, "shop_id", "left"),
                      ["total_visitors", "total_sessions", "total_page_views"])


def traffic_series(traffic: DataFrame, w: Win, shop_id=None, shops: DataFrame | None = None) -> DataFrame:
    vals = ["visitors", "sessions", "page_views"]
    facts = _days(_shop(traffic, shop_id), w).groupBy("shop_id", "day").agg(
        F.sum("unique_visitors").cast("long").alias("visitors"),
        F.sum("unique_sessions").cast("long").alias("sessions"),
        F.sum("page_views").cast("long").alias("page_views"))
    return densify_days(_shop_list(traffic, shop_id, shops), facts, ["shop_id"], w[0], w[1], vals)


def window_uniques(uniques: DataFrame, w: Win, shop_id=None, shops: DataFrame | None = None) -> DataFrame:
    """Unique sessions and visitors of the whole window, from the daily sketches (``views.daily_uniques``)."""
    agg = _days(_shop(uniques, shop_id), w).groupBy("shop_id").agg(
        F.hll_sketch_estimate(F.hll_union_agg("sessions")).alias("sessions"),
        F.hll_sketch_estimate(F.hll_union_agg("visitors")).alias("visitors"))
    return _zero_fill(_shop_list(uniques, shop_id, shops).join(agg, "shop_id", "left"), ["sessions", "visitors"])


def top_pages(bronze: DataFrame, w: Win, shop_id=None, limit: int = 10) -> DataFrame:
    pages = (_created(_shop(bronze, shop_id), w)
             .filter((F.col("event_type") == "page_view") & F.col("page_url").isNotNull())
             .groupBy("shop_id", "page_url")
             .agg(F.count(F.lit(1)).alias("views"),
                  F.count_distinct("visitor_id").alias("unique_visitors")))
    return top_k_per_group(pages, ["shop_id"], "views", ["page_url"], limit)


def top_referrers(bronze: DataFrame, w: Win, shop_id=None, limit: int = 10) -> DataFrame:
    refs = (_created(_shop(bronze, shop_id), w)
            .filter(F.col("event_type").isin(*BROWSE_TYPES))
            .select("shop_id", F.coalesce("referrer", F.lit("direct")).alias("referrer"), "session_id")
            .groupBy("shop_id", "referrer")
            .agg(F.count_distinct("session_id").alias("sessions")))
    return top_k_per_group(refs, ["shop_id"], "sessions", ["referrer"], limit)


# ---------------------------------------------------------------------------------------
# revenue (RPT-3)
# ---------------------------------------------------------------------------------------
def revenue_summary(orders: DataFrame, w: Win, shop_id=None, shops: DataFrame | None = None) -> DataFrame:
    agg = _days(_shop(orders, shop_id), w).groupBy("shop_id").agg(
        F.sum("total_revenue_cents").alias("rev"), F.sum("order_count").alias("oc"))
    j = _shop_list(orders, shop_id, shops).join(agg, "shop_id", "left")
    return j.select(
        "shop_id",
        F.coalesce("rev", F.lit(0)).cast("long").alias("total_revenue_cents"),
        F.coalesce("oc", F.lit(0)).cast("long").alias("total_orders"),
        F.when(F.col("oc") > 0, div_round_half_away("rev", "oc"))
         .otherwise(F.lit(0).cast("long")).alias("avg_order_cents"),
        F.coalesce("rev", F.lit(0)).cast("long").alias("net_revenue_cents"))


def revenue_series(orders: DataFrame, w: Win, shop_id=None, shops: DataFrame | None = None) -> DataFrame:
    vals = ["revenue_cents", "orders", "avg_cents"]
    facts = _days(_shop(orders, shop_id), w).groupBy("shop_id", "day").agg(
        F.sum("total_revenue_cents").cast("long").alias("revenue_cents"),
        F.sum("order_count").cast("long").alias("orders"),
        F.max("avg_order_cents").cast("long").alias("avg_cents"))
    return densify_days(_shop_list(orders, shop_id, shops), facts, ["shop_id"], w[0], w[1], vals)


# ---------------------------------------------------------------------------------------
# funnel (RPT-4, RPT-9)
# ---------------------------------------------------------------------------------------
def funnel_report(traffic: DataFrame, funnel: DataFrame, w: Win, shop_id=None,
                  per_shop: bool = True, shops: DataFrame | None = None) -> DataFrame:
    """Stage 1 = sum of daily unique visitors (100 %); the others are sums of daily
    distinct sessions with a rate against stage 1, capped at 100."""
    keys = ["shop_id"] if per_shop else []
    z = F.lit(0).cast("long")
    names = [n for n, _ in FUNNEL_STAGES]
    t = _days(_shop(traffic, shop_id), w).select(
        *keys, F.col("unique_visitors").alias("visits"), *[z.alias(n) for n in names[1:]])
    f = _days(_shop(funnel, shop_id), w).select(*keys, z.alias("visits"), *names[1:])
    tot = t.unionByName(f).groupBy(*keys).agg(*[F.sum(n).cast("long").alias(n) for n in names])
    if per_shop:
        tot = _shop_list(traffic, shop_id, shops).join(tot, keys, "left")
    tot = _zero_fill(tot, names)
    stages = F.array(*[F.struct(F.lit(i + 1).alias("stage_order"), F.lit(n).alias("stage"),
                                F.lit(lbl).alias("label"), F.col(n).alias("count"))
                       for i, (n, lbl) in enumerate(FUNNEL_STAGES)])
    out = tot.select(*keys, F.col("visits").alias("_total"), F.inline(stages))
    return out.select(*keys, "stage_order", "stage", "label", "count",
                      F.when(F.col("stage_order") == 1, F.lit(100.0))
                       .otherwise(safe_rate("count", "_total")).alias("rate"))


# ---------------------------------------------------------------------------------------
# channels (RPT-5)
# ---------------------------------------------------------------------------------------
def channels_report(channels: DataFrame, w: Win, shop_id=None) -> DataFrame:
    """Per channel, most sessions first: ``position`` counts from 1 within the shop (ties by name)."""
    agg = _days(_shop(channels, shop_id), w).groupBy("shop_id", "channel").agg(
        F.coalesce(F.sum("sessions"), F.lit(0)).cast("long").alias("sessions"),
        F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("orders"),
        F.coalesce(F.sum("revenue_cents"), F.lit(0)).cast("long").alias("revenue_cents"))
    order = Window.partitionBy("shop_id").orderBy(F.desc("sessions"), "channel")
    return agg.withColumn("conversion_rate", conversion_pct("orders", "sessions")) \
        .withColumn("position", F.row_number().over(order).cast("long"))


def channels_series(channels: DataFrame, w: Win, shop_id=None) -> DataFrame:
    """Per day and channel (sparse: only days with rows, as the service returns them)."""
    return _days(_shop(channels, shop_id), w).groupBy("shop_id", "day", "channel").agg(
        F.coalesce(F.sum("sessions"), F.lit(0)).cast("long").alias("sessions"),
        F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("orders"),
        F.coalesce(F.sum("revenue_cents"), F.lit(0)).cast("long").alias("revenue_cents"))


def channels_document(channels: DataFrame, w: Win, shop_id=None) -> DataFrame:
    """The nested reply per shop as JSON: channels sorted by sessions, and per day the
    channels of that day. Arrays hold aggregated rows (channels x days of the window)."""
    rep = channels_report(channels, w, shop_id)
    ser = channels_series(channels, w, shop_id)
    ch = rep.groupBy("shop_id").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("sessions")).alias("_k"), F.col("channel").alias("source"), "sessions", "orders",
        "revenue_cents", "conversion_rate"))).alias("channels"))
    per_day = ser.groupBy("shop_id", "day").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("sessions")).alias("_k"), F.col("channel").alias("source"), "sessions", "orders",
        "revenue_cents", F.lit(0.0).alias("conversion_rate")))).alias("channels"))
    ts = per_day.groupBy("shop_id").agg(F.sort_array(F.collect_list(F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "channels"))).alias("time_series"))
    strip = "x -> struct(x.source as source, x.sessions as sessions, x.orders as orders, " \
            "x.revenue_cents as revenue_cents, x.conversion_rate as conversion_rate)"
    doc = ch.join(ts, "shop_id", "full")
    return doc.select("shop_id", F.to_json(F.struct(
        F.coalesce(F.expr(f"transform(channels, {strip})"), F.array()).alias("channels"),
        F.coalesce(F.expr(f"transform(time_series, t -> struct(t.day as day, "
                          f"transform(t.channels, {strip}) as channels))"), F.array())
        .alias("time_series"))).alias("document"))


# ---------------------------------------------------------------------------------------
# products and shops (RPT-6, RPT-10, RPT-11)
# ---------------------------------------------------------------------------------------
def top_products_report(products: DataFrame, sort: str = "sales", limit: int | None = 10,
                        shop_id=None) -> DataFrame:
    """Per shop top products from the view (the period is ignored, as in the service)."""
    metric = "total_revenue_cents" if sort == "revenue" else "sales_count"
    p = _shop(products, shop_id).select("shop_id", "product_id", "product_name", "sales_count",
                                        "total_revenue_cents")
    return top_k_per_group(p, ["shop_id"], metric, ["product_id"], clamp_limit(limit))


def global_top_products(products: DataFrame, sort: str = "sales", limit: int | None = 10) -> DataFrame:
    metric = "total_revenue_cents" if sort == "revenue" else "sales_count"
    g = products.groupBy("product_id").agg(
        F.min("product_name").alias("product_name"),
        F.sum("sales_count").cast("long").alias("sales_count"),
        F.sum("total_revenue_cents").cast("long").alias("total_revenue_cents"))
    return top_k(g, metric, ["product_id"], clamp_limit(limit))


def top_shops(kpi: DataFrame, w: Win, sort: str = "revenue", limit: int | None = 10) -> DataFrame:
    metric = "total_orders" if sort == "orders" else "total_revenue_cents"
    g = _days(kpi, w).groupBy("shop_id").agg(
        F.coalesce(F.sum("total_revenue_cents"), F.lit(0)).cast("long").alias("total_revenue_cents"),
        F.coalesce(F.sum("order_count"), F.lit(0)).cast("long").alias("total_orders"),
        F.coalesce(F.sum("unique_visitors"), F.lit(0)).cast("long").alias("unique_visitors"))
    return top_k(g, metric, ["shop_id"], clamp_limit(limit))


def active_shops(kpi: DataFrame, w: Win, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """Shops with any activity in the window; ``approx`` uses a HyperLogLog++ sketch
    (one mergeable register array per task instead of a shuffle of the distinct keys)."""
    act = (F.col("total_revenue_cents") > 0) | (F.col("order_count") > 0) | (F.col("unique_visitors") > 0)
    cnt = F.approx_count_distinct("shop_id", rsd) if approx else F.count_distinct("shop_id")
    return _days(kpi, w).filter(act).agg(cnt.alias("active_shops_count"))


# ---------------------------------------------------------------------------------------
# returning customers (RPT-7)
# ---------------------------------------------------------------------------------------
def returning_customers(bronze: DataFrame, w: Win, shop_id=None, shops: DataFrame | None = None) -> DataFrame:
    in_window = _created(_shop(bronze, shop_id), w)
    p = in_window.filter((F.col("event_type") == "purchase") & F.col("visitor_id").isNotNull()
                         & F.col("order_id").isNotNull())
    # distinct orders per visitor: the first aggregation is on (shop, visitor, order), so a
    # hot shop is spread over its visitors
    per_visitor = (p.select("shop_id", "visitor_id", "order_id").distinct()
                    .groupBy("shop_id", "visitor_id").agg(F.count(F.lit(1)).alias("n")))
    agg = per_visitor.groupBy("shop_id").agg(
        F.count(F.lit(1)).alias("total_buyers"), F.count_if(F.col("n") > 1).alias("repeat_buyers"))
    j = _zero_fill(_shop_list(in_window, shop_id, shops).join(agg, "shop_id", "left"),
                   ["total_buyers", "repeat_buyers"])
    return j.withColumn("repeat_rate", round_ratio_pct("repeat_buyers", "total_buyers"))


# ---------------------------------------------------------------------------------------
# by location (RPT-12, RPT-13)
# ---------------------------------------------------------------------------------------
LEVELS = {
    "country": ["geo_country"],
    "subject": ["geo_country", "geo_subject"],
    "city": ["geo_country", "geo_subject", "geo_city"],
}


def by_location(geo: DataFrame, w: Win, level: str = "subject", limit: int | None = 100,
                shop_id: str | None = None, per_shop: bool = False) -> DataFrame:
    """Sessions and net orders by geo level with the share of **all** sessions of the
    window (computed before the limit). Three text columns always; NULL geo -> ''.

    The denominator is one aggregate joined back by key (per shop, or a one-row global
    total), never a window over the whole table."""
    grp = LEVELS.get(level, LEVELS["subject"])
    lim = clamp_limit(limit, 100, 500)
    g = _days(_shop(geo, shop_id), w)
    keys = ["shop_id"] if per_shop else []
    agg = g.groupBy(*keys, *grp).agg(F.sum("sessions").cast("long").alias("sessions"),
                                     F.sum("orders").cast("long").alias("orders"))
    out = agg.select(*keys,
                     *[(F.coalesce(F.col(c), F.lit("")) if c in grp else F.lit("")).alias(a)
                       for c, a in (("geo_country", "country"), ("geo_subject", "subject"),
                                    ("geo_city", "city"))],
                     "sessions", "orders")
    total = F.coalesce(F.sum("sessions"), F.lit(0)).cast("long").alias("total_sessions")
    if per_shop:
        ranked = top_k_per_group(out, ["shop_id"], "sessions", ["country", "subject", "city"], lim)
        res = ranked.join(g.groupBy("shop_id").agg(total), "shop_id", "inner")
    else:
        # one global number: a scalar subquery, evaluated once and inlined as a value
        ranked = top_k(out, "sessions", ["country", "subject", "city"], lim)
        res = ranked.withColumn("total_sessions", g.agg(total).scalar())
    return res.withColumn("share", round_share("sessions", "total_sessions"))


def by_location_levels(geo: DataFrame, w: Win, limit: int | None = 100) -> DataFrame:
    """All three levels in one aggregation: ``rollup(country, subject, city)`` yields the
    city, subject and country groupings plus the grand total, which is the share
    denominator (taken as a scalar). Top ``limit`` per level."""
    lim = clamp_limit(limit, 100, 500)
    g = _days(geo, w)
    r = (g.rollup("geo_country", "geo_subject", "geo_city")
          .agg(F.sum("sessions").cast("long").alias("sessions"), F.sum("orders").cast("long").alias("orders"),
               F.grouping_id().alias("gid")))
    total = r.filter(F.col("gid") == 7).select(F.coalesce("sessions", F.lit(0)).cast("long")).scalar()
    lvl = F.when(F.col("gid") == 0, "city").when(F.col("gid") == 1, "subject").otherwise("country")
    out = r.filter(F.col("gid") != 7).select(
        lvl.alias("level"), F.coalesce("geo_country", F.lit("")).alias("country"),
        F.when(F.col("gid") <= 1, F.coalesce("geo_subject", F.lit(""))).otherwise(F.lit("")).alias("subject"),
        F.when(F.col("gid") == 0, F.coalesce("geo_city", F.lit(""))).otherwise(F.lit("")).alias("city"),
        "sessions", "orders")
    ranked = top_k_per_group(out, ["level"], "sessions", ["country", "subject", "city"], lim)
    return ranked.withColumn("total_sessions", total).withColumn(
        "share", round_share("sessions", "total_sessions"))
