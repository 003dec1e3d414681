"""Bridges from the driver-generated tables to the bronze event schema.

Two mappings turn the generic test tables into shop clickstreams:

* ``events_bronze``   - the ``events`` table as browsing + order traffic of 5 shops
* ``commerce_bronze`` - ``orders``/``lineitem``/``customer``/``part`` as purchases,
                        cancels and page views of 10 shops (load test shape)

Both are plain projections/joins; Catalyst prunes the parquet columns and pushes the
filters of the consuming view down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: as-of instants the bridges are evaluated at --------------------------
EVENTS_AS_OF = "2024-01-30 23:59:59"
COMMERCE_AS_OF = "2001-08-03 00:00:00"

BRONZE_COLUMNS = (
    "id", "shop_id", "tenant_id", "session_id", "visitor_id", "event_type",
    "page_url", "page_title", "referrer", "utm_source", "utm_medium", "utm_campaign",
    "product_id", "product_name", "product_price_cents", "order_id", "order_total_cents",
    "event_timestamp", "created_at", "cost_price_cents", "category_id",
    "geo_country", "geo_subject", "geo_city", "event_month",
)

def shop_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shop dimension, from ``nation``: the bridges' shops and others that never had an event."""
    n = spark.read.parquet(f"{sf_dir.rstrip('/')}/nation.parquet")
    return n.select(F.concat(F.lit("shop_"), F.col("n_nationkey").cast("string")).alias("shop_id"))


# six-hour session slots, shifted by three hours so that some sessions cross midnight
_SLOT_US = 21600 * 1_000_000
_SHIFT_US = 10800 * 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cents(c: Column) -> Column:
    """Money in integer cents; zero is stored as NULL like the ingest does."""
    return F.nullif(F.round(c * 100).cast("int"), F.lit(0))


def _finish(df: DataFrame) -> DataFrame:
    return (df.withColumn("event_month", F.trunc(F.to_date("created_at"), "MM"))
              .select(*BRONZE_COLUMNS))


def events_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze events derived from the ``events`` table (the default bridge)."""
    return _finish(_events_rows(spark, sf_dir))


def events_bronze_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridge rows plus the source columns (event_id, user_id, value)."""
    return _events_rows(spark, sf_dir, keep_source=True).withColumn(
        "event_month", F.trunc(F.to_date("created_at"), "MM"))


def _events_rows(spark: SparkSession, sf_dir: str, keep_source: bool = False) -> DataFrame:
    ev = _table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    u7 = uid % 7
    no_geo = (eid % 3) == 0
    event_type = (F.when(et == "view", "page_view")
                  .when(et == "signup", "session_start")
                  .when(et == "purchase", "purchase")
                  .when(et == "error", "order_cancel")
                  .when(et == "click", F.element_at(
                      F.array(*[F.lit(x) for x in ("product_view", "add_to_cart",
                                                   "remove_from_cart", "checkout_start")]),
                      (eid % 4 + 1).cast("int"))))
    has_product = et.isin("purchase", "error", "click")
    is_order = et.isin("purchase", "error")
    out = ev.select(
        eid.cast("string").alias("id"),
        F.concat(F.lit("shop_"), (uid % 5).cast("string")).alias("shop_id"),
        F.concat(F.lit("tenant_"), ((uid % 5) % 2).cast("string")).alias("tenant_id"),
        F.concat(F.lit("sess_"), uid.cast("string"), F.lit("_"),
                 F.expr(f"(unix_micros(cast(ts as timestamp)) + {_SHIFT_US}) div {_SLOT_US}")
                 .cast("string")).alias("session_id"),
        F.when(eid % 17 != 0, F.concat(F.lit("vis_"), uid.cast("string"))).alias("visitor_id"),
        event_type.alias("event_type"),
        F.when(eid % 31 != 0, F.concat(F.lit("/p/"), (eid % 40).cast("string"))).alias("page_url"),
        F.lit(None).cast("string").alias("page_title"),
        (F.when(eid % 5 == 0, "https://ya.ru/")
          .when(eid % 5 == 1, "https://vk.com/")
          .when(eid % 5 == 2, F.concat(F.lit("https://r"), (uid % 20).cast("string"),
                                       F.lit(".example/")))).alias("referrer"),
        (F.when(eid % 6 == 0, "google").when(eid % 6 == 1, "yandex")
          .when(eid % 6 == 2, "vk")).alias("utm_source"),
        F.when(eid % 6 == 0, "cpc").when(eid % 6 == 1, "organic").alias("utm_medium"),
        F.when(eid % 12 == 0, "winter").alias("utm_campaign"),
        F.when(has_product & (eid % 29 != 0),
               F.concat(F.lit("prod_"), (eid % 50).cast("string"))).alias("product_id"),
        F.when(has_product & (eid % 29 != 0),
               F.concat(F.lit("Product "), (eid % 50).cast("string"))).alias("product_name"),
        F.when(has_product, _cents(F.col("value"))).alias("product_price_cents"),
        F.when(is_order & (eid % 23 != 0),
               F.concat(F.lit("ord_"), (eid % 200).cast("string"))).alias("order_id"),
        F.when(is_order, _cents(F.col("value"))).alias("order_total_cents"),
        ts.alias("event_timestamp"),
        ts.alias("created_at"),
        F.lit(None).cast("int").alias("cost_price_cents"),
        F.lit(None).cast("string").alias("category_id"),
        F.when(~no_geo & (u7 != 0), F.when(u7 <= 4, "RU").otherwise("US")).alias("geo_country"),
        F.when(~no_geo, F.when(u7 == 1, "Moscow").when(u7 == 2, "SPb")
               .when(u7.isin(3, 4), "Respublika Krym")).alias("geo_subject"),
        F.when(~no_geo & u7.isin(1, 2, 3),
               F.concat(F.lit("city_"), u7.cast("string"))).alias("geo_city"),
        *([eid.alias("event_id"), uid.alias("user_id"), F.col("value")] if keep_source else []),
    )
    return out


def commerce_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze events derived from the TPC-H-like order tables (purchase per line item,
    a cancel for some pending orders one day later, one page view per order)."""
    o = _table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    oc = o.join(c, o.o_custkey == c.c_custkey, "inner")
    base = [
        F.concat(F.lit("shop_"), (F.col("c_nationkey") % 10).cast("string")).alias("shop_id"),
        F.lit(None).cast("string").alias("tenant_id"),
        F.concat(F.lit("sess_"), F.col("o_custkey").cast("string"), F.lit("_"),
                 F.year("o_orderdate").cast("string")).alias("session_id"),
        F.concat(F.lit("vis_"), F.col("o_custkey").cast("string")).alias("visitor_id"),
    ]
    order_id = F.concat(F.lit("ord_"), F.col("o_orderkey").cast("string"))
    nulls = {k: F.lit(None).cast(t) for k, t in (
        ("page_url", "string"), ("page_title", "string"), ("referrer", "string"),
        ("utm_source", "string"), ("utm_medium", "string"), ("utm_campaign", "string"),
        ("product_id", "string"), ("product_name", "string"), ("product_price_cents", "int"),
        ("order_id", "string"), ("order_total_cents", "int"), ("cost_price_cents", "int"),
        ("category_id", "string"), ("geo_country", "string"), ("geo_subject", "string"),
        ("geo_city", "string"))}

    def cols(event_type: str, id_expr: Column, created: Column, **over: Column) -> list[Column]:
        d = dict(nulls)
        d.update(over)
        return base + [F.lit(event_type).alias("event_type"), id_expr.alias("id"),
                       created.alias("created_at"), created.alias("event_timestamp")] + [
            v.alias(k) for k, v in d.items()]

    li = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                                  "l_extendedprice")
    p = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    purchases = (li.join(oc, li.l_orderkey == oc.o_orderkey, "inner")
                   .join(p, li.l_partkey == p.p_partkey, "left")
                   .select(*cols("purchase",
                                 F.concat(F.lit("li_"), F.col("l_orderkey").cast("string"), F.lit("_"),
                                          F.col("l_linenumber").cast("string")),
                                 F.col("o_orderdate"),
                                 order_id=order_id,
                                 order_total_cents=_cents(F.col("o_totalprice")),
                                 product_id=F.concat(F.lit("prod_"), F.col("l_partkey").cast("string")),
                                 product_name=F.col("p_name"),
                                 product_price_cents=_cents(F.col("l_extendedprice")))))
    cancels = (oc.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0))
                 .select(*cols("order_cancel",
                               F.concat(F.lit("oc_"), F.col("o_orderkey").cast("string")),
                               F.col("o_orderdate") + F.expr("INTERVAL 1 DAY"),
                               order_id=order_id,
                               order_total_cents=_cents(F.col("o_totalprice")))))
    views = oc.select(*cols("page_view",
                            F.concat(F.lit("pv_"), F.col("o_orderkey").cast("string")),
                            F.col("o_orderdate"),
                            page_url=F.concat(F.lit("/o/"), (F.col("o_orderkey") % 100).cast("string"))))
    return _finish(purchases.unionByName(cancels).unionByName(views))
