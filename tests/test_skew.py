"""One shop holds a third of all rows (and one session a large part of it): the views
must stay exact, and their first shuffles must be keyed below the shop level."""

import re

from pyspark.sql import functions as F

from shoplens.plans import views as V
from shoplens.sources.bridge import EVENTS_AS_OF, events_bronze

SF = "/root/testdata/sf0.001"


def _skewed(spark):
    b = events_bronze(spark, SF)
    hot = b.withColumn("shop_id", F.lit("hot")).withColumn("tenant_id", F.lit("t"))
    hot2 = hot.withColumn("id", F.concat(F.col("id"), F.lit("x")))
    return b.unionByName(hot).unionByName(hot2)  # the hot shop holds 2/3


def test_hot_shop_views_exact(spark):
    s = _skewed(spark)
    t = {r["day"]: r for r in V.daily_traffic(s, EVENTS_AS_OF).filter("shop_id = 'hot'").collect()}
    base = events_bronze(spark, SF)
    ref = (base.withColumn("day", F.to_date("created_at")).groupBy("day")
               .agg(F.count_distinct(F.when(F.col("event_type").isin("page_view", "session_start"),
                                            F.col("session_id"))).alias("us"),
                    F.count_if(F.col("event_type") == "page_view").alias("pv")).collect())
    for r in ref:
        assert t[r["day"]]["unique_sessions"] == r["us"]
        assert t[r["day"]]["page_views"] == 2 * r["pv"]


def test_first_shuffle_keys_below_shop(spark):
    s = _skewed(spark)
    for df in (V.daily_traffic(s, EVENTS_AS_OF), V.daily_funnel(s, EVENTS_AS_OF), V.daily_geo(s, EVENTS_AS_OF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
        # the deepest exchanges (listed last) partition by session, not by shop/day alone
        assert any("session_id" in k for k in keys), keys


def test_two_distinct_counts_without_expand(spark):
    from shoplens.plans import reports as R
    from shoplens.plans.catalog import W24
    s = _skewed(spark)
    for df in (V.daily_traffic(s, EVENTS_AS_OF), V.traffic_from_grain(V.activity_grain(s, EVENTS_AS_OF)),
               R.intraday_buckets(s, *W24), R.intraday_buckets(s, *W24, per_shop=False)):
        assert "Expand" not in df._jdf.queryExecution().executedPlan().toString()
