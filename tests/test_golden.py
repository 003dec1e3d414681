"""Hand-computed cases of the reports."""

import datetime as dt

from conftest import events_df
from pyspark.sql import functions as F

from shoplens.plans import reports as R
from shoplens.plans import views as V
from shoplens.sources.bronze import apply_retention, retention_cutoff


def test_by_location(spark):
    place = "shop_id string, day date, geo_country string, geo_subject string, geo_city string, " \
            "sessions long, orders long, revenue_cents long"
    rows = [("north", dt.date(2025, 3, 4), "DE", "Hessen", "Kassel", 31, 2, 900),
            ("north", dt.date(2025, 3, 5), "DE", "Hessen", None, 9, 1, 100),
            ("south", dt.date(2025, 3, 4), "DE", None, None, 24, 0, 0),
            ("south", dt.date(2025, 3, 9), "FR", "Bretagne", "Brest", 13, 5, 70),
            ("south", dt.date(2025, 3, 9), None, None, None, 3, -1, -40),
            ("south", dt.date(2025, 4, 1), "FR", "Bretagne", "Brest", 1000, 0, 0)]  # after the window
    geo = spark.createDataFrame(rows, place)
    w = R.window("custom", "2025-05-01 00:00:00", "2025-03-01", "2025-03-31")
    out = R.by_location(geo, w, "subject").orderBy(F.col("sessions").desc()).collect()
    assert [(r["country"], r["subject"], r["city"], r["sessions"], r["orders"], r["share"]) for r in out] == [
        ("DE", "Hessen", "", 40, 3, 50.0), ("DE", "", "", 24, 0, 30.0), ("FR", "Bretagne", "", 13, 5, 16.25),
        ("", "", "", 3, -1, 3.75)]
    assert {r["total_sessions"] for r in out} == {80}
    # a limit below the row count keeps the share of ALL sessions
    (first,) = R.by_location(geo, w, "city", limit=1).collect()
    assert (first["city"], first["share"], first["total_sessions"]) == ("Kassel", 38.75, 80)
    levels = {r["country"]: r["sessions"] for r in R.by_location_levels(geo, w).collect() if r["level"] == "country"}
    assert levels == {"DE": 64, "FR": 13, "": 3}


def test_idle_shops_get_zeros(spark):
    from conftest import events_df
    b = events_df(spark, [dict(shop_id="busy", session_id="s", visitor_id="v", event_type="purchase", order_id="o",
                               order_total_cents=5, created_at="2025-03-04 05:00:00")])
    shops = spark.createDataFrame([("busy",), ("idle",)], "shop_id string")
    s, e = R.window("24h", "2025-03-04 13:00:00")
    slots = R.intraday_buckets(b, s, e, shops=shops).collect()
    assert sorted(r["shop_id"] for r in slots) == ["busy"] * 12 + ["idle"] * 12
    assert sum(r["total_orders"] for r in slots if r["shop_id"] == "idle") == 0
    assert sum(r["total_orders"] for r in slots if r["shop_id"] == "busy") == 1
    assert len(R.intraday_buckets(b, s, e, shop_id="idle").collect()) == 12
    assert [tuple(r) for r in R.returning_customers(b, (s, e), shop_id="idle").collect()] == [("idle", 0, 0, 0.0)]
    orders = spark.createDataFrame([], "shop_id string, day date, total_revenue_cents long, order_count long, "
                                       "avg_order_cents long")
    assert [r["total_orders"] for r in R.revenue_summary(orders, (s, e), shops=shops).collect()] == [0, 0]
    assert R.revenue_series(orders, (s, e), shops=shops).count() == 2


def test_intraday_slots_zero_filled(spark):
    rows = [("s1", "t", "sess1", "v1", "page_view", "2026-06-22 02:10:00")]
    b = (spark.createDataFrame(rows, "shop_id string, tenant_id string, session_id string, visitor_id string, "
                                     "event_type string, ts string")
         .withColumn("created_at", F.to_timestamp("ts"))
         .withColumn("order_id", F.lit(None).cast("string"))
         .withColumn("order_total_cents", F.lit(None).cast("int")))
    s, e = R.window("24h", "2026-06-22 13:37:05")
    out = R.intraday_buckets(b, s, e).orderBy("bucket_idx").collect()
    assert len(out) == 12
    assert [r["slot"] for r in out][:2] == ["2026-06-22T00:00", "2026-06-22T02:00"]
    assert [r["page_views"] for r in out] == [0, 1] + [0] * 10
    assert out[1]["unique_sessions"] == 1 and out[1]["unique_visitors"] == 1


def test_retention_keeps_30_to_61_days(spark):
    assert retention_cutoff("2026-07-15 10:00:00") == dt.date(2026, 6, 1)
    assert retention_cutoff("2026-07-31 10:00:00") == dt.date(2026, 7, 1)
    months = [dt.date(2026, m, 1) for m in (4, 5, 6, 7)]
    df = spark.createDataFrame([(m,) for m in months], "event_month date")
    kept = sorted(r[0] for r in apply_retention(df, "2026-07-15 10:00:00").collect())
    assert kept == [dt.date(2026, 6, 1), dt.date(2026, 7, 1)]


def test_shops_without_events_are_answered(spark):
    """KPIs, series, traffic and funnel answer with zeros for a shop that never had an event."""
    b = events_df(spark, [dict(shop_id="busy", session_id="s", visitor_id="v", event_type="page_view",
                               created_at="2026-03-10 10:00:00")])
    as_of = "2026-03-10 23:00:00"
    v, w = V.all_views(b, as_of), R.window("7d", as_of)
    shops = spark.createDataFrame([("busy",), ("idle",)], "shop_id string")
    days = (w[1] - w[0]).days
    made = {
        "kpi": (lambda **k: R.kpi_windows(v["dashboard_kpi"], "7d", as_of, **k), 2),
        "series": (lambda **k: R.kpi_series(v["dashboard_kpi"], "7d", as_of, **k), days),
        "dashboard": (lambda **k: R.dashboard_series(v["dashboard_kpi"], b, "7d", as_of, **k), days),
        "traffic": (lambda **k: R.traffic_summary(v["daily_traffic"], w, **k), 1),
        "traffic series": (lambda **k: R.traffic_series(v["daily_traffic"], w, **k), days),
        "funnel": (lambda **k: R.funnel_report(v["daily_traffic"], v["daily_funnel"], w, **k), 5)}
    for name, (report, rows) in made.items():
        both = report(shops=shops).collect()
        idle = [r for r in both if r.shop_id == "idle"]
        assert len(both) == 2 * rows and len(idle) == rows, name
        numbers = [x for r in idle for c, x in r.asDict().items() if c not in ("shop_id", "day", "window_name", "stage_order", "rate")]
        assert not any(x for x in numbers if not isinstance(x, str)), name
        assert sorted(map(str, report(shop_id="idle").collect())) == sorted(map(str, idle)), name
