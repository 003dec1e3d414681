"""Hand-made cases after the reference's own database tests and migration notes."""

from conftest import events_df

from shoplens.plans import reports as R
from shoplens.plans import views as V

AS_OF = "2026-07-02 23:00:00"


def _one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict()


def test_orphan_cancel_is_ignored(spark):
    b = events_df(spark, [
        dict(shop_id="s1", session_id="a", visitor_id="v1", event_type="page_view", created_at="2026-07-02 10:00:00"),
        dict(shop_id="s1", session_id="srv", event_type="order_cancel", order_id="0010",
             order_total_cents=10500, created_at="2026-07-02 11:00:00"),
    ])
    kpi = _one(V.dashboard_kpi(V.daily_traffic(b, AS_OF), V.daily_orders(b, AS_OF)))
    assert kpi["order_count"] == 0 and kpi["total_revenue_cents"] == 0
    assert V.daily_orders(b, AS_OF).count() == 0


def test_paid_then_cancelled_nets_zero_and_duplicates_count_once(spark):
    rows = [dict(shop_id="s1", session_id="a", visitor_id="v1", event_type="page_view",
                 created_at="2026-07-02 09:00:00")]
    for t in ("10:00:00", "10:00:01"):  # duplicate purchase delivery
        rows.append(dict(shop_id="s1", session_id="a", event_type="purchase", order_id="o2",
                         order_total_cents=5000, created_at=f"2026-07-02 {t}"))
    for t in ("12:00:00", "12:30:00"):  # cancelled twice
        rows.append(dict(shop_id="s1", session_id="srv", event_type="order_cancel", order_id="o2",
                         order_total_cents=5000, created_at=f"2026-07-02 {t}"))
    rows.append(dict(shop_id="s1", session_id="b", event_type="purchase", order_id="o3",
                     order_total_cents=1001, created_at="2026-07-02 13:00:00"))
    b = events_df(spark, rows)
    o = _one(V.daily_orders(b, AS_OF))
    assert (o["order_count"], o["total_revenue_cents"], o["avg_order_cents"], o["ordering_sessions"]) == \
        (1, 1001, 1001, 2)


def test_negative_day_is_not_floored_and_average_truncates(spark):
    # purchase yesterday, cancel today: today nets -1 (a real reversal)
    b = events_df(spark, [
        dict(shop_id="s1", session_id="a", event_type="purchase", order_id="o1", order_total_cents=1001,
             created_at="2026-07-01 10:00:00"),
        dict(shop_id="s1", session_id="a", event_type="purchase", order_id="o2", order_total_cents=1000,
             created_at="2026-07-01 11:00:00"),
        dict(shop_id="s1", session_id="a", event_type="order_cancel", order_id="o1", order_total_cents=1001,
             created_at="2026-07-02 10:00:00"),
    ])
    rows = {r["day"].isoformat(): r.asDict() for r in V.daily_orders(b, AS_OF).collect()}
    assert rows["2026-07-01"]["avg_order_cents"] == 1000  # 2001 div 2, truncated
    assert rows["2026-07-02"]["order_count"] == -1 and rows["2026-07-02"]["avg_order_cents"] == 0


def test_conversion_uses_browsing_sessions_only(spark):
    rows = [dict(shop_id="s1", session_id=f"s{i}", visitor_id=f"v{i}", event_type="page_view",
                 created_at="2026-07-02 10:00:00") for i in range(10)]
    rows.append(dict(shop_id="s1", session_id="server", event_type="purchase", order_id="o1",
                     order_total_cents=100, created_at="2026-07-02 12:00:00"))
    b = events_df(spark, rows)
    kpi = _one(V.dashboard_kpi(V.daily_traffic(b, AS_OF), V.daily_orders(b, AS_OF)))
    assert kpi["unique_sessions"] == 10 and kpi["conversion_rate"] == 10.0


def test_session_across_midnight_counts_on_both_days(spark):
    b = events_df(spark, [
        dict(shop_id="s1", session_id="a", event_type="page_view", created_at="2026-07-01 23:50:00"),
        dict(shop_id="s1", session_id="a", event_type="page_view", created_at="2026-07-02 00:10:00"),
    ])
    assert sorted(r["unique_sessions"] for r in V.daily_traffic(b, AS_OF).collect()) == [1, 1]


def test_top_products_sum_line_items(spark):
    rows = [dict(shop_id="s1", session_id="a", event_type="purchase", order_id="o1", product_id="p1",
                 product_name="P", product_price_cents=c, created_at="2026-07-02 10:00:00")
            for c in (200, 200, 500, 300)]
    b = events_df(spark, rows)
    p = _one(V.top_products(b, AS_OF))
    assert (p["sales_count"], p["total_revenue_cents"]) == (1, 1200)


def _shop_a(spark):
    geo = {"Moscow": ("RU", "Москва", "Москва"), "SPb": ("RU", "Санкт-Петербург", "Санкт-Петербург"),
           "Crimea": ("RU", "Республика Крым", None), "none": (None, None, None)}
    rows = []
    for i, (name, (c, s, city)) in enumerate(geo.items()):
        rows.append(dict(shop_id="shopA", session_id=f"sess_{name}", visitor_id=f"v{i}", event_type="session_start",
                         geo_country=c, geo_subject=s, geo_city=city, created_at="2026-07-02 08:00:00"))
    rows.append(dict(shop_id="shopA", session_id="sess_Moscow", event_type="purchase", order_id="o1",
                     order_total_cents=1000, created_at="2026-07-02 09:00:00"))
    rows.append(dict(shop_id="shopA", session_id="sess_SPb", event_type="purchase", order_id="o2",
                     order_total_cents=2000, created_at="2026-07-02 09:00:00"))
    for t in ("10:00:00", "11:00:00"):
        rows.append(dict(shop_id="shopA", session_id="sess_SPb", event_type="order_cancel", order_id="o2",
                         order_total_cents=2000, created_at=f"2026-07-02 {t}"))
    return events_df(spark, rows)


def test_by_location_shop_a(spark):
    b = _shop_a(spark)
    geo = V.daily_geo(b, AS_OF)
    w = R.window("24h", AS_OF)
    rows = {r["subject"]: r.asDict() for r in R.by_location(geo, w, "subject", shop_id="shopA").collect()}
    assert len(rows) == 4
    assert all(r["share"] == 25.0 and r["total_sessions"] == 4 for r in rows.values())
    assert rows["Москва"]["orders"] == 1 and rows["Санкт-Петербург"]["orders"] == 0
    assert rows[""]["country"] == ""
    countries = {r["country"]: r["sessions"] for r in R.by_location(geo, w, "country").collect()}
    assert countries == {"RU": 3, "": 1}


def test_by_location_empty_window(spark):
    geo = V.daily_geo(_shop_a(spark), AS_OF)
    w = R.window("custom", AS_OF, "2000-01-01", "2000-01-02")
    assert R.by_location(geo, w).count() == 0


def test_geo_reconciles_with_traffic_and_orders(spark):
    b = _shop_a(spark)
    rec = V.geo_reconcile(V.daily_geo(b, AS_OF), V.daily_traffic(b, AS_OF), V.daily_orders(b, AS_OF))
    for r in rec.collect():
        assert r["sessions_diff"] == 0 and r["orders_diff"] == 0 and r["revenue_diff"] == 0


def test_intraday_twelve_buckets(spark):
    b = _shop_a(spark)
    s, e = R.window("24h", AS_OF)
    rows = R.intraday_buckets(b, s, e, shop_id="shopA").orderBy("bucket_idx").collect()
    assert [r["slot"] for r in rows] == [f"2026-07-02T{h:02d}:00" for h in range(0, 24, 2)]
    filled = {r["slot"]: r for r in rows if r["unique_sessions"] or r["total_orders"]}
    assert filled["2026-07-02T08:00"]["unique_sessions"] == 4
    assert filled["2026-07-02T10:00"]["total_orders"] == -1  # the o2 cancel bucket


def test_grain_check_clean(spark):
    b = _shop_a(spark)
    for r in V.grain_check(V.all_views(b, AS_OF)).collect():
        assert r["violations"] == 0, r
