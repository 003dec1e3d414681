"""The shared-pass refresh writes the same views as the standalone view functions."""

from pyspark.sql import functions as F

from shoplens.checks.compare import digest
from shoplens.plans import views as V
from shoplens.plans.refresh import current_version, drop_versions, read_current, read_view, refresh_all
from shoplens.session import checkpoint_root
from shoplens.sources.bridge import EVENTS_AS_OF, events_bronze

SF = "/root/testdata/sf0.001"


def test_shared_refresh_equals_views(spark):
    b = events_bronze(spark, SF)
    root = f"{checkpoint_root(spark)}/test-refresh"
    rep = refresh_all(spark, b, root, EVENTS_AS_OF, version="1")
    assert all(v["error"] is None for v in rep.values()), rep
    ref = V.all_views(b, EVENTS_AS_OF)
    for name, df in ref.items():
        got = read_view(spark, root, name, "1")
        assert sorted(got.columns) == sorted(df.columns), name
        assert digest(got.columns, [tuple(r) for r in got.collect()]) == \
            digest(df.columns, [tuple(r) for r in df.collect()]), name
    assert current_version(spark, root) == "1"
    assert read_current(spark, root, "daily_geo").count() == ref["daily_geo"].count()


def test_views_fail_separately_and_versions_are_new(spark, tmp_path, monkeypatch):
    b, root = events_bronze(spark, SF), str(tmp_path / "views")
    first = refresh_all(spark, b, root, EVENTS_AS_OF)
    one = current_version(spark, root)
    assert current_version(spark, str(tmp_path / "none")) is None

    def broken(*a, **k):
        raise RuntimeError("orders side is down")

    with monkeypatch.context() as m:
        m.setattr(V, "orders_from_dedup", broken)
        rep = refresh_all(spark, b, root, EVENTS_AS_OF)
    failed = {k for k, v in rep.items() if v["error"]}
    assert failed == {"daily_orders", "dashboard_kpi"}
    assert current_version(spark, root) == one  # readers stay with the last complete version
    last = refresh_all(spark, b, root, EVENTS_AS_OF)
    assert current_version(spark, root) != one
    assert read_current(spark, root, "daily_geo").count() == read_view(spark, root, "daily_geo", one).count()
    assert first["daily_geo"]["path"] != last["daily_geo"]["path"]
    gone = drop_versions(spark, root, keep=1)
    assert first["daily_geo"]["path"] in gone and last["daily_geo"]["path"] not in gone
    assert read_current(spark, root, "daily_geo").count() > 0


def test_a_failing_intermediate_stops_only_its_views(spark, tmp_path):
    b = events_bronze(spark, SF)
    bad = b.withColumn("order_id", F.expr(
        "CASE WHEN event_type = 'purchase' THEN raise_error('bad order') ELSE order_id END").cast("string"))
    rep = refresh_all(spark, bad, str(tmp_path / "views"), EVENTS_AS_OF)
    fine = {k for k, v in rep.items() if not v["error"]}
    assert {"daily_traffic", "daily_funnel"} <= fine and "daily_orders" not in fine


def test_expired_months_are_deleted(spark, tmp_path):
    from shoplens.sources import bronze as BR
    b = events_bronze(spark, SF)
    old = b.withColumn("event_month", F.expr("DATE '2023-10-01'"))
    BR.write(b.unionByName(old), str(tmp_path / "bronze"))
    assert BR.drop_expired(spark, str(tmp_path / "bronze"), EVENTS_AS_OF) == ["event_month=2023-10-01"]
    assert BR.read(spark, str(tmp_path / "bronze")).count() == b.count()
    assert BR.drop_expired(spark, str(tmp_path / "bronze"), EVENTS_AS_OF) == []


def test_a_shop_under_two_tenants_stops_the_publication(spark, tmp_path):
    b, root = events_bronze(spark, SF), str(tmp_path / "views")
    first = refresh_all(spark, b, root, EVENTS_AS_OF)
    assert {v["outcome"] for v in first.values()} == {"published"}
    one, rows = current_version(spark, root), read_current(spark, root, "dashboard_kpi").count()
    shop = b.select(F.min("shop_id")).first()[0]
    two = b.withColumn("tenant_id", F.when((F.col("shop_id") == shop) & F.col("event_type").isin("page_view", "purchase"),
                                           "another").otherwise(F.col("tenant_id")))
    rep = refresh_all(spark, two, root, EVENTS_AS_OF)
    assert {v["outcome"] for v in rep.values()} == {"refused"}
    assert "several rows" in rep["daily_traffic"]["error"] and rep["daily_geo"]["error"] is None
    assert current_version(spark, root) == one and read_current(spark, root, "dashboard_kpi").count() == rows


def test_refreshes_at_once_publish_whole_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    b, root = events_bronze(spark, SF).filter("shop_id = 'shop-1'").cache(), str(tmp_path / "views")
    days = [f"2024-01-{d} 23:59:59" for d in (20, 30)]
    with ThreadPoolExecutor(2) as pool:
        reps = list(pool.map(lambda t: refresh_all(spark, b, root, t, parallel=1), days))
    assert {v["outcome"] for v in reps[1].values()} == {"published"}
    version = current_version(spark, root)
    assert all(f"version={version}" in v["path"] for v in reps[1].values())
    late = refresh_all(spark, b, root, days[0])
    assert {v["outcome"] for v in late.values()} == {"superseded"} and current_version(spark, root) == version
