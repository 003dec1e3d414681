"""The incremental refresh: all seven views equal the batch views, whatever comes late or falls out."""

import datetime as dt
import random
import re
import uuid

import pytest
from conftest import events_df

from shoplens.checks.compare import digest
from shoplens.plans import views as V
from shoplens.session import checkpoint_root
from shoplens.sources import bronze as BR
from shoplens.streaming import incremental as INC

LOOKBACK, TOP = "8 DAYS", "5 DAYS"


def some_events(seed, n=240, days=14):
    """Sessions over several days, geo that becomes known later, cancels before and without purchases."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        t = dt.datetime(2026, 3, 20) + dt.timedelta(seconds=r.randint(0, days * 86400 - 1))
        kind = r.choice(["page_view", "page_view", "session_start", "product_view", "add_to_cart", "checkout_start", "purchase",
                         "purchase", "order_cancel"])
        shop = r.choice("ab")
        row = dict(id=f"e{k:04d}", shop_id=shop, tenant_id=f"t{shop}", session_id=f"s{r.randint(0, 25)}", visitor_id=f"v{r.randint(0, 9)}",
                   event_type=kind, created_at=t.strftime("%Y-%m-%d %H:%M:%S"), utm_source=r.choice([None, "ads"]),
                   geo_country=r.choice([None, "RU", "US"]))
        if kind in ("purchase", "order_cancel"):
            row |= dict(order_id=r.choice([None] + [f"o{j}" for j in range(12)]), order_total_cents=r.choice([None, 100, 250]),
                        product_id=r.choice([None, "p1", "p2", "p3"]), product_name=r.choice([None, "P"]),
                        product_price_cents=r.choice([None, 10, 70]))
        rows.append(row)
    return rows


def assert_views(spark, root, bronze, as_of, lookback=LOOKBACK, top=TOP):
    for name, want in V.all_views(bronze, as_of, lookback, top).items():
        got = INC.read_view(spark, root, name)
        got = got.select(*[got[c].cast(t).alias(c) for c, t in want.dtypes])
        assert digest(got.columns, [tuple(x) for x in got.collect()]) == \
            digest(want.columns, [tuple(x) for x in want.collect()]), name


@pytest.fixture
def root(spark):
    return f"{checkpoint_root(spark)}/inc-{uuid.uuid4().hex}"


def test_all_views_equal_batch_as_the_window_moves(spark, root):
    rows = sorted(some_events(1), key=lambda e: e["created_at"])
    late = [e for k, e in enumerate(rows) if k % 9 == 4]  # these come one micro-batch too late, or two
    parts = [[] for _ in range(6)]
    for k, e in enumerate(rows):
        at = k * 6 // len(rows)
        parts[min(5, at + (1 + k % 2 if e in late else 0))].append(e)
    for k, part in enumerate(parts):
        batch = events_df(spark, part)
        BR.write(batch, f"{root}/bronze")
        bronze = BR.read(spark, f"{root}/bronze")
        as_of = max(e["created_at"] for p in parts[:k + 1] for e in p)
        INC.refresh_batch(spark, batch, bronze, f"{root}/views", max(e["created_at"] for e in part), LOOKBACK, "q", k, TOP)
        if k in (2, 4, 5):
            assert_views(spark, f"{root}/views", bronze, as_of)
    # a micro-batch that runs again changes nothing
    INC.refresh_batch(spark, batch, bronze, f"{root}/views", as_of, LOOKBACK, "q", 5, TOP)
    assert_views(spark, f"{root}/views", bronze, as_of)


def test_from_a_logged_table_after_a_crash(spark, root, monkeypatch):
    rows = sorted(some_events(2, n=120, days=4), key=lambda e: e["created_at"])
    table, as_of = BR.log(spark, f"{root}/bronze"), "2026-03-24 00:00:00"
    for k in range(3):
        table.append(events_df(spark, rows[k::3]), "ingest", k)
        if k == 1:
            def down(*a, **b):
                raise RuntimeError("lost")

            with monkeypatch.context() as m:
                m.setattr(INC, "write_days", down)
                with pytest.raises(RuntimeError):
                    INC.refresh_logged(spark, f"{root}/bronze", f"{root}/views", as_of)
            table.compact(fan_in=2)
    INC.refresh_logged(spark, f"{root}/bronze", f"{root}/views", as_of)  # the steps that were cut short
    assert INC.refresh_logged(spark, f"{root}/bronze", f"{root}/views", as_of)
    assert INC.refresh_logged(spark, f"{root}/bronze", f"{root}/views", as_of) == []
    assert_views(spark, f"{root}/views", BR.read(spark, f"{root}/bronze"), as_of, V.DAILY_LOOKBACK, V.TOP_PRODUCTS_LOOKBACK)


def test_bronze_is_read_for_affected_days_only(spark, root):
    """Every bronze scan of a micro-batch has a filter on the month folder and on the day."""
    rows = some_events(3, n=60, days=3)
    BR.write(events_df(spark, rows), f"{root}/bronze")
    bronze, sessions = BR.read(spark, f"{root}/bronze"), INC.session_days(events_df(spark, rows[:30]))
    bought = INC.order_days(events_df(spark, rows[:30])).select("shop_id", "order_id")
    inputs = INC.inputs_of_days(bronze, [dt.date(2026, 3, 21)], "2026-03-23 00:00:00", sessions, bought)
    for name, df in inputs.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in re.findall(r"FileScan parquet [^\n]*", plan) if "/bronze" in x]
        assert bool(scans) == (name != "sessions"), name
        assert all("event_month" in x.split("PartitionFilters:")[1].split("PushedFilters:")[0] for x in scans), name
        assert all("GreaterThanOrEqual(created_at" in x for x in scans), name
