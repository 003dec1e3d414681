import datetime as dt

from shoplens.functions.periods import (add_months_overflow, is_single_day, period_range,
                                        previous_range, resolve_range, use_intraday)
from shoplens.operators.topk import clamp_limit

D = dt.datetime


def test_24h_window_is_the_current_utc_day():
    s, e = resolve_range("24h", D(2026, 6, 22, 13, 37, 5))
    assert (s, e) == (D(2026, 6, 22), D(2026, 6, 23))


def test_presets():
    ref = D(2026, 6, 22, 13, 37, 5)
    assert period_range("7d", ref) == (D(2026, 6, 16), D(2026, 6, 23))
    assert period_range("30d", ref) == (D(2026, 5, 24), D(2026, 6, 23))
    assert period_range("6m", ref) == (D(2025, 12, 23), D(2026, 6, 23))
    assert period_range("1y", ref) == (D(2025, 6, 23), D(2026, 6, 23))


def test_custom_inclusive_and_fallbacks():
    ref = D(2026, 6, 22, 13, 37, 5)
    assert resolve_range("custom", ref, "2026-06-01", "2026-06-10") == (D(2026, 6, 1), D(2026, 6, 11))
    assert resolve_range("custom", ref) == period_range("30d", ref)
    assert resolve_range("bogus", ref) == period_range("30d", ref)
    assert resolve_range("custom", ref, "2026-06-01", "not-a-date") == period_range("30d", ref)


def test_month_overflow_not_clamped():
    # 3 months before 2026-05-31 is "2026-02-31", which overflows to 2026-03-03
    s, e = period_range("3m", D(2026, 5, 30, 10))
    assert e == D(2026, 5, 31)
    assert s == D(2026, 3, 3)
    assert add_months_overflow(D(2024, 3, 31), -1) == D(2024, 3, 2)


def test_previous_window():
    s, e = resolve_range("7d", D(2026, 6, 22, 13))
    assert previous_range("7d", s) == (D(2026, 6, 9), s)
    cs, ce = resolve_range("custom", D(2026, 6, 22), "2026-06-01", "2026-06-10")
    # a custom window compares with the 30 days before it
    assert previous_range("custom", cs) == (D(2026, 5, 2), D(2026, 6, 1))


def test_single_day_gate():
    now = D(2026, 6, 22, 13)
    assert is_single_day(*resolve_range("24h", now))
    assert is_single_day(*resolve_range("custom", now, "2026-06-20", "2026-06-20"))
    assert not is_single_day(*resolve_range("custom", now, "2026-06-20", "2026-06-21"))
    assert not is_single_day(*resolve_range("7d", now))
    assert not is_single_day(*resolve_range("30d", now))
    assert use_intraday(*resolve_range("24h", now), now)
    old = resolve_range("custom", now, "2026-01-01", "2026-01-01")
    assert not use_intraday(*old, now)


def test_limit_clamp():
    assert clamp_limit(0) == 10 and clamp_limit(101) == 10 and clamp_limit(50) == 50
    assert clamp_limit(0, 100, 500) == 100 and clamp_limit(501, 100, 500) == 100
    assert clamp_limit(500, 100, 500) == 500


def test_column_rules_equal_driver_rules(spark):
    from pyspark.sql import functions as F

    from shoplens.functions.periods import period_window_by_name
    refs = [D(2026, m, d, 13) for m in range(1, 13) for d in (1, 15, 28, 29, 30, 31) if not (m == 2 and d > 28)
            if not (d == 31 and m in (4, 6, 9, 11))] + [D(2024, 2, 29, 5), D(2024, 3, 31)]
    periods = ["24h", "7d", "30d", "3m", "6m", "1y", "zz"]
    rows = [(r, p) for r in refs for p in periods]
    df = spark.createDataFrame(rows, "ref timestamp, period string")
    s, e = period_window_by_name(F.col("period"), F.col("ref"))
    got = {(r["ref"], r["period"]): (r["s"], r["e"]) for r in df.select("ref", "period", s.alias("s"), e.alias("e")).collect()}
    for r, p in rows:
        ws, we = period_range(p, r)
        assert got[(r, p)] == (ws.date(), we.date()), (r, p)
