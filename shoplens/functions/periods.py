"""Reporting windows (driver-side, pure Python; the results become literals in plans).

Windows are half-open [start, end) in UTC, ending at the midnight after the reference
instant. Month arithmetic follows the overflow rule of the original service (a day that
does not exist in the target month rolls into the next month: May 31 minus 3 months is
March 3), not Spark's ``add_months`` clamping.
"""

from __future__ import annotations

import datetime as dt

DAY = dt.timedelta(days=1)


def _naive_utc(t: dt.datetime) -> dt.datetime:
    if t.tzinfo is not None:
        t = t.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return t


def parse_instant(s: str | dt.datetime) -> dt.datetime:
    if isinstance(s, dt.datetime):
        return _naive_utc(s)
    return _naive_utc(dt.datetime.fromisoformat(s))


def add_months_overflow(t: dt.datetime, months: int) -> dt.datetime:
    """Shift by calendar months, letting an out-of-range day overflow forward."""
    total = t.year * 12 + (t.month - 1) + months
    y, m = divmod(total, 12)
    first = t.replace(year=y, month=m + 1, day=1)
    return first + (t.day - 1) * DAY


def period_range(period: str, ref: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    ref = _naive_utc(ref)
    end = dt.datetime(ref.year, ref.month, ref.day) + DAY
    if period == "24h":
        return end - DAY, end
    if period == "7d":
        return end - 7 * DAY, end
    if period == "3m":
        return add_months_overflow(end, -3), end
    if period == "6m":
        return add_months_overflow(end, -6), end
    if period == "1y":
        return add_months_overflow(end, -12), end
    # "30d" and anything unknown
    return end - 30 * DAY, end


def resolve_range(period: str, ref: dt.datetime, from_: str | None = None,
                  to: str | None = None) -> tuple[dt.datetime, dt.datetime]:
    """Preset period, or ``custom`` with inclusive YYYY-MM-DD bounds."""
    if period == "custom" and from_ and to:
        try:
            s = dt.datetime.strptime(from_, "%Y-%m-%d")
            e = dt.datetime.strptime(to, "%Y-%m-%d")
            return s, e + DAY
        except ValueError:
            pass
    return period_range(period, ref)


def previous_range(period: str, start: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """The comparison window: the same preset ending where the current one starts.
    A custom window has no preset, so its comparison window is 30 days."""
    return resolve_range(period, start - dt.timedelta(seconds=1))


def is_single_day(start: dt.datetime, end: dt.datetime) -> bool:
    return end - start == DAY


def within_retention(start: dt.datetime, now: dt.datetime, days: int = 30) -> bool:
    return not start < _naive_utc(now) - days * DAY


def use_intraday(start: dt.datetime, end: dt.datetime, now: dt.datetime) -> bool:
    """Two-hour buckets from bronze when the window is one day still held in bronze."""
    return is_single_day(start, end) and within_retention(start, now)


def sql_ts(t: dt.datetime) -> str:
    return _naive_utc(t).strftime("%Y-%m-%d %H:%M:%S")


# ---------------------------------------------------------------------------------------
# the same rules as column expressions (a window per row, e.g. per-shop reference times)
# ---------------------------------------------------------------------------------------
def _col_period_start(period: str, end):
    from pyspark.sql import functions as F
    months = {"3m": 3, "6m": 6, "1y": 12}.get(period)
    if months is not None:
        total = F.year(end) * 12 + F.month(end) - 1 - months
        first = F.make_date(F.floor(total / 12).cast("int"), (total % 12 + 1).cast("int"), F.lit(1))
        return F.date_add(first, (F.dayofmonth(end) - 1).cast("int"))
    days = {"24h": 1, "7d": 7}.get(period, 30)
    return F.date_sub(end, days)


def period_window_cols(period: str, ref):
    """(start, end) dates of ``period`` for the reference timestamp column ``ref``:
    end = the day after ref's UTC date; month periods overflow like the driver rule."""
    from pyspark.sql import functions as F
    end = F.date_add(F.to_date(ref), 1)
    return _col_period_start(period, end), end


def period_window_by_name(period_col, ref, periods=("24h", "7d", "30d", "3m", "6m", "1y")):
    """(start, end) for a period given per row in ``period_col`` (unknown -> 30 days)."""
    from pyspark.sql import functions as F
    end = F.date_add(F.to_date(ref), 1)
    start = _col_period_start("30d", end)
    for p in periods:
        start = F.when(period_col == p, _col_period_start(p, end)).otherwise(start)
    return start, end
