"""Rate and rounding expressions.

The reports mix several rounding rules (bigint truncation, numeric half-away rounding,
float truncation after +0.5, float rounding). All are built from integer or IEEE double
arithmetic on native columns, so they stay inside whole-stage codegen and give the same
bits on every engine. Arguments are SQL expression strings (column names or formulas).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div_trunc(a: str, b: str) -> Column:
    """bigint / bigint truncating toward zero (PostgreSQL integer division).

    Spark's ``div`` truncates toward zero (-7 div 2 = -3)."""
    return F.expr(f"cast(({a}) as bigint) div cast(({b}) as bigint)")


def div_round_half_away(a: str, b: str) -> Column:
    """round(a / b) half away from zero, exact for bigint a and b > 0.

    This is ``(numeric_sum / numeric_sum)::bigint`` of the reports."""
    return F.expr(
        f"CASE WHEN ({a}) >= 0 THEN (2 * cast(({a}) as bigint) + ({b})) div (2 * ({b})) "
        f"ELSE -((-2 * cast(({a}) as bigint) + ({b})) div (2 * ({b}))) END")


def pct_2dp(a: str, b: str) -> Column:
    """round(a / b * 100, 2) half away from zero, as a double; b must be > 0.

    Computed as an exact integer count of hundredths, then one IEEE division by 100,
    which yields the double nearest to the decimal result."""
    n = (f"CASE WHEN ({a}) >= 0 THEN (20000 * cast(({a}) as bigint) + ({b})) div (2 * ({b})) "
         f"ELSE -((-20000 * cast(({a}) as bigint) + ({b})) div (2 * ({b}))) END")
    return F.expr(f"cast(({n}) as double) / 100")


def safe_rate(cur: str, total: str) -> Column:
    """cur / total * 100 as an unrounded double, 0 when total is 0, capped at 100."""
    return F.expr(
        f"CASE WHEN ({total}) = 0 THEN 0D "
        f"ELSE least(cast(({cur}) as double) / cast(({total}) as double) * 100, 100D) END")


def round_share(part: str, total: str) -> Column:
    """Share in percent with two decimals: trunc(p / t * 10000 + 0.5) / 100; 0 if t <= 0."""
    return F.expr(
        f"CASE WHEN ({total}) <= 0 THEN 0D ELSE cast(cast(cast(({part}) as double) / "
        f"cast(({total}) as double) * 10000 + 0.5 as bigint) as double) / 100 END")


def round_ratio_pct(part: str, total: str) -> Column:
    """round(p / t * 10000) / 100 on doubles, half away from zero; 0 if t <= 0."""
    return F.expr(
        f"CASE WHEN ({total}) > 0 THEN round(cast(({part}) as double) / "
        f"cast(({total}) as double) * 10000) / 100 ELSE 0D END")


def conversion_pct(orders: str, sessions: str) -> Column:
    """Channel conversion: orders / sessions * 100, unrounded and uncapped; 0 if no sessions."""
    return F.expr(
        f"CASE WHEN ({sessions}) > 0 THEN cast(({orders}) as double) / "
        f"cast(({sessions}) as double) * 100 ELSE 0D END")
