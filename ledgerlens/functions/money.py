"""Exact decimal arithmetic for money columns.

SQL ``round(x::numeric, 2)`` rounds half away from zero on an exact value.
Spark's ``avg(decimal)`` already rounds to 6 places, so rounding that again to 2
can be off by a cent (double rounding).  The helpers here round exact
quotients with integer arithmetic instead: for a quotient ``a / b`` with
``b > 0``, ``round_half_away(a / b) = sign(a) * ((2*|a| + b) div (2*b))``.

All helpers take and return SQL expression text, so they compose inside
``F.expr`` and stay in generated JVM code; they never leave the engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_TOTAL_SQL = "decimal(38,2)"


def _round_div(num: str, den: str) -> str:
    """Integer quotient ``num / den`` rounded half away from zero (den > 0)."""
    q = f"((2 * abs({num}) + ({den})) div (2 * ({den})))"
    return f"(CASE WHEN {num} < 0 THEN -{q} ELSE {q} END)"


def scaled_quotient_sql(dividend: str, divisor: str, scale: int = 2,
                        dividend_scale: int = 2) -> str:
    """``round(dividend / divisor, scale)`` computed exactly.

    ``dividend`` is a decimal with ``dividend_scale`` places (e.g. ``sum(amount)``),
    ``divisor`` a positive count.  Returns ``decimal(38, scale)``; null when
    the divisor is 0 or null (as SQL division by a zero count is never reached
    for a non-empty group).
    """
    if scale < dividend_scale:
        raise ValueError("scale must be at least the dividend's scale")
    units = f"cast(({dividend}) * {10 ** scale} as decimal(38,0))"
    den = f"cast(({divisor}) as decimal(38,0))"
    q = _round_div(units, den)
    step = f"0.{'0' * (scale - 1)}1" if scale > 0 else "1"
    return (f"CASE WHEN ({divisor}) > 0 THEN cast(cast({q} as decimal(20,0)) * {step}BD "
            f"as decimal(38,{scale})) END")


def exact_avg(amount: str = "amount", scale: int = 2) -> Column:
    """``round(avg(amount), scale)`` without double rounding, as decimal(38, scale)."""
    return F.expr(scaled_quotient_sql(f"sum({amount})", f"count({amount})", scale))


def full_avg(amount: str = "amount") -> Column:
    """``avg(amount)`` as the full quotient of the exact sum, a double at the output edge."""
    return F.expr(f"cast(sum({amount}) as double) / count({amount})")


def money_sum(amount: str = "amount") -> Column:
    """``round(sum(amount), 2)`` as decimal(38,2) (sums of 2-place decimals are exact)."""
    return F.expr(f"cast(sum({amount}) as {MONEY_TOTAL_SQL})")


def money(col: str) -> Column:
    """A 2-place money value widened to the output money type."""
    return F.expr(f"cast({col} as {MONEY_TOTAL_SQL})")


def share_pct_sql(part: str, total: str) -> str:
    """``round(100.0 * part / total, 2)`` exactly, for non-negative integers."""
    return (f"cast(cast(((20000 * cast({part} as decimal(38,0)) + cast({total} as decimal(38,0))) "
            f"div (2 * cast({total} as decimal(38,0)))) as decimal(20,0)) * 0.01BD as decimal(7,2))")


def format_cad(col: str) -> Column:
    """``CAD $1,234.50`` with thousands grouping."""
    return F.expr(f"concat('CAD $', format_number(cast({col} as decimal(38,2)), 2))")


def format_thousands(col: str) -> Column:
    """``$312k``: whole thousands, half away from zero."""
    return F.expr(f"concat('$', cast(round(cast({col} as decimal(38,2)) / 1000, 0) as bigint), 'k')")
