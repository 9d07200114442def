"""Exact money arithmetic: DECIMAL in tables, BIGINT cents in sums, DOUBLE at the output edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,2)"
PRICE = "decimal(20,2)"
TOTAL = "decimal(38,2)"
#: Line money from here on is refused with a reason: its cents would not be exact in a DOUBLE.
TOO_LARGE = 1e13
RATE = "decimal(5,4)"


def cents(amount: Column) -> Column:
    """BIGINT cents of an amount with two decimals. Exact: stored amounts stay below 2^53 cents.

    Line money is summed in cents. Long arithmetic stays in generated code on primitive values, where
    a DECIMAL sum of this precision builds an object per row. A BIGINT holds 92 quadrillion dollars,
    and ANSI mode raises an error beyond that instead of wrapping around.
    """
    return F.rint(amount.cast("double") * 100.0).cast("bigint")


def from_cents(total: Column, kind: str = MONEY) -> Column:
    return (total.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(kind)


def dollars(total: Column) -> Column:
    """DOUBLE dollars of a cents sum, 0 when nothing was summed."""
    return F.coalesce(total.cast("double") / 100.0, F.lit(0.0))


def mean_dollars(total: Column, count: Column) -> Column:
    """Dollars per counted thing, rounded to cents, null for a zero count."""
    return F.round(total.cast("double") / 100.0 / F.nullif(count, F.lit(0)), 2)


def share_pct(part: Column, whole: Column) -> Column:
    """Percent of the whole, rounded to two places, 0 when the whole is not positive."""
    return F.when(whole > 0, F.round(part / whole * 100.0, 2)).otherwise(F.lit(0.0))


def percent_text(value: Column) -> Column:
    return F.concat(F.round(value, 2).cast("string"), F.lit("%"))


def line_total(amount: Column, discount: Column) -> Column:
    return F.round(amount * (F.lit(1) - discount), 2).cast(MONEY)
