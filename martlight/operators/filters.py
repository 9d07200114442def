"""The report filter: six optional conditions joined by AND."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from martlight.schema import REVENUE_STATUSES

ANY = "all"
# Spans in days that count as one year when looking for the prior period.
YEAR_SPANS = (364, 365, 366)


# First and last day, None where there is no limit.
Period = tuple[dt.date | None, dt.date | None]


def in_months(month: Column, *periods: Period) -> Column:
    """Whether a month (year * 100 + month) holds days of one of the periods."""
    any_of = F.lit(False)
    for start, end in periods:
        parts = [F.lit(True)]
        if start is not None:
            parts.append(month >= start.year * 100 + start.month)
        if end is not None:
            parts.append(month <= end.year * 100 + end.month)
        any_of = any_of | reduce(and_, parts)
    return any_of


def _given(value):
    return None if value in (None, "", ANY) else value


def _date(value) -> dt.date | None:
    if value in (None, ""):
        return None
    return value if isinstance(value, dt.date) else dt.date.fromisoformat(value)


@dataclass(frozen=True)
class SalesFilter:
    start_date: dt.date | None = None
    end_date: dt.date | None = None
    region_id: int | None = None
    category_id: int | None = None
    payment_method: str | None = None
    order_status: str | None = None

    @staticmethod
    def from_request(args: Mapping[str, object]) -> SalesFilter:
        """Text values as a report page sends them; empty and ``all`` mean no condition."""
        region, category = _given(args.get("region_id")), _given(args.get("category_id"))
        return SalesFilter(
            start_date=_date(args.get("start_date")),
            end_date=_date(args.get("end_date")),
            region_id=None if region is None else int(region),
            category_id=None if category is None else int(category),
            payment_method=_given(args.get("payment_method")),
            order_status=_given(args.get("order_status")),
        )

    def date_condition(self) -> Column:
        parts = []
        if self.start_date is not None:
            parts.append(F.col("order_date") >= F.lit(self.start_date))
        if self.end_date is not None:
            parts.append(F.col("order_date") <= F.lit(self.end_date))
        return reduce(and_, parts, F.lit(True))

    def period(self) -> Period:
        return self.start_date, self.end_date

    def order_condition(self) -> Column:
        """Everything that can be decided on the order row alone."""
        parts = [self.date_condition()]
        if self.region_id is not None:
            parts.append(F.col("region_id") == self.region_id)
        if self.payment_method is not None:
            parts.append(F.col("payment_method") == self.payment_method)
        if self.order_status is not None:
            parts.append(F.col("order_status") == self.order_status)
        else:
            # No status asked for: orders that count as revenue.
            parts.append(F.col("order_status").isin(*REVENUE_STATUSES))
        return reduce(and_, parts)

    def product_condition(self) -> Column:
        if self.category_id is None:
            return F.lit(True)
        return F.col("category_id") == self.category_id

    def without_dates(self) -> SalesFilter:
        return replace(self, start_date=None, end_date=None)


EVERYTHING = SalesFilter()


def _year_before(day: dt.date) -> dt.date | None:
    try:
        return day.replace(year=day.year - 1)
    except ValueError:
        return None


def date_preset(name: str, as_of: dt.date) -> SalesFilter:
    """``30d``, ``90d``, ``ytd``, ``12m``; any other name means all dates."""
    starts = {
        "30d": as_of - dt.timedelta(days=30),
        "90d": as_of - dt.timedelta(days=90),
        "ytd": as_of.replace(month=1, day=1),
        # Feb 29 has no counterpart a year earlier and rolls over to Mar 1.
        "12m": _year_before(as_of) or dt.date(as_of.year - 1, 3, 1),
    }
    if name not in starts:
        return EVERYTHING
    return SalesFilter(start_date=starts[name], end_date=as_of)


def prior_window(flt: SalesFilter, as_of: dt.date) -> tuple[dt.date, dt.date] | None:
    """The comparable earlier period, or None when there is none (Feb 29 start or end)."""
    if flt.start_date is None or flt.end_date is None:
        current_start = as_of - dt.timedelta(days=365)
        return current_start - dt.timedelta(days=365), current_start - dt.timedelta(days=1)
    span = (flt.end_date - flt.start_date).days
    if span in YEAR_SPANS:
        start, end = _year_before(flt.start_date), _year_before(flt.end_date)
        return None if start is None or end is None else (start, end)
    end = flt.start_date - dt.timedelta(days=1)
    return end - dt.timedelta(days=span), end
