"""A hand-made star of a few rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from martlight.schema import SCHEMAS, TABLE_NAMES
from martlight.sources.star import Star

D = Decimal


def _order(order_id, customer_id, region_id, day, status="Completed", total="0", pay="Cash"):
    date = dt.date.fromisoformat(day)
    return (order_id, f"N{order_id}", customer_id, region_id, date,
            dt.datetime.combine(date, dt.time(12)), pay, status, D(0), D(0), D(total), False)


ROWS = {
    "regions": [(1, "North", "NO", "Aland"), (2, "South", "SO", "Bland")],
    "categories": [(1, "Tools", None), (2, "Toys", None)],
    "customers": [
        (1, "C1", "Ann", "Lee", "a@x", "Standard", "Ayr", None, "Aland"),
        (2, "C2", "Bob", "May", "b@x", "Standard", "Bern", None, "Bland"),
        (3, "C3", "Cy", "Fox", "c@x", "Standard", "Bern", None, "Bland"),
    ],
    "products": [
        (1, "P1", "Saw", 1, D("10"), D("6.5"), "s1", True),
        (2, "P2", "Axe", 1, D("20"), D("13"), "s2", True),
        (3, "P3", "Top", 2, D("5"), D("3.25"), "s3", True),
    ],
    "orders": [
        _order(1, 1, 1, "2024-01-10", total="6000"),
        _order(2, 1, 1, "2024-02-10", "Shipped", total="30"),
        _order(3, 2, 2, "2023-01-10", total="1500"),
        _order(4, 2, 2, "2024-01-11", "Cancelled", total="99"),
        _order(5, 3, 2, "2024-01-12", total="40"),
    ],
    "order_items": [
        (1, 1, 2, D("10"), D("0"), D("20")),
        (1, 3, 1, D("5"), D("0.1"), D("4.5")),
        (2, 2, 1, D("20"), D("0"), D("20")),
        (3, 2, 3, D("20"), D("0.5"), D("30")),
        (4, 1, 9, D("10"), D("0"), D("90")),
    ],
}


def make_star(spark, **changed) -> Star:
    rows = {**ROWS, **changed}
    frames = {name: spark.createDataFrame(rows[name], SCHEMAS[name]) for name in TABLE_NAMES}
    return Star(frames.__getitem__)
