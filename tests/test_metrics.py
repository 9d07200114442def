import datetime as dt

import pytest
from pyspark.sql import functions as F

from martlight.operators import metrics, ranking
from martlight.operators.filters import (
    EVERYTHING,
    SalesFilter,
    date_preset,
    prior_window,
)
from tests.shop import make_star

AS_OF = dt.date(2024, 12, 31)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("cents, orders, expected", [(1_500_000, 150, 100.0), (0, 0, 0.0)])
def test_average_order_value(spark, cents, orders, expected):
    assert value(spark, metrics.average_order_value(F.lit(cents), F.lit(orders))) == expected


@pytest.mark.parametrize("current, prior, expected", [
    (120000.0, 100000.0, 20.0), (80000.0, 100000.0, -20.0), (50000.0, 0.0, 100.0), (0.0, 0.0, 0.0),
])
def test_growth(spark, current, prior, expected):
    assert value(spark, metrics.growth_pct(F.lit(current), F.lit(prior))) == expected


@pytest.mark.parametrize("spend, tier", [
    (7500, 0), (5000, 0), (4999.99, 1), (1500, 1), (1499.99, 2), (0, 2),
])
def test_tiers(spark, spend, tier):
    assert value(spark, metrics.spend_tier(F.lit(spend))) == metrics.TIER_NAMES[tier]


def test_prior_window():
    def window(start, end):
        days = SalesFilter(dt.date.fromisoformat(start), dt.date.fromisoformat(end))
        found = prior_window(days, AS_OF)
        return found and tuple(map(str, found))

    assert window("2024-01-01", "2024-12-31") == ("2023-01-01", "2023-12-31")
    assert window("2024-03-11", "2024-03-20") == ("2024-03-01", "2024-03-10")
    assert window("2024-02-29", "2025-02-27") is None
    assert tuple(map(str, prior_window(EVERYTHING, AS_OF))) == ("2023-01-01", "2023-12-31")


def test_presets():
    assert date_preset("30d", AS_OF).start_date == dt.date(2024, 12, 1)
    assert date_preset("ytd", AS_OF).start_date == dt.date(2024, 1, 1)
    assert date_preset("12m", dt.date(2024, 2, 29)).start_date == dt.date(2023, 3, 1)
    assert date_preset("all", AS_OF) == EVERYTHING


def test_request_values():
    assert SalesFilter.from_request({"region_id": "all", "start_date": "", "order_status": None}) \
        == EVERYTHING
    assert SalesFilter.from_request({"region_id": "7", "end_date": "2024-01-02"}) == SalesFilter(
        region_id=7, end_date=dt.date(2024, 1, 2))


def test_kpis(spark):
    star = make_star(spark)
    row = metrics.kpis(star, SalesFilter(dt.date(2024, 1, 1), dt.date(2024, 12, 31)), AS_OF).first()
    assert (row.total_revenue, row.total_orders, row.units_sold, row.total_customers) \
        == (44.5, 2, 4, 1)
    assert (row.aov, row.prior_revenue, row.growth_pct) == (22.25, 30.0, 48.33)
    assert row.best_product.asDict() == {"name": "Saw", "revenue": 20.0}
    assert row.top_region.asDict() == {"name": "North", "revenue": 44.5}


def test_kpis_of_nothing(spark):
    row = metrics.kpis(make_star(spark), SalesFilter(order_status="Lost"), AS_OF).first()
    assert (row.total_revenue, row.total_orders, row.aov, row.growth_pct) == (0.0, 0, 0.0, 0.0)
    assert row.best_product.name == "N/A" and row.top_region.revenue == 0.0


def test_empty_reports(spark):
    star, nothing = make_star(spark), SalesFilter(order_status="Lost")
    assert metrics.region_performance(star, nothing).count() == 0
    assert metrics.customer_segments(star, nothing).count() == 0
    assert ranking.orders_count(star, nothing).first().asDict() == {
        "total_count": 0, "total_pages": 1}


def test_yoy_nested(spark):
    row = metrics.yoy_nested(make_star(spark)).first()
    assert row.months[0] == "Jan"
    assert row.years[2024][:3] == [24.5, 20.0, 0.0] and row.years[2023][0] == 30.0


def test_rows_without_parents_drop_out(spark):
    star = make_star(spark)
    orphan = star.order_items.withColumn("product_id", F.lit(77).cast("bigint"))
    grown = star.replace({"order_items": star.order_items.unionByName(orphan)})
    assert metrics.kpi_primary(grown).first() == metrics.kpi_primary(star).first()


def test_pages(spark):
    star = make_star(spark)
    first = ranking.orders_table(star, page=1, page_size=2).collect()
    assert [r.order_id for r in first] == [2, 1]
    second = ranking.orders_table(star, page=2, page_size=2).collect()
    seen = (first[-1].order_date, first[-1].order_id)
    assert second == ranking.orders_table(star, page_size=2, after=seen).collect()
    assert [(r.order_id, r.items_count, r.order_total) for r in second] == [(3, 1, 30.0)]
