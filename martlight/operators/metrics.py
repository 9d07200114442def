"""Key figures, trends and shares over the filtered sales."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlight.functions.money import dollars, mean_dollars, share_pct
from martlight.functions.tiers import spend_tier
from martlight.operators.base import order_grain, order_sums, rolled_rows, rolled_up, sales_base
from martlight.operators.filters import EVERYTHING, SalesFilter, prior_window
from martlight.schema import MIDDLE_TIER_SPEND, TIER_NAMES, TOP_TIER_SPEND  # noqa: F401
from martlight.sources import rollup
from martlight.sources.star import Star

MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")
DEFAULT_MIN_DATE = dt.date(2023, 1, 1)


def whole(column: str) -> Column:
    """Sum over all rows. Only for rows already aggregated to a dimension of bounded size (tiers,
    regions, categories, payment methods): such rows fit one task."""
    return F.sum(column).over(Window.partitionBy())


def average_order_value(revenue: Column, orders: Column) -> Column:
    """Dollars per order from a cents sum, 0 without orders."""
    return F.when(orders > 0, mean_dollars(revenue, orders)).otherwise(F.lit(0.0))


def growth_pct(current: Column, prior: Column) -> Column:
    return (
        F.when(prior > 0, F.round((current - prior) / prior * 100.0, 2))
        .when((prior == 0) & (current > 0), F.lit(100.0))
        .otherwise(F.lit(0.0))
    )


def kpi_primary(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    sums = {
        "total_revenue": dollars(F.sum("revenue")),
        "total_orders": F.coalesce(F.sum("orders"), F.lit(0)),
        "units_sold": F.coalesce(F.sum("units"), F.lit(0)),
    }
    figures = [value.cast("bigint" if name != "total_revenue" else "double").alias(name) for name, value in sums.items()]
    if _customers_by_day(star, flt):
        return order_sums(star, flt).agg(*figures).withColumn(
            "total_customers", distinct_customers(star, flt).scalar())
    return order_grain(star, flt, "customer_id").withColumn("orders", F.lit(1)).agg(
        *figures, F.count_distinct("customer_id").alias("total_customers"))


def _customers_by_day(star: Star, flt: SalesFilter) -> bool:
    """Bitmaps of customers know days only, for orders that count as revenue."""
    return rolled_up(star, flt) and flt == SalesFilter(flt.start_date, flt.end_date)


def distinct_customers(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    """Customers with at least one matching order, as one row; from bitmaps per day where they answer."""
    if _customers_by_day(star, flt):
        rows = rolled_rows(star, flt, "customers_by_day", flt.date_condition())
        return rollup.count_customers(rows, star.gone_customers)
    return order_grain(star, flt, "customer_id").agg(F.count_distinct("customer_id").alias("total_customers"))


def kpi_aov(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    totals = order_sums(star, flt).agg(F.sum("revenue").alias("r"), F.coalesce(F.sum("orders"), F.lit(0)).alias("n"))
    return totals.select(average_order_value(F.col("r"), F.col("n")).alias("aov"))


def product_revenue(star: Star, flt: SalesFilter) -> DataFrame:
    """Revenue and units per product. Names are joined to these sums, never to the lines."""
    if rolled_up(star, flt):
        return rolled_rows(star, flt, "product_by_day").groupBy("product_id").agg(
            F.sum("revenue").alias("revenue"), F.sum("units").alias("units"))
    return sales_base(star, flt, order_columns=()).groupBy("product_id").agg(
        F.sum("total_cents").alias("revenue"), F.sum("quantity").alias("units")
    )


def region_totals(star: Star, flt: SalesFilter) -> DataFrame:
    """Revenue, orders and units per region row; regions unknown to the dimension drop out."""
    return (
        order_sums(star, flt, "region_id")
        .groupBy("region_id")
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("orders").alias("orders"),
            F.sum("units").alias("units"),
        )
        .join(star.regions, "region_id")
    )


def best_named(star: Star, totals: DataFrame, names: DataFrame, key: str, amount: str,
               limit: int) -> DataFrame:
    """The rows with the largest ``amount``, joined to the dimension that names them.

    Rows without a dimension row do not count. With verified keys there are none: then only the
    winners meet the dimension, which is read but not shuffled.
    """

    def cut(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc(amount), key).limit(limit)

    return cut((cut(totals) if star.keys_verified else totals).join(names, key))


def kpi_best_product(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    names = star.products.select("product_id", "product_name")
    return (
        best_named(star, product_revenue(star, flt), names, "product_id", "revenue", 1)
        .select(F.col("product_name").alias("name"), dollars(F.col("revenue")).alias("revenue"))
    )


def kpi_top_region(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    return (
        region_totals(star, flt)
        .orderBy(F.desc("revenue"), "region_id")
        .limit(1)
        .select(F.col("region_name").alias("name"), dollars(F.col("revenue")).alias("revenue"))
    )


def _between(window: tuple[dt.date, dt.date] | None) -> Column:
    if window is None:
        return F.lit(False)
    return F.col("order_date").between(F.lit(window[0]), F.lit(window[1]))


def kpi_prior_revenue(star: Star, flt: SalesFilter, as_of: dt.date) -> DataFrame:
    window = prior_window(flt, as_of)
    inside = flt.without_dates().order_condition() & _between(window)
    return order_sums(star, flt, when=inside, periods=(window,) if window else None).agg(
        dollars(F.sum("revenue")).alias("prior_revenue")
    )


def kpis(star: Star, flt: SalesFilter, as_of: dt.date) -> DataFrame:
    """One row with every key figure. Current and prior period come from one pass over the facts."""
    window = prior_window(flt, as_of)
    current, prior = flt.date_condition(), _between(window)
    periods = (flt.period(), *([window] if window else []))
    either = flt.without_dates().order_condition() & (current | prior)
    sums = [
        F.sum(F.when(current, F.col("revenue"))).alias("revenue"),
        F.coalesce(F.sum(F.when(current, F.col("orders"))), F.lit(0)).cast("bigint").alias("total_orders"),
        F.coalesce(F.sum(F.when(current, F.col("units"))), F.lit(0)).alias("units_sold"),
        dollars(F.sum(F.when(prior, F.col("revenue")))).alias("prior_revenue"),
    ]
    if _customers_by_day(star, flt):
        figures = order_sums(star, flt, "order_date", when=either, periods=periods).agg(*sums).withColumn(
            "total_customers", distinct_customers(star, flt).scalar())
    else:
        buyers = F.count_distinct(F.when(current, F.col("customer_id"))).alias("total_customers")
        figures = order_grain(star, flt, "order_date", "customer_id", when=either, periods=periods).withColumn(
            "orders", F.lit(1)).agg(*sums, buyers)
    figures = figures.withColumn("total_revenue", dollars(F.col("revenue")))
    nothing = F.struct(F.lit("N/A").alias("name"), F.lit(0.0).alias("revenue"))

    def winner(top: DataFrame) -> Column:
        return F.coalesce(top.select(F.struct("name", "revenue")).scalar(), nothing)

    return figures.select(
        "total_revenue",
        "total_orders",
        "units_sold",
        "total_customers",
        average_order_value(F.col("revenue"), F.col("total_orders")).alias("aov"),
        growth_pct(F.col("total_revenue"), F.col("prior_revenue")).alias("growth_pct"),
        "prior_revenue",
        winner(kpi_best_product(star, flt)).alias("best_product"),
        winner(kpi_top_region(star, flt)).alias("top_region"),
    )


def monthly_totals(star: Star, flt: SalesFilter) -> DataFrame:
    return (
        order_sums(star, flt, "order_date")
        .groupBy(F.substring(F.col("order_date").cast("string"), 1, 7).alias("year_month"))
        .agg(
            F.sum("revenue").alias("revenue"),
            F.sum("orders").alias("orders"),
            F.sum("units").alias("units"),
        )
    )


def monthly_sales_trend(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    return (
        monthly_totals(star, flt)
        .select(
            "year_month",
            dollars(F.col("revenue")).alias("revenue"),
            F.col("orders").alias("orders_count"),
            F.col("units").alias("units_sold"),
            mean_dollars(F.col("revenue"), F.col("orders")).alias("aov"),
        )
        .orderBy("year_month")
    )


def _by_year_and_month(star: Star, flt: SalesFilter) -> DataFrame:
    return order_sums(star, flt, "order_date").groupBy(
        F.year("order_date").alias("order_year"), F.month("order_date").alias("order_month")
    ).agg(F.sum("revenue").alias("revenue"))


def yoy_long(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    return (
        _by_year_and_month(star, flt)
        .select("order_year", "order_month", dollars(F.col("revenue")).alias("revenue"))
        .orderBy("order_year", "order_month")
    )


def yoy_comparison(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    """One row per year, one column per month, 0 for months without sales."""
    slots = [
        dollars(F.sum(F.when(F.col("order_month") == number, F.col("revenue")))).alias(name)
        for number, name in enumerate(MONTH_NAMES, start=1)
    ]
    return _by_year_and_month(star, flt).groupBy("order_year").agg(*slots).orderBy("order_year")


def yoy_nested(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    """The same figures as one row: month names and a map from year to its twelve values."""
    entry = F.struct("order_year", F.array(*MONTH_NAMES).alias("revenue"))
    return yoy_comparison(star, flt).agg(
        F.array(*map(F.lit, MONTH_NAMES)).alias("months"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("years"),
    )


def category_totals(star: Star, flt: SalesFilter, *extra: Column,
                    columns: tuple[str, ...] = ()) -> DataFrame:
    """Sums per category. Lines are first summed per order and category, so that orders are counted
    without a distinct over the lines."""
    lines = sales_base(star, flt, order_columns=(), product_columns=("category_id", *columns))
    per_order = lines.groupBy("order_id", "category_id").agg(
        F.sum("total_cents").alias("revenue"),
        F.sum("quantity").alias("units"),
        F.count("*").alias("lines"),
        F.sum("unit_cents").alias("prices"),
        *extra,
    )
    sums = [c for c in per_order.columns if c not in ("order_id", "category_id")]
    return (
        per_order.groupBy("category_id")
        .agg(F.count("*").alias("orders"), *[F.sum(c).alias(c) for c in sums])
        .join(star.categories.select("category_id", "category_name"), "category_id")
    )


def category_performance(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    revenue = F.col("revenue")
    return (
        category_totals(star, flt)
        .select(
            "category_id",
            "category_name",
            dollars(revenue).alias("total_revenue"),
            F.col("units").alias("units_sold"),
            F.col("orders").alias("orders_count"),
            mean_dollars(F.col("prices"), F.col("lines")).alias("avg_item_price"),
            share_pct(dollars(revenue), dollars(whole("revenue"))).alias("share_pct"),
        )
        .orderBy(F.desc("total_revenue"), "category_id")
    )


def region_performance(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    revenue = F.col("revenue")
    by_revenue = Window.orderBy(F.desc("revenue"), "region_id")
    return (
        region_totals(star, flt)
        .select(
            "region_id",
            "region_name",
            F.col("code").alias("region_code"),
            "country",
            dollars(revenue).alias("total_revenue"),
            F.col("orders").alias("total_orders"),
            F.col("units").alias("units_sold"),
            mean_dollars(revenue, F.col("orders")).alias("aov"),
            F.row_number().over(by_revenue).cast("bigint").alias("rank"),
            share_pct(dollars(revenue), dollars(whole("revenue"))).alias("share_pct"),
        )
        .orderBy("rank")
    )


def customer_totals(star: Star, flt: SalesFilter) -> DataFrame:
    """Spend (in cents) and orders per customer."""
    return order_grain(star, flt, "customer_id").groupBy("customer_id").agg(
        F.sum("revenue").alias("spend"), F.count("*").alias("orders")
    )


def customer_segments(star: Star, flt: SalesFilter = EVERYTHING,
                      hi=TOP_TIER_SPEND, mid=MIDDLE_TIER_SPEND) -> DataFrame:
    tiers = (
        customer_totals(star, flt)
        .groupBy(spend_tier(F.col("spend"), hi=hi * 100, mid=mid * 100).alias("segment_name"))
        .agg(
            F.count("*").alias("customers"),
            F.sum("spend").alias("spend"),
            F.sum("orders").alias("orders"),
        )
    )
    customers = F.col("customers")
    return tiers.select(
        "segment_name",
        customers.alias("customer_count"),
        dollars(F.col("spend")).alias("total_segment_spend"),
        mean_dollars(F.col("spend"), customers).alias("avg_spend_per_customer"),
        F.col("orders").alias("total_orders"),
        share_pct(customers, whole("customers")).alias("share_pct"),
    ).orderBy(F.desc("total_segment_spend"), "segment_name")


def payment_methods(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    methods = order_sums(star, flt, "payment_method").groupBy("payment_method").agg(
        F.sum("revenue").alias("revenue"), F.sum("orders").alias("orders")
    )
    revenue = F.col("revenue")
    return methods.select(
        "payment_method",
        dollars(revenue).alias("total_revenue"),
        F.col("orders").alias("orders_count"),
        share_pct(dollars(revenue), dollars(whole("revenue"))).alias("share_pct"),
    ).orderBy(F.desc("total_revenue"), "payment_method")


def filter_options(star: Star, as_of: dt.date) -> dict[str, DataFrame]:
    """The choices a filter form offers."""
    bounds = star.orders.agg(F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    return {
        "regions": star.regions.select("region_id", "region_name").orderBy("region_name"),
        "categories": (
            star.categories.select("category_id", "category_name").orderBy("category_name")
        ),
        "payments": star.orders.select("payment_method").distinct().orderBy("payment_method"),
        "dates": bounds.select(
            F.coalesce("lo", F.lit(DEFAULT_MIN_DATE)).alias("min_date"),
            F.coalesce("hi", F.lit(as_of)).alias("max_date"),
        ),
    }
