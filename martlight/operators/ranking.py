"""Top lists, rankings, running totals and the paged order ledger."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlight.functions.money import cents, dollars, mean_dollars, percent_text
from martlight.functions.text import full_name
from martlight.operators.base import order_grain, order_sums, rolled_rows, rolled_up
from martlight.operators.filters import EVERYTHING, SalesFilter
from martlight.operators.metrics import (
    best_named,
    category_totals,
    customer_totals,
    monthly_totals,
    product_revenue,
    region_totals,
    spend_tier,
    whole,
)
from martlight.schema import (
    COMPLETED,
    MIDDLE_TIER_SPEND,
    TOP_TIER_SPEND,
    VALUE_TIER_NAMES,
)
from martlight.sources.star import Star

COMPLETED_ONLY = SalesFilter(order_status=COMPLETED)
NO_BASELINE = "N/A (Baseline)"


def top_products(star: Star, flt: SalesFilter = EVERYTHING, limit: int = 10) -> DataFrame:
    """Best sellers. Category names are joined to the winners only."""
    products = star.products.select(
        "product_id", "category_id", "product_code", "product_name", "unit_price")
    if not star.keys_verified:
        products = products.join(star.categories.select("category_id"), "category_id", "left_semi")
    winners = best_named(
        star, product_revenue(star, flt), products, "product_id", "revenue", limit)
    return (
        winners.join(star.categories.select("category_id", "category_name"), "category_id")
        .select(
            "product_id", "product_code", "product_name", "category_name",
            F.col("unit_price").cast("double").alias("unit_price"),
            F.col("units").alias("units_sold"),
            dollars(F.col("revenue")).alias("total_revenue"),
        )
        .orderBy(F.desc("total_revenue"), "product_id")
    )


def top_customers(star: Star, flt: SalesFilter = EVERYTHING, limit: int = 10) -> DataFrame:
    customers = star.customers.select(
        "customer_id", "customer_code",
        full_name(F.col("first_name"), F.col("last_name")).alias("customer_name"),
        "email", "city", "country",
    )
    winners = best_named(
        star, customer_totals(star, flt), customers, "customer_id", "spend", limit)
    return winners.select(
        *customers.columns,
        F.col("orders").alias("orders_count"),
        dollars(F.col("spend")).alias("total_spent"),
        mean_dollars(F.col("spend"), F.col("orders")).alias("avg_order_val"),
    )


def monthly_yoy_lag(star: Star, months: int = 24) -> DataFrame:
    """Monthly revenue beside the value twelve rows earlier, newest months first."""
    current, prior = F.col("current_revenue"), F.col("prior")
    growth = F.when(prior.isNull() | (prior == 0), F.lit(NO_BASELINE)).otherwise(
        percent_text((current - prior) / prior * 100.0)
    )
    return (
        monthly_totals(star, EVERYTHING)
        .select("year_month", dollars(F.col("revenue")).alias("current_revenue"),
                F.col("orders").alias("total_orders"))
        .withColumn("prior", F.lag("current_revenue", 12).over(Window.orderBy("year_month")))
        .select(
            "year_month",
            "current_revenue",
            F.coalesce("prior", F.lit(0.0)).alias("prior_year_revenue"),
            "total_orders",
            growth.alias("yoy_growth_pct"),
        )
        .orderBy(F.desc("year_month"))
        .limit(months)
    )


def regional_dense_rank(star: Star) -> DataFrame:
    revenue = F.col("revenue")
    return (
        region_totals(star, EVERYTHING)
        .select(
            F.dense_rank().over(Window.orderBy(F.desc("revenue"))).cast("bigint")
            .alias("sales_rank"),
            "region_name",
            "country",
            F.col("orders").alias("total_orders"),
            F.col("units").alias("total_units"),
            dollars(revenue).alias("territory_revenue"),
            percent_text(dollars(revenue) * 100.0 / dollars(whole("revenue")))
            .alias("global_share_pct"),
        )
        .orderBy("sales_rank", "region_name")
    )


def top_products_per_category(star: Star, keep: int = 3) -> DataFrame:
    """Products ranked inside their category, ties kept.

    The rank filter becomes a map-side group limit, so a category with a large part of all products
    sends only its leaders to the ranking task.
    """
    by_revenue = Window.partitionBy("category_id").orderBy(F.desc("revenue"))
    products = star.products.select("product_id", "category_id", "product_code", "product_name")
    leaders = (
        product_revenue(star, EVERYTHING)
        .join(products, "product_id")
        .withColumn("category_rank", F.rank().over(by_revenue))
        .where(F.col("category_rank") <= keep)
    )
    return (
        leaders.join(star.categories.select("category_id", "category_name"), "category_id")
        .select(
            "category_name",
            F.col("category_rank").cast("bigint").alias("category_rank"),
            "product_code",
            "product_name",
            F.col("units").alias("units_sold"),
            dollars(F.col("revenue")).alias("total_revenue"),
        )
        .orderBy("category_name", "category_rank", "product_code")
    )


def customer_value(star: Star, limit: int = 20,
                   hi=TOP_TIER_SPEND, mid=MIDDLE_TIER_SPEND) -> DataFrame:
    """Completed orders per customer: counts, lifetime spend, last purchase and tier."""
    spend = F.col("spend")
    metrics = order_grain(star, COMPLETED_ONLY, "customer_id", "order_date").groupBy(
        "customer_id"
    ).agg(
        F.count("*").alias("total_orders"),
        F.sum("units").alias("total_items_bought"),
        F.sum("revenue").alias("spend"),
        F.sum("lines").alias("lines"),
        F.max("order_date").alias("most_recent_purchase"),
    )
    customers = star.customers.select(
        "customer_id", "customer_code",
        full_name(F.col("first_name"), F.col("last_name")).alias("customer_name"),
        "city", "country",
    )
    return best_named(star, metrics, customers, "customer_id", "spend", limit).select(
        "customer_code", "customer_name", "city", "country", "total_orders",
        "total_items_bought",
        dollars(spend).alias("lifetime_spend"),
        mean_dollars(spend, F.col("lines")).alias("avg_item_spend"),
        "most_recent_purchase",
        spend_tier(spend, VALUE_TIER_NAMES, hi * 100, mid * 100).alias("spending_segment"),
    )


def running_total(star: Star, days: int = 30) -> DataFrame:
    """Revenue per day with the sum of all days so far, newest days first."""
    up_to_today = Window.orderBy("order_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        order_grain(star, EVERYTHING, "order_date")
        .groupBy("order_date")
        .agg(F.count("*").alias("daily_orders"), F.sum("revenue").alias("revenue"))
        .select(
            "order_date",
            "daily_orders",
            dollars(F.col("revenue")).alias("daily_revenue"),
            dollars(F.sum("revenue").over(up_to_today)).alias("cumulative_revenue"),
        )
        .orderBy(F.desc("order_date"))
        .limit(days)
    )


def category_profit(star: Star, min_orders: int = 100) -> DataFrame:
    """Revenue, cost and margin of categories with enough completed orders."""
    cost = F.sum(F.col("quantity") * cents(F.col("cost_price"))).alias("cost")
    revenue, spent = dollars(F.col("revenue")), dollars(F.col("cost"))
    profit = dollars(F.col("revenue") - F.col("cost"))
    return (
        category_totals(star, COMPLETED_ONLY, cost, columns=("cost_price",))
        .where(F.col("orders") >= min_orders)
        .select(
            "category_name",
            F.col("orders").alias("order_occurrences"),
            F.col("units").alias("total_units_sold"),
            revenue.alias("gross_revenue"),
            spent.alias("estimated_cost"),
            profit.alias("estimated_gross_profit"),
            percent_text(profit / F.nullif(revenue, F.lit(0.0)) * 100.0).alias("gross_margin_pct"),
        )
        .orderBy(F.desc("gross_revenue"), "category_name")
    )


LEDGER_COLUMNS = ("order_number", "order_date", "customer_id", "region_id", "payment_method",
                  "order_status")


def _days_of_page(star: Star, flt: SalesFilter, offset: int, page_size: int) -> tuple[SalesFilter, int]:
    """The filter cut to the days that hold a page, and where on these days the page starts.

    The window runs over one row per day; two days and two numbers come to the driver. Orders without a day
    come last, and a page that holds some is not cut.
    """
    days = rolled_rows(star, flt, "sales_by_day").groupBy("order_date").agg(F.sum("orders").alias("n"))
    through = F.sum("n").over(Window.orderBy(F.desc("order_date")).rowsBetween(Window.unboundedPreceding, 0))
    hit = days.where("n > 0").withColumn("through", through).where(
        (F.col("through") > offset) & (F.col("through") - F.col("n") < offset + page_size))
    found = hit.agg(
        F.min("order_date").alias("first"), F.max("order_date").alias("last"),
        F.min(F.col("through") - F.col("n")).alias("before"), F.count_if(F.col("order_date").isNull()).alias("undated"),
    ).first()
    if found.before is None or found.undated:
        return flt, offset
    return replace(flt, start_date=found.first, end_date=found.last), offset - found.before


def orders_table(
    star: Star,
    flt: SalesFilter = EVERYTHING,
    page: int = 1,
    page_size: int = 25,
    after: tuple[dt.date, int] | None = None,
) -> DataFrame:
    """One page of the order ledger, newest first.

    ``after`` is the (order_date, order_id) of the last row seen: the page then starts behind that
    row at the cost of page one, where a page number makes Spark rank all rows before it. If the star keeps
    sums per day, these say which days a page lies in, and only orders and items of these days are read.
    """
    offset = (page - 1) * page_size
    if after is None and rolled_up(star, flt):
        flt, offset = _days_of_page(star, flt, offset, page_size)
    orders = order_grain(star, flt, *LEDGER_COLUMNS)
    if after is not None:
        day, order_id = F.lit(after[0]), F.lit(after[1])
        orders = orders.where(
            (F.col("order_date") < day)
            | ((F.col("order_date") == day) & (F.col("order_id") < order_id))
        )
        offset = 0
    customers = star.customers.select(
        "customer_id", "customer_code",
        full_name(F.col("first_name"), F.col("last_name")).alias("customer_name"),
    )
    regions = star.regions.select("region_id", "region_name")

    def cut(rows: DataFrame) -> DataFrame:
        return rows.orderBy(F.desc("order_date"), F.desc("order_id")).offset(offset).limit(page_size)

    def describe(rows: DataFrame) -> DataFrame:
        return rows.join(customers, "customer_id").join(regions, "region_id")

    # With verified keys only the rows of the page meet the customers.
    if star.keys_verified:
        rows = describe(cut(orders)).orderBy(F.desc("order_date"), F.desc("order_id"))
    else:
        rows = cut(describe(orders))
    return rows.select(
        "order_id", "order_number", "order_date", "customer_code", "customer_name", "region_name",
        "payment_method", "order_status",
        F.col("lines").alias("items_count"),
        dollars(F.col("revenue")).alias("order_total"),
    )


def orders_count(star: Star, flt: SalesFilter = EVERYTHING, page_size: int = 25) -> DataFrame:
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_count") / page_size))
    total = F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("total_count")
    return order_sums(star, flt).agg(total).select(
        "total_count", pages.cast("bigint").alias("total_pages")
    )
