"""Report sections, the line export and the files they are written to."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlight.functions.money import dollars
from martlight.functions.text import full_name
from martlight.operators.base import order_grain, sales_base
from martlight.operators.filters import EVERYTHING, SalesFilter
from martlight.operators.metrics import (
    customer_segments,
    kpis,
    monthly_sales_trend,
    region_performance,
)
from martlight.operators.ranking import top_products
from martlight.sources.star import Star

REPORT_PRODUCTS = 25

# Headings of the line export and the report sections.
LINE_HEADINGS = {
    "order_number": "Order ID",
    "order_date": "Order Date",
    "customer_code": "Customer Code",
    "customer_name": "Customer Name",
    "city": "City",
    "country": "Country",
    "region_name": "Region",
    "product_code": "Product Code",
    "product_name": "Product Name",
    "category_name": "Category",
    "quantity": "Quantity",
    "unit_price": "Unit Price",
    "discount_rate": "Discount Rate",
    "total_price": "Line Total",
    "payment_method": "Payment Method",
    "order_status": "Status",
}
MONTHLY_HEADINGS = {
    "year_month": "Year-Month",
    "revenue": "Total Revenue ($)",
    "orders_count": "Total Orders",
    "units_sold": "Units Sold",
    "aov": "AOV ($)",
}
PRODUCT_HEADINGS = {
    "rank": "Rank",
    "product_code": "Product Code",
    "product_name": "Product Name",
    "category_name": "Category",
    "unit_price": "Unit Price ($)",
    "units_sold": "Units Sold",
    "total_revenue": "Total Revenue ($)",
}
REGION_HEADINGS = {
    "rank": "Rank",
    "region_name": "Region Name",
    "region_code": "Region Code",
    "country": "Country",
    "total_orders": "Total Orders",
    "units_sold": "Units Sold",
    "total_revenue": "Total Revenue ($)",
    "share": "Revenue Share %",
    "aov": "AOV ($)",
}
SEGMENT_HEADINGS = {
    "segment_name": "Segment Name",
    "customer_count": "Customer Count",
    "share": "Share %",
    "total_orders": "Total Orders",
    "total_segment_spend": "Total Segment Spend ($)",
    "avg_spend_per_customer": "Avg Spend / Customer ($)",
}


def _headed(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(name).alias(heading) for name, heading in headings.items()])


def export_lines(star: Star, flt: SalesFilter = EVERYTHING, max_rows: int | None = None) -> DataFrame:
    """All order items, newest first, with their order, customer, product and region.

    With ``max_rows`` only the newest so many. A plain top-k of that size would send ``max_rows``
    rows from every partition to one task, so the lines per day (at most one row per calendar day)
    first tell how far back the limit reaches. They are counted on the sums per order, before any
    name is joined; only lines from that day on are named and sorted.
    """
    lines = sales_base(
        star, flt,
        order_columns=("order_number", "order_date", "customer_id", "region_id", "payment_method",
                       "order_status"),
        product_columns=("product_code", "product_name", "category_id"),
    )
    if max_rows is not None:
        newer = Window.orderBy(F.desc("order_date")).rowsBetween(Window.unboundedPreceding, -1)
        # Only lines with a customer, a region and a category are in the export, and only they count.
        counted = star if star.keys_verified else star.replace({
            "products": star.products.join(
                star.categories.select("category_id"), "category_id", "left_semi"),
            "orders": star.orders
            .join(star.customers.select("customer_id"), "customer_id", "left_semi")
            .join(star.regions.select("region_id"), "region_id", "left_semi"),
        })
        orders = order_grain(counted, flt, "order_date")
        oldest_day = (
            orders.groupBy("order_date").agg(F.sum("lines").alias("n"))
            .withColumn("newer", F.coalesce(F.sum("n").over(newer), F.lit(0)))
            .where(F.col("newer") < max_rows)
            .agg(F.min("order_date").alias("oldest_day"))
        )
        lines = lines.where(F.col("order_date") >= oldest_day.scalar())
    customers = star.customers.select(
        "customer_id", "customer_code", "city", "country",
        full_name(F.col("first_name"), F.col("last_name")).alias("customer_name"),
    )
    named = (
        lines.join(star.categories.select("category_id", "category_name"), "category_id")
        .join(customers, "customer_id")
        .join(star.regions.select("region_id", "region_name"), "region_id")
    )
    newest = named.orderBy(
        F.desc("order_date"), F.desc("order_id"), "product_id", "quantity", "total_cents", "unit_cents",
        "discount_rate")
    if max_rows is not None:
        newest = newest.limit(max_rows)
    money = {
        "unit_price": dollars(F.col("unit_cents")),
        "discount_rate": F.col("discount_rate").cast("double"),
        "total_price": dollars(F.col("total_cents")),
    }
    return _headed(newest.withColumns(money), LINE_HEADINGS)


def report_summary(star: Star, flt: SalesFilter, as_of: dt.date) -> DataFrame:
    """The eight key figures as label and formatted value."""
    # Labels and formats of the summary section.
    lines = (
        ("TOTAL REVENUE", F.format_string("$%,.2f", F.col("total_revenue"))),
        ("Units Sold", F.format_string("%,d", F.col("units_sold"))),
        ("TOTAL ORDERS", F.format_string("%,d", F.col("total_orders"))),
        ("Avg Order Value (AOV)", F.format_string("$%,.2f", F.col("aov"))),
        ("TOTAL CUSTOMERS", F.format_string("%,d", F.col("total_customers"))),
        ("YoY Revenue Growth", F.format_string("%+.2f%%", F.col("growth_pct"))),
        ("TOP PERFORMING REGION", F.col("top_region.name")),
        ("Best-Selling Product", F.col("best_product.name")),
    )
    entries = [
        F.struct(
            F.lit(position).cast("bigint").alias("position"),
            F.lit(label).alias("metric"),
            value.alias("value"),
        )
        for position, (label, value) in enumerate(lines, start=1)
    ]
    return kpis(star, flt, as_of).select(F.inline(F.array(*entries))).orderBy("position")


def report_monthly(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    return _headed(monthly_sales_trend(star, flt), MONTHLY_HEADINGS)


def report_products(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    best_first = Window.orderBy(F.desc("total_revenue"), "product_id")
    ranked = top_products(star, flt, REPORT_PRODUCTS).withColumn(
        "rank", F.row_number().over(best_first).cast("bigint")
    )
    return _headed(ranked, PRODUCT_HEADINGS)


def _with_share(df: DataFrame) -> DataFrame:
    return df.withColumn("share", F.col("share_pct") / 100.0)


def report_regions(star: Star, flt: SalesFilter = EVERYTHING) -> DataFrame:
    return _headed(_with_share(region_performance(star, flt)), REGION_HEADINGS)


def report_segments(star: Star, flt: SalesFilter = EVERYTHING, **limits) -> DataFrame:
    return _headed(_with_share(customer_segments(star, flt, **limits)), SEGMENT_HEADINGS)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with headers, blanks kept as they are, quotes doubled inside quoted text."""
    df.write.mode("errorifexists").options(
        header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)


def write_report(star: Star, flt: SalesFilter, as_of: dt.date, folder: str) -> None:
    """One CSV folder per report section."""
    sections = {
        "executive_summary": report_summary(star, flt, as_of),
        "monthly_trends": report_monthly(star, flt),
        "product_performance": report_products(star, flt),
        "regional_analysis": report_regions(star, flt),
        "customer_segments": report_segments(star, flt),
    }
    for name, section in sections.items():
        write_csv(section, f"{folder}/{name}")
