"""Registered queries over the star tables: sources, filters, joins, reports, rankings, exports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.functions.money import dollars
from martlight.operators import export, metrics, ranking
from martlight.operators.base import sales_base
from martlight.operators.filters import EVERYTHING, SalesFilter, date_preset
from martlight.plans import star_sql as sql
from martlight.sources.bound import bind_star
from martlight.sources.star import register_views, table_row_counts

AS_OF = dt.date(2001, 8, 1)
YEAR_2000 = SalesFilter(start_date=dt.date(2000, 1, 1), end_date=dt.date(2000, 12, 31))
# Spend of the test customers is far above the default limits.
HI_SPEND, MID_SPEND = 2_000_000, 1_200_000
MIN_ORDERS = 2440

COMBINED = {
    "start_date": "1997-01-01", "end_date": "2000-06-30", "region_id": "2", "category_id": "3",
    "payment_method": "2-HIGH", "order_status": "Completed",
}
COMBINED_SQL = (
    "order_date >= DATE '1997-01-01' AND order_date <= DATE '2000-06-30' AND region_id = 2 "
    "AND category_id = 3 AND payment_method = '2-HIGH' AND order_status = 'Completed'"
)
PRESETS = ("30d", "90d", "ytd", "12m", "all")


def _on_star(build):
    return lambda spark, folder: build(bind_star(spark, folder))


def _request(**args) -> SalesFilter:
    return SalesFilter.from_request(args)


def _lines(star, flt: SalesFilter) -> DataFrame:
    return sales_base(star, flt).select(
        "order_id", "product_id", "customer_id", "region_id", "order_date", "payment_method",
        "order_status", "quantity",
        dollars(F.col("unit_cents")).alias("unit_price"),
        F.col("discount_rate").cast("double").alias("discount_rate"),
        dollars(F.col("total_cents")).alias("total_price"),
    )


def _star_tables(star) -> DataFrame:
    """One fingerprint row per star table: rows, smallest and largest key, sum of a measure."""
    shapes = (
        ("categories", "category_id", F.length("category_name")),
        ("customers", "customer_id", F.length("email")),
        ("order_items", "order_id", F.col("total_price")),
        ("orders", "order_id", F.col("total_amount")),
        ("products", "product_id", F.col("unit_price") + F.col("cost_price")),
        ("regions", "region_id", F.length("country")),
    )
    result = None
    for name, key, measure in shapes:
        row = star.table(name).agg(
            F.lit(name).alias("table_name"),
            F.count("*").alias("row_count"),
            F.min(key).cast("bigint").alias("min_key"),
            F.max(key).cast("bigint").alias("max_key"),
            F.sum(measure).cast("double").alias("measure"),
        )
        result = row if result is None else result.unionAll(row)
    return result


def _status_counts(star, flt: SalesFilter) -> DataFrame:
    return sales_base(star, flt, order_columns=("order_status",)).groupBy("order_status").agg(
        F.count("*").alias("line_count"), dollars(F.sum("total_cents")).alias("revenue")
    )


def _presets(star) -> DataFrame:
    result = None
    for name in PRESETS:
        row = metrics.kpi_primary(star, date_preset(name, AS_OF)).withColumn("preset", F.lit(name))
        result = row if result is None else result.unionAll(row)
    return result


def _flat_kpis(star, flt: SalesFilter) -> DataFrame:
    nested = ("best_product", "top_region")
    row = metrics.kpis(star, flt, AS_OF)
    return row.select(
        *[c for c in row.columns if c not in nested],
        *[F.col(f"{n}.{p}").alias(f"{n}_{p}") for n in nested for p in ("name", "revenue")],
    )


def _row_counts(spark: SparkSession, folder: str) -> DataFrame:
    register_views(bind_star(spark, folder))
    return table_row_counts(spark)


def _options(name: str):
    return _on_star(lambda star: metrics.filter_options(star, AS_OF)[name])


SEGMENT_LIMITS = {"hi": HI_SPEND, "mid": MID_SPEND}

QUERIES = {
    "src_star_tables": _on_star(_star_tables),
    "table_row_counts": _row_counts,
    "sales_base": _on_star(lambda s: _lines(s, EVERYTHING)),
    "filter_start_date": _on_star(lambda s: metrics.kpi_primary(s, _request(start_date="1999-03-15"))),
    "filter_end_date": _on_star(lambda s: metrics.kpi_primary(s, _request(end_date="1997-09-30"))),
    "filter_region": _on_star(lambda s: metrics.region_performance(s, _request(region_id="2"))),
    "filter_category": _on_star(
        lambda s: metrics.category_performance(s, _request(category_id="3"))),
    "filter_payment": _on_star(
        lambda s: metrics.payment_methods(s, _request(payment_method="2-HIGH"))),
    "filter_status": _on_star(lambda s: _status_counts(s, _request(order_status="Processing"))),
    "filter_default_status": _on_star(lambda s: _status_counts(s, _request(order_status="all"))),
    "filter_combined": _on_star(lambda s: metrics.monthly_sales_trend(s, _request(**COMBINED))),
    "filter_date_presets": _on_star(_presets),
    "kpi_primary": _on_star(metrics.kpi_primary),
    "kpi_aov": _on_star(metrics.kpi_aov),
    "kpi_best_product": _on_star(metrics.kpi_best_product),
    "kpi_top_region": _on_star(metrics.kpi_top_region),
    "kpi_prior_revenue": _on_star(lambda s: metrics.kpi_prior_revenue(s, YEAR_2000, AS_OF)),
    "kpis": _on_star(lambda s: _flat_kpis(s, YEAR_2000)),
    "kpis_all_dates": _on_star(lambda s: _flat_kpis(s, EVERYTHING)),
    "monthly_trend": _on_star(metrics.monthly_sales_trend),
    "yoy_matrix": _on_star(metrics.yoy_comparison),
    "yoy_long": _on_star(metrics.yoy_long),
    "top_products": _on_star(ranking.top_products),
    "category_performance": _on_star(metrics.category_performance),
    "region_performance": _on_star(metrics.region_performance),
    "customer_segments": _on_star(
        lambda s: metrics.customer_segments(s, **SEGMENT_LIMITS)),
    "customer_segments_default": _on_star(metrics.customer_segments),
    "top_customers": _on_star(ranking.top_customers),
    "payment_methods": _on_star(metrics.payment_methods),
    "filter_options_regions": _options("regions"),
    "filter_options_categories": _options("categories"),
    "filter_options_payments": _options("payments"),
    "filter_options_dates": _options("dates"),
    "monthly_yoy_lag": _on_star(ranking.monthly_yoy_lag),
    "regional_dense_rank": _on_star(ranking.regional_dense_rank),
    "top_products_per_category": _on_star(ranking.top_products_per_category),
    "customer_value": _on_star(lambda s: ranking.customer_value(s, **SEGMENT_LIMITS)),
    "running_total": _on_star(ranking.running_total),
    "category_profit": _on_star(lambda s: ranking.category_profit(s, MIN_ORDERS)),
    "orders_ledger": _on_star(lambda s: ranking.orders_table(s, page=3)),
    "orders_ledger_count": _on_star(ranking.orders_count),
    "export_lines": _on_star(export.export_lines),
    "export_lines_newest": _on_star(
        lambda s: export.export_lines(s, max_rows=sql.EXPORT_NEWEST_ROWS)),
    "report_summary": _on_star(lambda s: export.report_summary(s, YEAR_2000, AS_OF)),
    "report_monthly": _on_star(export.report_monthly),
    "report_products": _on_star(export.report_products),
    "report_regions": _on_star(export.report_regions),
    "report_segments": _on_star(lambda s: export.report_segments(s, **SEGMENT_LIMITS)),
}

IN_2000 = "order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"
IN_1999 = "order_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'"
# All dates: the year before the last 365 days.
YEAR_BEFORE_LAST = "order_date BETWEEN DATE '1999-08-02' AND DATE '2000-07-31'"

_PRESET_STARTS = (
    ("30d", "DATE '2001-07-02'"), ("90d", "DATE '2001-05-03'"), ("ytd", "DATE '2001-01-01'"),
    ("12m", "DATE '2000-08-01'"), ("all", None),
)


def _preset_sql() -> str:
    parts = []
    for name, start in _PRESET_STARTS:
        dates = "true" if start is None else f"order_date BETWEEN {start} AND DATE '2001-08-01'"
        parts.append(
            f"SELECT {sql.SUM_REVENUE} AS total_revenue, {sql.N_ORDERS} AS total_orders, "
            f"{sql.SUM_UNITS} AS units_sold, count(DISTINCT customer_id) AS total_customers, "
            f"'{name}' AS preset FROM lines WHERE {sql.REVENUE} AND {dates}"
        )
    return sql.star("\n" + "\nUNION ALL\n".join(parts))


_MONTHLY_HEADINGS = sql.monthly().replace(" AS revenue", ' AS "Total Revenue ($)"').replace(
    " AS orders_count", ' AS "Total Orders"').replace(" AS units_sold", ' AS "Units Sold"').replace(
    " AS aov", ' AS "AOV ($)"').replace("AS year_month", 'AS "Year-Month"')

_STATUS_SQL = (
    "\nSELECT order_status, count(*) AS line_count, CAST(sum(total_price) AS DOUBLE) AS revenue "
    "FROM lines WHERE {where} GROUP BY 1"
)

ORACLES = {
    "src_star_tables": sql.star("""
SELECT 'categories' AS table_name, count(*) AS row_count, CAST(min(category_id) AS BIGINT) AS min_key,
       CAST(max(category_id) AS BIGINT) AS max_key, CAST(sum(length(category_name)) AS DOUBLE) AS measure
FROM star_categories
UNION ALL SELECT 'customers', count(*), min(customer_id), max(customer_id),
       CAST(sum(length(email)) AS DOUBLE) FROM star_customers
UNION ALL SELECT 'order_items', count(*), min(order_id), max(order_id),
       CAST(sum(total_price) AS DOUBLE) FROM star_items
UNION ALL SELECT 'orders', count(*), min(order_id), max(order_id),
       CAST(sum(total_amount) AS DOUBLE) FROM star_orders
UNION ALL SELECT 'products', count(*), min(product_id), max(product_id),
       CAST(sum(unit_price + cost_price) AS DOUBLE) FROM star_products
UNION ALL SELECT 'regions', count(*), min(region_id), max(region_id),
       CAST(sum(length(country)) AS DOUBLE) FROM star_regions"""),
    "table_row_counts": sql.star("""
SELECT 'regions' AS table_name, count(*) AS row_count FROM star_regions
UNION ALL SELECT 'categories', count(*) FROM star_categories
UNION ALL SELECT 'customers', count(*) FROM star_customers
UNION ALL SELECT 'products', count(*) FROM star_products
UNION ALL SELECT 'orders', count(*) FROM star_orders
UNION ALL SELECT 'order_items', count(*) FROM star_items"""),
    "sales_base": sql.star(f"""
SELECT order_id, product_id, customer_id, region_id, order_date, payment_method, order_status,
       quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(discount_rate AS DOUBLE) AS discount_rate, CAST(total_price AS DOUBLE) AS total_price
FROM lines WHERE {sql.REVENUE}"""),
    "filter_start_date": sql.kpi_primary(f"{sql.REVENUE} AND order_date >= DATE '1999-03-15'"),
    "filter_end_date": sql.kpi_primary(f"{sql.REVENUE} AND order_date <= DATE '1997-09-30'"),
    "filter_region": sql.regions(f"{sql.REVENUE} AND region_id = 2"),
    "filter_category": sql.categories(f"{sql.REVENUE} AND category_id = 3"),
    "filter_payment": sql.payments(f"{sql.REVENUE} AND payment_method = '2-HIGH'"),
    "filter_status": sql.star(_STATUS_SQL.format(where="order_status = 'Processing'")),
    "filter_default_status": sql.star(_STATUS_SQL.format(where=sql.REVENUE)),
    "filter_combined": sql.monthly(COMBINED_SQL),
    "filter_date_presets": _preset_sql(),
    "kpi_primary": sql.kpi_primary(sql.REVENUE),
    "kpi_aov": sql.kpis("true", "false") + "\nSELECT aov FROM kpi_row",
    "kpi_best_product": sql.kpis("true", "false") + "\nSELECT * FROM best_product",
    "kpi_top_region": sql.kpis("true", "false") + "\nSELECT * FROM top_region",
    "kpi_prior_revenue": sql.kpis(IN_2000, IN_1999) + "\nSELECT * FROM earlier",
    "kpis": sql.kpi_row(IN_2000, IN_1999),
    "kpis_all_dates": sql.kpi_row("true", YEAR_BEFORE_LAST),
    "monthly_trend": sql.monthly(),
    "yoy_matrix": sql.yoy_matrix(metrics.MONTH_NAMES),
    "yoy_long": sql.YOY_LONG,
    "top_products": sql.top_products(
        10, "product_id, product_code, product_name, category_name, unit_price, units_sold, "
        "total_revenue"),
    "category_performance": sql.categories(),
    "region_performance": sql.regions(),
    "customer_segments": sql.segments(HI_SPEND, MID_SPEND),
    "customer_segments_default": sql.segments(5000, 1500),
    "top_customers": sql.TOP_CUSTOMERS,
    "payment_methods": sql.payments(),
    "filter_options_regions": sql.star("\nSELECT region_id, region_name FROM star_regions"),
    "filter_options_categories": sql.star("\nSELECT category_id, category_name FROM star_categories"),
    "filter_options_payments": sql.star("\nSELECT DISTINCT payment_method FROM star_orders"),
    "filter_options_dates": sql.star(
        "\nSELECT coalesce(min(order_date), DATE '2023-01-01') AS min_date, "
        "coalesce(max(order_date), DATE '2001-08-01') AS max_date FROM star_orders"),
    "monthly_yoy_lag": sql.MONTHLY_YOY_LAG,
    "regional_dense_rank": sql.REGIONAL_DENSE_RANK,
    "top_products_per_category": sql.TOP_PRODUCTS_PER_CATEGORY,
    "customer_value": sql.customer_value(HI_SPEND, MID_SPEND),
    "running_total": sql.RUNNING_TOTAL,
    "category_profit": sql.category_profit(MIN_ORDERS),
    "orders_ledger": sql.ledger(25, 50),
    "orders_ledger_count": sql.LEDGER_COUNT,
    "export_lines": sql.EXPORT_LINES,
    "export_lines_newest": sql.EXPORT_NEWEST,
    "report_summary": sql.report_summary(IN_2000, IN_1999),
    "report_monthly": _MONTHLY_HEADINGS,
    "report_products": sql.top_products(
        25, 'rank AS "Rank", product_code AS "Product Code", product_name AS "Product Name", '
        'category_name AS "Category", unit_price AS "Unit Price ($)", units_sold AS "Units Sold", '
        'total_revenue AS "Total Revenue ($)"'),
    "report_regions": sql.report_regions(),
    "report_segments": sql.report_segments(HI_SPEND, MID_SPEND),
}
