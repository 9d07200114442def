"""Registered queries on a published star: seeded, grown by an import, compacted, and reported on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.operators import metrics, ranking
from martlight.operators.adhoc import deal_finely
from martlight.operators.cleaning import load_staged, stage
from martlight.operators.ingest import commit, remove_customers
from martlight.operators.quality import verify_keys
from martlight.plans import clean_sql as sql
from martlight.plans.imports import CREATED_AT, FILENAME
from martlight.plans.reports import AS_OF, YEAR_2000
from martlight.plans.upkeep import DELETED_CITY
from martlight.session import scratch_path, shuffles_freed
from martlight.sources.bound import bind_star
from martlight.sources.dirty import dirty_rows
from martlight.sources.star import PublishedStar, compact, is_published, read_star, with_month, write_star


#: Root of the star that is published in a session, by application and folder: as elsewhere, a star is
#: published once and then read by many reports.
_ROOTS: dict[tuple[str, str], str] = {}


#: A page of the ledger far behind the first one.
LEDGER_PAGE = 30


def imported(spark: SparkSession, folder: str) -> tuple[str, int]:
    """Root and version of the bound star, with sums per day, after the messy file was imported."""
    key = spark.sparkContext.applicationId, folder
    if key not in _ROOTS or not is_published(spark, _ROOTS[key], 1):
        root, staged = scratch_path(spark, "star"), scratch_path(spark, "stage")
        star = bind_star(spark, folder)
        deal_finely(spark, with_month(star.order_items, star.orders))
        with shuffles_freed(spark):
            write_star(spark, verify_keys(star), root, rollups=True)
            stage(dirty_rows(spark, folder), staged, AS_OF)
            commit(spark, root, 0, load_staged(spark, staged), FILENAME, CREATED_AT)
        _ROOTS[key] = root
    return _ROOTS[key], 1


def _after_import(view):
    return lambda spark, folder: view(read_star(spark, *imported(spark, folder)))


def _orders(star: PublishedStar) -> DataFrame:
    return star.orders.select(
        "order_id", "order_number", "customer_id", "region_id", "order_date", "payment_method",
        "order_status", F.col("total_amount").cast("double").alias("total_amount"),
    )


def compacted(spark: SparkSession, folder: str) -> tuple[str, int]:
    root, version = imported(spark, folder)
    if not is_published(spark, root, version + 1):
        compact(spark, root, version)
    return root, version + 1


def thinned(spark: SparkSession, folder: str) -> tuple[str, int]:
    """Root and version of the star after the customers of a city were removed from it."""
    root, version = compacted(spark, folder)
    if not is_published(spark, root, version + 1):
        doomed = read_star(spark, root, version).customers.where(F.col("city") == DELETED_CITY)
        remove_customers(spark, root, version, doomed)
    return root, version + 1


def _compacted_tiers(spark: SparkSession, folder: str) -> DataFrame:
    return read_star(spark, *compacted(spark, folder)).customers.select("customer_id", "customer_code", "segment")


def _after_removal(view):
    return lambda spark, folder: view(read_star(spark, *thinned(spark, folder)))


def _rows_left(star: PublishedStar) -> DataFrame:
    tables = None
    for name in ("customers", "orders", "order_items"):
        key = F.sum("customer_id" if name == "customers" else "order_id")
        row = star.table(name).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("rows_left"), key.cast("bigint").alias("key_sum"))
        tables = row if tables is None else tables.unionAll(row)
    return tables


QUERIES = {
    "commit_order_upsert": _after_import(_orders),
    # ``replace`` gives a star without the sums per day: the report reads the facts.
    "star_import_trend": _after_import(lambda star: metrics.monthly_sales_trend(star.replace())),
    "star_rollup_regions": _after_import(metrics.region_performance),
    "star_rollup_customers": _after_import(lambda star: metrics.kpi_primary(star, YEAR_2000)),
    "star_compacted_tiers": _compacted_tiers,
    "star_ledger_page": _after_import(lambda star: ranking.orders_table(star, page=LEDGER_PAGE)),
    "star_removed_rows": _after_removal(_rows_left),
    "star_removed_regions": _after_removal(metrics.region_performance),
    "star_removed_trend": _after_removal(lambda star: metrics.monthly_sales_trend(star.replace())),
    "star_removed_customers": _after_removal(lambda star: metrics.kpi_primary(star, YEAR_2000)),
}

_ITEMS = """,
new_items AS (
  SELECT order_id, product_id, CAST(quantity AS BIGINT) AS quantity,
         CAST(total_price AS DECIMAL(20,2)) AS total_price
  FROM cleaned JOIN all_orders USING (order_number) JOIN all_products USING (product_code)),
all_items AS (
  SELECT order_id, product_id, quantity, total_price FROM star_items
  UNION ALL SELECT * FROM new_items)"""

_LINES = _ITEMS + """,
all_lines AS (
  SELECT o.*, i.quantity, i.total_price
  FROM all_orders o JOIN all_items i ON i.order_id = o.order_id
  JOIN all_products USING (product_id)
  WHERE order_status IN ('Completed', 'Shipped'))"""

_GONE = f""",
gone AS (SELECT customer_id FROM star_customers WHERE city = '{DELETED_CITY}'),
gone_orders AS (SELECT order_id FROM all_orders JOIN gone USING (customer_id))"""

_LEFT = _LINES + _GONE + """,
lines_left AS (SELECT * FROM all_lines WHERE order_id NOT IN (SELECT order_id FROM gone_orders))"""


def _trend(lines: str) -> str:
    return f"""
SELECT strftime(order_date, '%Y-%m') AS year_month, CAST(sum(total_price) AS DOUBLE) AS revenue,
       count(DISTINCT order_id) AS orders_count, CAST(sum(quantity) AS BIGINT) AS units_sold,
       round(CAST(sum(total_price) AS DOUBLE) / count(DISTINCT order_id), 2) AS aov
FROM {lines} GROUP BY 1"""


def _regions(lines: str) -> str:
    return f""",
sums AS (
  SELECT region_id, sum(total_price) AS revenue, count(DISTINCT order_id) AS total_orders,
         CAST(sum(quantity) AS BIGINT) AS units_sold
  FROM {lines} GROUP BY 1)
SELECT region_id, region_name, code AS region_code, country, CAST(revenue AS DOUBLE) AS total_revenue,
       total_orders, units_sold, round(CAST(revenue AS DOUBLE) / total_orders, 2) AS aov,
       row_number() OVER (ORDER BY revenue DESC, region_id) AS rank,
       round(CAST(revenue AS DOUBLE) / CAST(sum(revenue) OVER () AS DOUBLE) * 100.0, 2) AS share_pct
FROM sums JOIN all_regions USING (region_id)"""


def _figures(lines: str) -> str:
    return f"""
SELECT coalesce(CAST(sum(total_price) AS DOUBLE), 0.0) AS total_revenue, count(DISTINCT order_id) AS total_orders,
       CAST(coalesce(sum(quantity), 0) AS BIGINT) AS units_sold, count(DISTINCT customer_id) AS total_customers
FROM {lines} WHERE order_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"""


ORACLES = {
    "commit_order_upsert": sql.commit(
        "\nSELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount) FROM all_orders"),
    "star_import_trend": sql.commit(_LINES + _trend("all_lines")),
    "star_rollup_regions": sql.commit(_LINES + _regions("all_lines")),
    "star_rollup_customers": sql.commit(_LINES + _figures("all_lines")),
    "star_removed_regions": sql.commit(_LEFT + _regions("lines_left")),
    "star_removed_trend": sql.commit(_LEFT + _trend("lines_left")),
    "star_removed_customers": sql.commit(_LEFT + _figures("lines_left")),
    "star_removed_rows": sql.commit(_ITEMS + _GONE + """
SELECT 'customers' AS table_name, count(*) AS rows_left, CAST(sum(customer_id) AS BIGINT) AS key_sum
FROM all_customers WHERE customer_id NOT IN (SELECT customer_id FROM gone)
UNION ALL
SELECT 'orders', count(*), CAST(sum(order_id) AS BIGINT) FROM all_orders
WHERE order_id NOT IN (SELECT order_id FROM gone_orders)
UNION ALL
SELECT 'order_items', count(*), CAST(sum(order_id) AS BIGINT) FROM all_items
WHERE order_id NOT IN (SELECT order_id FROM gone_orders)"""),
    "star_ledger_page": sql.commit(f"""{_LINES},
names AS (
  SELECT customer_id, customer_code, first_name || ' ' || last_name AS customer_name FROM star_customers
  UNION ALL
  SELECT customer_id, customer_code, 'Imported User_' || right(customer_code, 4) FROM added_customers)
SELECT order_id, order_number, order_date, customer_code, customer_name, region_name, payment_method, order_status,
       count(*) AS items_count, CAST(sum(total_price) AS DOUBLE) AS order_total
FROM all_lines JOIN names USING (customer_id) JOIN all_regions USING (region_id)
GROUP BY ALL ORDER BY order_date DESC, order_id DESC LIMIT 25 OFFSET {25 * (LEDGER_PAGE - 1)}"""),
    "star_compacted_tiers": sql.commit("""
SELECT customer_id, customer_code,
       CASE WHEN coalesce(spent, 0) >= 5000 THEN 'High Spending (VIP)'
            WHEN coalesce(spent, 0) >= 1500 THEN 'Medium Spending'
            ELSE 'Low Spending' END AS segment
FROM all_customers LEFT JOIN (
  SELECT customer_id, sum(total_amount) AS spent FROM all_orders
  WHERE order_status = 'Completed' GROUP BY 1) USING (customer_id)"""),
}
