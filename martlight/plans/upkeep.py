"""Registered queries for synthetic sales, quality checks and ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.operators import generate, quality
from martlight.operators.adhoc import guarded_query
from martlight.operators.master import ensure_master
from martlight.plans import gen_sql as sql
from martlight.plans.star_sql import star as star_sql
from martlight.schema import UNIQUE_KEYS
from martlight.session import stored
from martlight.sources.bound import bind_star, read_table
from martlight.sources.star import Star, register_views

DELETED_CITY = "NATION_7"
ADHOC = """
WITH monthly AS (
  SELECT category_name, year(order_date) AS order_year, month(order_date) AS order_month,
         sum(total_price) AS revenue, count(DISTINCT {orders}.order_id) AS orders
  FROM {orders} JOIN {items} ON {items}.order_id = {orders}.order_id
  JOIN {products} ON {products}.product_id = {items}.product_id
  JOIN {categories} ON {categories}.category_id = {products}.category_id
  WHERE order_status = 'Completed'
  GROUP BY 1, 2, 3)
SELECT category_name, order_year, order_month, CAST(revenue AS DOUBLE) AS revenue, orders
FROM monthly WHERE orders > 0{tail}"""


def _order_ids(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"))


class _Sales:
    """Generated orders and items; the ids, and so the amount of work, come from the orders table."""

    def __init__(self, spark: SparkSession, folder: str):
        ids = _order_ids(spark, folder)
        target = ids.agg(F.call_function("div", F.count("*"), F.lit(2)).alias("n")).scalar()
        first = ids.agg((F.max("id") + 1).alias("n")).scalar()
        self.orders = stored(generate.orders_until(ids, target, first), "orders")
        self.items = generate.explode_items(self.orders)
        self.customers = bind_star(spark, folder).customers

    def totalled(self) -> DataFrame:
        return generate.with_totals(
            generate.assign_customers(self.orders, self.customers), self.items)


def _sold_orders(sales: _Sales) -> DataFrame:
    money = {c: F.col(c).cast("double") for c in ("shipping_cost", "total_amount")}
    return sales.totalled().withColumns(money)


def _sold_items(sales: _Sales) -> DataFrame:
    return sales.items.select(
        "order_id", "position", "product_code", "quantity",
        *[F.col(c).cast("double").alias(c) for c in ("unit_price", "discount_rate", "total_price")],
    )


def _dimensions(spark: SparkSession, folder: str) -> DataFrame:
    star = ensure_master(spark, bind_star(spark, folder))

    def rows(table: str, id_column: str, name: str, detail: str, price) -> DataFrame:
        return star.table(table).select(
            F.lit(table).alias("table_name"), F.col(id_column).cast("bigint").alias("id"),
            F.col(name).alias("name"), F.col(detail).alias("detail"),
            price.cast("double").alias("price"),
        )

    return (
        rows("regions", "region_id", "region_name", "country", F.lit(None))
        .unionAll(rows("categories", "category_id", "category_name", "description", F.lit(None)))
        .unionAll(rows("products", "product_id", "product_code", "sku", F.col("unit_price")))
    )


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    keys = read_table(spark, folder, "customer")
    return generate.new_customers(keys.select((F.col("c_custkey") + 1).alias("id")))


def _cascade(star: Star) -> DataFrame:
    doomed = star.customers.where(F.col("city") == DELETED_CITY).select("customer_id")
    left = quality.delete_customers(star, doomed)
    result = None
    for name in ("customers", "orders", "order_items"):
        row = left.table(name).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("rows_left"),
            F.sum(F.col("customer_id" if name == "customers" else "order_id")).alias("key_sum"),
        )
        result = row if result is None else result.unionAll(row)
    return result


def _adhoc(spark: SparkSession, folder: str) -> DataFrame:
    register_views(bind_star(spark, folder))
    return guarded_query(spark, ADHOC.format(
        orders="orders", items="order_items", products="products", categories="categories",
        tail=";"))


def _star(build):
    return lambda spark, folder: build(bind_star(spark, folder))


def _sales(view):
    return lambda spark, folder: view(_Sales(spark, folder))


QUERIES = {
    "gen_dimensions": _dimensions,
    "gen_customers": _customers,
    "gen_seasonality": lambda s, f: generate.candidates(_order_ids(s, f)),
    "gen_weighted_choice": lambda s, f: generate.order_attributes(_order_ids(s, f)),
    "gen_items": _sales(_sold_items),
    "gen_orders": _sales(_sold_orders),
    "gen_flat_rows": _sales(lambda s: generate.flat_rows(s.totalled(), s.items)),
    "dq_unique": _star(quality.duplicate_keys),
    "dq_orphans": _star(quality.orphans),
    "dq_nulls": _star(quality.null_counts),
    "dq_checks": _star(quality.rule_violations),
    "dq_cascade_delete": _star(_cascade),
    "adhoc_sql_guarded": _adhoc,
}


def _unique(table: str, view: str, key: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{key}' AS key_column, count(*) AS repeated_values, "
            f"CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS extra_rows "
            f"FROM (SELECT count(*) AS n FROM {view} GROUP BY {key} HAVING count(*) > 1)")


def _orphan(table: str, view: str, key: str, parent: str, parent_view: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{key}' AS key_column, '{parent}' AS parent_table, "
            f"count(*) AS orphan_rows FROM {view} c "
            f"WHERE NOT EXISTS (SELECT 1 FROM {parent_view} p WHERE p.{key} = c.{key})")


def _nulls(table: str, view: str, column: str) -> str:
    return (f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
            f"count(*) FILTER ({column} IS NULL) AS null_rows FROM {view}")


def _union(parts) -> str:
    return star_sql("\n" + "\nUNION ALL ".join(parts))


_VIEWS = {
    "categories": "star_categories", "customers": "star_customers", "products": "star_products",
    "regions": "star_regions", "orders": "star_orders", "order_items": "star_items",
}
_GONE = f"(SELECT customer_id FROM star_customers WHERE city = '{DELETED_CITY}')"

ORACLES = {
    "gen_dimensions": sql.DIMENSIONS,
    "gen_customers": sql.CUSTOMERS,
    "gen_seasonality": sql.candidates("\nSELECT * FROM candidates"),
    "gen_weighted_choice": sql.candidates(f"\nSELECT id, {sql.ATTRIBUTES} FROM ids"),
    "gen_items": sql.sales("""
SELECT order_id, position, product_code, quantity, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(discount_rate AS DOUBLE) AS discount_rate, CAST(total_price AS DOUBLE) AS total_price
FROM sold_items"""),
    "gen_orders": sql.sales("""
SELECT id, order_id, order_number, order_date, order_timestamp, region_name, payment_method,
       order_status, item_count, customer_id, CAST(shipping_cost AS DOUBLE) AS shipping_cost,
       CAST(subtotal + shipping_cost AS DOUBLE) AS total_amount
FROM totalled"""),
    "gen_flat_rows": sql.sales("""
SELECT order_number AS "Order_ID", order_date AS "Order_Date",
       strftime(order_timestamp, '%Y-%m-%d %H:%M:%S') AS "Order_Timestamp",
       'CUST-' || lpad(CAST(customer_id AS VARCHAR), CAST(greatest(5, length(CAST(customer_id AS VARCHAR))) AS INTEGER), '0')
         AS "Customer_ID",
       region_name AS "Region", category_name AS "Category", product_code AS "Product_Code",
       product_name AS "Product_Name", CAST(unit_price AS DOUBLE) AS "Unit_Price",
       CAST(cost_price AS DOUBLE) AS "Cost_Price", quantity AS "Quantity",
       CAST(discount_rate AS DOUBLE) AS "Discount", CAST(total_price AS DOUBLE) AS "Total_Price",
       payment_method AS "Payment_Method", order_status AS "Order_Status", 'Yes' AS "Is_Synthetic"
FROM totalled JOIN sold_items USING (order_id)"""),
    "dq_unique": _union([_unique(table, _VIEWS[table], key) for table, key in UNIQUE_KEYS]),
    "dq_orphans": _union([
        _orphan("order_items", "star_items", "order_id", "orders", "star_orders"),
        _orphan("order_items", "star_items", "product_id", "products", "star_products"),
        _orphan("orders", "star_orders", "customer_id", "customers", "star_customers"),
        _orphan("orders", "star_orders", "region_id", "regions", "star_regions"),
        _orphan("products", "star_products", "category_id", "categories", "star_categories"),
    ]),
    "dq_nulls": _union([
        _nulls(table, _VIEWS[table], column)
        for table, columns in quality.NOT_NULL_COLUMNS.items() for column in columns
    ]),
    "dq_checks": _union([
        "SELECT 'quantity > 0' AS rule, count(*) AS rows_checked, "
        "count(*) FILTER (quantity <= 0) AS violations FROM star_items",
        "SELECT 'discount_rate between 0 and 1', count(*), "
        "count(*) FILTER (discount_rate NOT BETWEEN 0 AND 1) FROM star_items",
    ]),
    "dq_cascade_delete": _union([
        f"SELECT 'customers' AS table_name, count(*) AS rows_left, CAST(sum(customer_id) AS BIGINT) "
        f"AS key_sum FROM star_customers WHERE city <> '{DELETED_CITY}'",
        f"SELECT 'orders', count(*), CAST(sum(order_id) AS BIGINT) FROM star_orders "
        f"WHERE customer_id NOT IN {_GONE}",
        f"SELECT 'order_items', count(*), CAST(sum(order_id) AS BIGINT) FROM star_items WHERE order_id "
        f"NOT IN (SELECT order_id FROM star_orders WHERE customer_id IN {_GONE})",
    ]),
    "adhoc_sql_guarded": star_sql(",\n" + ADHOC.format(
        orders="star_orders", items="star_items", products="star_products",
        categories="star_categories", tail="").strip().removeprefix("WITH ").replace(
        "year(order_date) AS", "CAST(year(order_date) AS INTEGER) AS").replace(
        "month(order_date) AS", "CAST(month(order_date) AS INTEGER) AS")),
}
