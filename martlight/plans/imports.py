"""Registered queries over the messy file: reading, cleaning, audit and import."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.operators import ingest
from martlight.operators.cleaning import (
    CLEANED_COLUMNS,
    Cleaning,
    clean,
    load_staged,
    map_headers,
    stage,
)
from martlight.operators.export import write_csv
from martlight.operators.master import ensure_master
from martlight.plans import clean_sql as sql
from martlight.plans.reports import AS_OF, HI_SPEND, MID_SPEND
from martlight.session import scratch_path, stored
from martlight.sources.bound import bind_star
from martlight.sources.dirty import dirty_rows
from martlight.sources.star import recent_imports
from martlight.sources.upload import MALFORMED, ROW_INDEX, read_raw

FILENAME = "sales_upload.csv"
CREATED_AT = dt.datetime(2001, 8, 1, 9, 30)


def _cleaning(spark: SparkSession, folder: str, *dropped: str) -> Cleaning:
    return clean(dirty_rows(spark, folder).drop(*dropped), AS_OF)


def _clean(view, *dropped: str):
    return lambda spark, folder: view(_cleaning(spark, folder, *dropped))


def _columns(*names: str):
    return _clean(lambda c: c.cleaned().select(ROW_INDEX, *names))


def _uploaded(spark: SparkSession, folder: str) -> DataFrame:
    """The messy file written as CSV in row order and read back."""
    path = scratch_path(spark, "upload")
    rows = dirty_rows(spark, folder)
    write_csv(rows.orderBy(ROW_INDEX).drop(ROW_INDEX), path)
    return read_raw(spark, path)


def _uploaded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Cells with line breaks between quotes, written and read back."""
    path = scratch_path(spark, "lines")
    note = F.concat(F.col("SKU"), F.lit("\nsecond \"line\",\r\n"), F.col("Qty"))
    rows = dirty_rows(spark, folder).orderBy(ROW_INDEX).select("SKU", note.alias("Note"))
    write_csv(rows, path)
    return read_raw(spark, path).drop(MALFORMED)


def _staged(spark: SparkSession, folder: str) -> Cleaning:
    """The messy file as staged for review: cleaned once, then only read."""
    path = scratch_path(spark, "stage")
    stage(dirty_rows(spark, folder), path, AS_OF)
    return load_staged(spark, path)


def _actions(c: Cleaning) -> DataFrame:
    exploded = c.actions().select(F.posexplode("actions").alias("step", "action"))
    return exploded.select((F.col("step") + 1).cast("bigint").alias("step"), "action")


def _outliers(c: Cleaning) -> DataFrame:
    return c.outliers().select(
        ROW_INDEX, "order_number", "total_price", F.round("threshold", 2).alias("threshold"))


class _Import:
    """The star with master records, the cleaned rows, and the frames an import adds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.old = bind_star(spark, folder)
        self.base = ensure_master(spark, self.old)
        # An import starts from staged rows, so the cleaning runs once for all its steps.
        self.cleaned = _staged(spark, folder).cleaned()
        self.rollup = ingest.roll_up_orders(self.cleaned)

    def customers(self) -> DataFrame:
        columns = ("customer_id", "customer_code")
        added = ingest.new_customers(self.cleaned, self.old.customers)
        return self.old.customers.select(*columns).unionByName(added.select(*columns))

    def categories(self) -> DataFrame:
        return self.base.categories.unionByName(
            ingest.new_categories(self.cleaned, self.base.categories))

    def new_products(self) -> DataFrame:
        return ingest.new_products(self.cleaned, self.base.products, self.categories())

    def new_orders(self) -> DataFrame:
        return ingest.new_orders(
            self.rollup, self.old.orders, self.customers(), self.base.regions)


def _import(view):
    return lambda spark, folder: view(_Import(spark, folder))


def _new_products(i: _Import) -> DataFrame:
    return i.new_products().select(
        "product_id", "product_code", "product_name", "category_id",
        F.col("unit_price").cast("double").alias("unit_price"),
        F.col("cost_price").cast("double").alias("cost_price"),
    )


def _rolled(i: _Import) -> DataFrame:
    return i.rollup.withColumn("total_amount", F.col("total_amount").cast("double"))


def _items(i: _Import) -> DataFrame:
    names = ("product_id", "product_code")
    added = ingest.number_new(i.cleaned, "product_code", i.base.products, "product_id")
    products = stored(i.base.products.select(*names).unionByName(added.select(*names)), "products")
    names = ("order_id", "order_number")
    added = ingest.number_new_orders(i.rollup, i.old.orders)
    orders = stored(i.old.orders.select(*names).unionByName(added.select(*names)), "orders")
    items = ingest.new_items(i.cleaned, orders, products)
    money = {c: F.col(c).cast("double") for c in ("unit_price", "discount_rate", "total_price")}
    return items.withColumns(money)


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    star = bind_star(spark, folder)
    refreshed = ingest.refresh_segments(star.customers, star.orders, HI_SPEND, MID_SPEND)
    return refreshed.select("customer_id", "customer_code", "segment")


def _log_row(c: Cleaning) -> DataFrame:
    return ingest.import_log_row(c.audit(), c.actions(), 1, FILENAME, CREATED_AT)


def _monthly_logs(spark: SparkSession, folder: str) -> DataFrame:
    """An import log with one row per order month."""
    orders = bind_star(spark, folder).orders
    month = F.trunc("order_date", "month")
    return orders.groupBy(month.alias("month")).agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("order_status") == "Completed").alias("valid_records"),
    ).select(
        (F.year("month") * 12 + F.month("month")).cast("bigint").alias("import_id"),
        F.concat(F.lit("orders_"), F.substring(F.col("month").cast("string"), 1, 7), F.lit(".csv"))
        .alias("filename"),
        "total_rows",
        "valid_records",
        F.last_day("month").cast("timestamp_ntz").alias("created_at"),
    )


QUERIES = {
    "src_csv_upload": lambda s, f: _uploaded(s, f).drop(ROW_INDEX, MALFORMED),
    "src_csv_quoted_newlines": _uploaded_lines,
    "src_row_index": lambda s, f: _uploaded(s, f).select(ROW_INDEX, "SKU", "Qty"),
    "recent_imports": lambda s, f: recent_imports(_monthly_logs(s, f)),
    "clean_headers": lambda s, f: map_headers(dirty_rows(s, f)),
    "clean_dedup": _clean(lambda c: c.tagged.select(ROW_INDEX, "given_order_number", "product_code")),
    "clean_dates": _columns("order_date"),
    "clean_quantity": _columns("quantity"),
    "clean_price": _columns("unit_price"),
    "clean_price_imputed": _clean(
        lambda c: c.cleaned().select(ROW_INDEX, "unit_price", "total_price"), "Price"),
    "clean_discount": _columns("discount_rate"),
    "clean_total": _columns("total_price"),
    "clean_text_defaults": _columns("customer_code", "product_code", "product_name"),
    "clean_title_case": _columns("region_name", "category_name", "order_status", "payment_method"),
    "clean_order_number": _clean(lambda c: c.cleaned().select(ROW_INDEX, "order_number"), "Order ID"),
    "clean_outliers": _clean(_outliers),
    "clean_timestamp": _columns("order_timestamp"),
    "clean_audit": _clean(lambda c: c.audit()),
    "clean_rejects": _clean(lambda c: c.rejects()),
    "clean_rejects_sample": _clean(lambda c: c.rejects_sample()),
    "clean_actions": lambda s, f: _actions(_staged(s, f)),
    "clean_preview": _clean(lambda c: c.preview()),
    "clean_rows": _columns(*[c for c in CLEANED_COLUMNS if c != ROW_INDEX]),
    "commit_new_customers": _import(
        lambda i: ingest.new_customers(i.cleaned, i.old.customers)),
    "commit_new_categories": _import(
        lambda i: ingest.new_categories(i.cleaned, i.base.categories)),
    "commit_new_products": _import(_new_products),
    "commit_region_lookup": _import(
        lambda i: ingest.look_up_regions(i.rollup, i.base.regions).select(
            "order_number", "region_name", "region_id", "unknown_region")),
    "commit_orders": _import(_rolled),
    "commit_keys": _import(lambda i: i.new_orders().select("order_id", "order_number", "customer_id")),
    "commit_items": _import(_items),
    "segment_refresh": _segments,
    "import_log_row": lambda s, f: _log_row(_staged(s, f)),
}


def _cleaned_columns(*names: str) -> str:
    return sql.cleaned(f"\nSELECT row_idx, {', '.join(names)} FROM cleaned")


_RAW_TEXT = ", ".join(
    f"CASE WHEN {c} NOT IN ('', 'n/a') THEN {c} END AS \"{h}\"" for c, h in sql.RAW_HEADERS.items()
)
_REJECTS = """
SELECT row_idx + 1 AS row_index, order_number,
  CASE failed_rule
    WHEN 'date' THEN 'Invalid or unparseable order_date value: ''' || coalesce(order_date, 'nan') || ''''
    WHEN 'range' THEN 'Value too large to store: quantity ' || coalesce(quantity, 'nan') || ', unit price '
                      || coalesce(unit_price, 'nan') || ', total ' || coalesce(total_price, 'nan')
    WHEN 'quantity' THEN 'Invalid quantity value: ' || coalesce(CAST(_quantity AS VARCHAR), 'nan')
                         || ' (must be positive integer)'
    ELSE 'Invalid unit price value: ' || coalesce(CAST(_price AS VARCHAR), 'nan')
         || ' (must be positive number)' END AS reason, failed_rule
FROM judged WHERE failed_rule IS NOT NULL"""
_PRICE_IMPUTED = """,
without_price AS (
  SELECT row_idx, _units, _rate, coalesce(_total, 0.0) AS given,
         round(coalesce(_total, 0.0) / _units, 2) AS unit_price
  FROM judged WHERE failed_rule IS NULL OR failed_rule = 'price')
SELECT row_idx, unit_price,
       CASE WHEN given <= 0 THEN CAST(round(CAST(_units AS DECIMAL(19,0))
              * CAST(unit_price AS DECIMAL(13,2)) * (1 - _rate), 2) AS DOUBLE)
            ELSE given END AS total_price
FROM without_price"""
# Without order numbers, rows are told apart by product code alone.
_WITHOUT_NUMBERS = sql.cleaned("\nSELECT row_idx, 'IMP-ORD-' || lpad(CAST(row_number() OVER (ORDER BY "
                               "row_idx) AS VARCHAR), 6, '0') AS order_number FROM cleaned").replace(
    "PARTITION BY order_number, product_code", "PARTITION BY product_code")

ORACLES = {
    "src_csv_upload": f"WITH {sql.DIRTY.strip()}\nSELECT {_RAW_TEXT} FROM dirty",
    "src_csv_quoted_newlines": f"""WITH {sql.DIRTY.strip()}
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, product_code AS "SKU",
       product_code || chr(10) || 'second "line",' || chr(13) || chr(10) || quantity AS "Note"
FROM dirty""",
    "src_row_index": f"WITH {sql.DIRTY.strip()}\nSELECT row_number() OVER (ORDER BY row_idx) - 1 "
                     "AS row_idx, product_code AS \"SKU\", quantity AS \"Qty\" FROM dirty",
    "recent_imports": """
WITH monthly AS (
  SELECT date_trunc('month', CAST(o_orderdate AS DATE)) AS month, count(*) AS total_rows,
         count(*) FILTER (o_orderstatus = 'F') AS valid_records
  FROM orders GROUP BY 1)
SELECT CAST(year(month) * 12 + month(month) AS BIGINT) AS import_id,
       'orders_' || strftime(month, '%Y-%m') || '.csv' AS filename, total_rows, valid_records,
       CAST(last_day(month) AS TIMESTAMP) AS created_at
FROM monthly ORDER BY created_at DESC, import_id DESC LIMIT 10""",
    "clean_headers": f"WITH {sql.DIRTY.strip()}\nSELECT * EXCLUDE (true_date) FROM dirty",
    "clean_dedup": sql.cleaned(
        "\nSELECT row_idx, order_number AS given_order_number, product_code FROM unique_rows"),
    "clean_dates": _cleaned_columns("order_date"),
    "clean_quantity": _cleaned_columns("quantity"),
    "clean_price": _cleaned_columns("unit_price"),
    "clean_price_imputed": sql.cleaned(_PRICE_IMPUTED),
    "clean_discount": _cleaned_columns("discount_rate"),
    "clean_total": _cleaned_columns("total_price"),
    "clean_text_defaults": _cleaned_columns("customer_code", "product_code", "product_name"),
    "clean_title_case": _cleaned_columns(
        "region_name", "category_name", "order_status", "payment_method"),
    "clean_order_number": _WITHOUT_NUMBERS,
    "clean_outliers": sql.figures(
        "\nSELECT row_idx, order_number, total_price, round(threshold, 2) AS threshold "
        "FROM cleaned, limits WHERE total_price > threshold"),
    "clean_timestamp": _cleaned_columns("order_timestamp"),
    "clean_audit": sql.figures(f"\nSELECT {sql.AUDIT_COLUMNS} FROM figures"),
    "clean_rejects": sql.cleaned(_REJECTS),
    "clean_rejects_sample": sql.cleaned(
        f"\nSELECT row_index, order_number, reason FROM ({_REJECTS}) ORDER BY "
        "list_position(['row', 'date', 'quantity', 'price', 'range'], failed_rule), row_index LIMIT 50"),
    "clean_actions": sql.ACTIONS,
    "clean_preview": sql.cleaned("\nSELECT * FROM cleaned ORDER BY row_idx LIMIT 15"),
    "clean_rows": sql.cleaned("\nSELECT * FROM cleaned"),
    "commit_new_customers": sql.commit("""
SELECT customer_id, customer_code, 'Imported' AS first_name,
       'User_' || right(customer_code, 4) AS last_name,
       lower(customer_code) || '@imported-customer.com' AS email, 'Standard' AS segment,
       CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state, 'United States' AS country
FROM added_customers"""),
    "commit_new_categories": sql.commit(
        "\nSELECT *, 'Imported category' AS description FROM added_categories"),
    "commit_new_products": sql.commit("""
SELECT product_id, product_code, product_name, category_id, CAST(unit_price AS DOUBLE) AS unit_price,
       CAST(cost_price AS DOUBLE) AS cost_price
FROM added_products"""),
    "commit_region_lookup": sql.commit(
        "\nSELECT order_number, region_name, region_id, unknown_region FROM placed"),
    "commit_orders": sql.commit("""
SELECT order_number, first_row, customer_code, region_name, order_date, payment_method, order_status,
       CAST(total_amount AS DOUBLE) AS total_amount, line_count FROM rolled"""),
    "commit_keys": sql.commit("\nSELECT order_id, order_number, customer_id FROM added_orders"),
    "commit_items": sql.commit("""
SELECT order_id, product_id, CAST(quantity AS BIGINT) AS quantity,
       CAST(CAST(unit_price AS DECIMAL(20,2)) AS DOUBLE) AS unit_price,
       CAST(CAST(discount_rate AS DECIMAL(5,4)) AS DOUBLE) AS discount_rate,
       CAST(CAST(total_price AS DECIMAL(20,2)) AS DOUBLE) AS total_price
FROM cleaned JOIN all_orders USING (order_number) JOIN all_products USING (product_code)"""),
    "segment_refresh": f"""WITH {sql.STAR.strip()}
SELECT customer_id, customer_code,
       CASE WHEN coalesce(spent, 0) >= {HI_SPEND} THEN 'High Spending (VIP)'
            WHEN coalesce(spent, 0) >= {MID_SPEND} THEN 'Medium Spending'
            ELSE 'Low Spending' END AS segment
FROM star_customers LEFT JOIN (
  SELECT customer_id, sum(total_amount) AS spent FROM star_orders
  WHERE order_status = 'Completed' GROUP BY 1) USING (customer_id)""",
    "import_log_row": sql.figures(f"""{sql.LISTED}
SELECT CAST(1 AS BIGINT) AS import_id, '{FILENAME}' AS filename, 'Uploaded File' AS file_type,
       {sql.AUDIT_COLUMNS}, 'Committed' AS status,
       CAST(to_json(actions) AS VARCHAR) AS audit_details,
       TIMESTAMP '{CREATED_AT:%Y-%m-%d %H:%M:%S}' AS created_at
FROM figures, listed"""),
}
