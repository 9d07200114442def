"""DuckDB text for the messy file, its cleaning and its import."""

from __future__ import annotations

from martlight.operators.cleaning import TEXT_DEFAULTS
from martlight.operators.master import CATEGORIES, REGIONS, products
from martlight.plans.star_sql import STAR

DIRTY = """
keyed AS (
  SELECT o_orderkey AS k, o_custkey AS cust, CAST(o_orderdate AS DATE) AS d,
         CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey - 1 ELSE o_orderkey END AS kk
  FROM orders
),
priced AS (
  SELECT *, kk // 3 AS ord, 'PROD-' || lpad(CAST((kk * 17) % 4001 AS VARCHAR), 7, '0') AS code,
         k % 6 + 1 AS units,
         CAST(CAST((k * 37) % 90000 + 100 AS DOUBLE) / 100 AS DECIMAL(12,2)) AS price
  FROM keyed
),
dirty AS (
  SELECT k AS row_idx,
    CASE WHEN kk % 53 = 5 THEN NULL
         WHEN ord % 2 = 0 THEN 'ORD-' || lpad(CAST(ord AS VARCHAR), 9, '0')
         ELSE 'WEB-' || lpad(CAST(ord AS VARCHAR), 9, '0') END AS order_number,
    CASE WHEN k % 41 = 0 THEN 'invalid_date' WHEN k % 41 = 1 THEN ''
         WHEN k % 41 = 2 THEN '2024-02-30'
         WHEN k % 43 = 3 THEN strftime(d, '%m/%d/%Y') || ' 10:30 PM'
         WHEN k % 43 = 4 THEN strftime(d, '%-m/%-d/%Y') || ' 10:30:00 AM'
         WHEN k % 43 = 5 THEN strftime(d, '%b %-d %Y')
         WHEN k % 43 = 6 THEN strftime(d, '%A, %B %-d, %Y')
         WHEN k % 43 = 7 THEN strftime(d, '%Y.%m.%d')
         WHEN k % 43 = 8 THEN chr(9) || strftime(d, '%Y-%m-%d') || ' '
         WHEN k % 43 = 9 THEN strftime(d, '%Y-%m-%d') || 'T10:00:00+00:00'
         WHEN k % 5 = 0 THEN strftime(d, '%Y-%m-%d') WHEN k % 5 = 1 THEN strftime(d, '%m/%d/%Y')
         WHEN k % 5 = 2 THEN strftime(d, '%d-%b-%Y') WHEN k % 5 = 3 THEN strftime(d, '%Y%m%d')
         ELSE strftime(d, '%Y-%m-%d') || ' 10:30:00' END AS order_date,
    CASE WHEN k % 9 = 0 THEN ''
         WHEN k % 9 = 1 THEN ' Customer#' || lpad(CAST(cust AS VARCHAR), 9, '0')
         WHEN k % 9 = 2 THEN 'NEW-' || lpad(CAST(cust AS VARCHAR), 6, '0')
         ELSE 'Customer#' || lpad(CAST(cust AS VARCHAR), 9, '0') END AS customer_code,
    CASE WHEN k % 13 = 0 THEN '' WHEN k % 13 = 2 THEN chr(9) || 'north america' || chr(160)
         WHEN k % 5 = 0 THEN 'north america' WHEN k % 5 = 1 THEN 'EUROPE'
         WHEN k % 5 = 2 THEN 'asia-pacific' WHEN k % 5 = 3 THEN ' Latin America '
         ELSE 'Atlantis' END AS region_name,
    CASE WHEN k % 13 = 1 THEN '   ' WHEN k % 26 = 14 THEN chr(9) || chr(160) WHEN k % 3 = 0 THEN 'ELECTRONICS'
         WHEN k % 3 = 1 THEN 'office supplies' ELSE 'o''neil garden-tools 2go' END AS category_name,
    code AS product_code,
    CASE WHEN k % 19 = 0 THEN NULL ELSE 'Item ' || code END AS product_name,
    CASE WHEN k % 31 = 0 THEN '-4.50' WHEN k % 31 = 1 THEN '' WHEN k % 31 = 2 THEN '1,200'
         ELSE CAST(price AS VARCHAR) END AS unit_price,
    CASE WHEN k % 1009 = 7 THEN '3000000000' WHEN k % 29 = 0 THEN '-5' WHEN k % 29 = 1 THEN '0' WHEN k % 29 = 2 THEN 'abc'
         WHEN k % 29 = 3 THEN '0.5' WHEN k % 29 = 4 THEN '2.7' WHEN k % 29 = 5 THEN ' 3 '
         WHEN k % 29 = 6 THEN '1e1' ELSE CAST(units AS VARCHAR) END AS quantity,
    CASE WHEN k % 17 = 0 THEN 'n/a' WHEN k % 17 = 1 THEN '250' WHEN k % 17 = 2 THEN '-0.2'
         WHEN k % 17 = 3 THEN '1.0' WHEN k % 4 = 0 THEN '15' WHEN k % 4 = 1 THEN '0.15'
         WHEN k % 4 = 2 THEN '' ELSE '0.0725' END AS discount_rate,
    CASE WHEN k % 2003 = 7 THEN '100000000000000' WHEN k % 4999 = 11 THEN '1000000000000'
         WHEN kk % 53 = 5 AND k % 4 = 1 THEN '30000000000'
         WHEN k % 11 = 0 THEN '' WHEN k % 11 = 1 THEN '0' WHEN k % 997 = 2 THEN '9999999.99'
         ELSE CAST(CAST(price * CAST(units AS DECIMAL(10,0)) AS DECIMAL(12,2)) AS VARCHAR)
    END AS total_price,
    CASE WHEN k % 6 = 0 THEN 'PayPal' WHEN k % 6 = 1 THEN 'CREDIT CARD'
         WHEN k % 6 = 2 THEN 'bank transfer' WHEN k % 6 = 3 THEN '' ELSE 'Debit Card'
    END AS payment_method,
    CASE WHEN k % 8 = 0 THEN 'completed' WHEN k % 8 = 1 THEN 'SHIPPED' WHEN k % 8 = 2 THEN ''
         WHEN k % 8 = 3 THEN 'cancelled' ELSE 'Completed' END AS order_status,
    -- What a reader of the file should find: the day itself, however it is written.
    CASE WHEN k % 41 NOT IN (0, 1, 2) THEN d END AS true_date
  FROM priced
)"""

RAW_HEADERS = {
    "order_number": "Order ID", "order_date": "Date", "customer_code": "Customer ID",
    "region_name": "Region", "category_name": "Category", "product_code": "SKU",
    "product_name": "Product", "unit_price": "Price", "quantity": "Qty",
    "discount_rate": "Discount", "total_price": "Total", "payment_method": "Payment",
    "order_status": "Status",
}

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def number(column: str) -> str:
    return (f"CASE WHEN regexp_matches({column}, '{_NUMBER}') "
            f"THEN TRY_CAST(trim({column}) AS DOUBLE) END")


def title(expr: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({expr}), "
            f"'\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1]) || x[2:]), '')")


_SPACE = r"[\s\p{Z}\x0b\x{1c}-\x{1f}\x{85}]"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _text(column: str, default: str) -> str:
    value = f"CASE WHEN {_blank(column)} THEN '{default}' ELSE {strip(column)} END"
    if column in ("region_name", "category_name", "order_status", "payment_method"):
        return title(value)
    return value


def _blank(column: str) -> str:
    return f"{column} IS NULL OR {strip(column)} = ''"


CLEANED = f"""{DIRTY},
unique_rows AS (
  SELECT * FROM dirty
  QUALIFY row_number() OVER (PARTITION BY order_number, product_code ORDER BY row_idx) = 1
),
parsed AS (
  SELECT *, true_date AS _date, {number('quantity')} AS _quantity,
         {number('unit_price')} AS _price, {number('total_price')} AS _total,
         coalesce({number('discount_rate')}, 0.0) AS _discount
  FROM unique_rows
),
judged AS (
  SELECT *,
    CASE WHEN _date IS NULL THEN 'date'
         WHEN _quantity IS NULL OR _quantity < 1 THEN 'quantity'
         WHEN _price IS NULL OR _price <= 0 THEN 'price'
         WHEN _total >= 1e13 OR _quantity >= 9007199254740992 THEN 'range' END AS failed_rule,
    CAST(floor(_quantity) AS BIGINT) AS _units, CAST(_price AS DECIMAL(13,2)) AS _unit_price,
    CAST(round(least(greatest(CASE WHEN _discount > 1 THEN _discount / 100.0 ELSE _discount END,
                              0.0), 0.9), 4) AS DECIMAL(5,4)) AS _rate
  FROM parsed
),
cleaned AS (
  SELECT row_idx, {strip("coalesce(order_number, 'nan')")} AS order_number, _date AS order_date,
    {', '.join(f"{_text(c, d)} AS {c}" for c, d in TEXT_DEFAULTS.items())},
    CAST(_unit_price AS DOUBLE) AS unit_price, _units AS quantity,
    CAST(_rate AS DOUBLE) AS discount_rate,
    CASE WHEN _total IS NULL OR _total <= 0
         THEN CAST(round(CAST(_units AS DECIMAL(19,0)) * _unit_price * (1 - _rate), 2) AS DOUBLE)
         ELSE _total END AS total_price,
    CAST(_date AS TIMESTAMP) + INTERVAL 12 HOURS AS order_timestamp
  FROM judged WHERE failed_rule IS NULL
)"""

FIGURES = f"""
figures AS (
  SELECT (SELECT count(*) FROM dirty) AS total_rows, count(*) AS unique_rows,
    count(*) FILTER (failed_rule IS NULL) AS valid_records,
    count(*) FILTER (failed_rule IS NOT NULL) AS rejected_rows,
    count(*) FILTER (failed_rule = 'date') AS rejected_date,
    count(*) FILTER (failed_rule = 'quantity') AS rejected_quantity,
    count(*) FILTER (failed_rule = 'price') AS rejected_price,
    count(*) FILTER (failed_rule = 'range') AS rejected_range,
    count(*) FILTER (failed_rule IS NULL AND _discount > 1) AS scaled_discount,
    count(*) FILTER (failed_rule IS NULL AND (_total IS NULL OR _total <= 0)) AS filled_total_price,
    {', '.join(f"count(*) FILTER (failed_rule IS NULL AND ({_blank(c)})) AS filled_{c}"
               for c in TEXT_DEFAULTS)}
  FROM judged
),
limits AS (
  SELECT CASE WHEN stddev_samp(total_price) > 0
              THEN avg(total_price) + 4 * stddev_samp(total_price) END AS threshold
  FROM cleaned
)"""

IMPUTED = " + ".join(["filled_total_price", *[f"filled_{c}" for c in TEXT_DEFAULTS]])


def cleaned(body: str) -> str:
    return f"WITH {CLEANED.strip()}{body}"


def figures(body: str) -> str:
    return f"WITH {CLEANED.strip()},{FIGURES}{body}"


_ACTIONS = [
    "'Mapped 13 column headers to standardized schema.'",
    "CASE WHEN total_rows > unique_rows THEN 'Identified ' || (total_rows - unique_rows) || "
    "' duplicate row(s) based on [''order_number'', ''product_code'']; deduplicating dataset.' "
    "ELSE 'Zero duplicate transaction rows detected.' END",
    "CASE WHEN rejected_date > 0 THEN 'Rejected ' || rejected_date || "
    "' row(s) with unparseable date formats.' END",
    "'Standardized order dates to ISO 8601 (YYYY-MM-DD).'",
    "CASE WHEN rejected_quantity > 0 THEN 'Rejected ' || rejected_quantity || "
    "' row(s) with non-positive or non-numeric quantity.' END",
    "CASE WHEN rejected_price > 0 THEN 'Rejected ' || rejected_price || "
    "' row(s) with non-positive or non-numeric unit price.' END",
    "CASE WHEN rejected_range > 0 THEN 'Rejected ' || rejected_range || "
    "' row(s) with values too large to store.' END",
    "CASE WHEN scaled_discount > 0 THEN 'Normalized ' || scaled_discount || "
    "' percentage discount values (e.g. 15% -> 0.15).' END",
    "CASE WHEN filled_total_price > 0 THEN 'Recalculated ' || filled_total_price || "
    "' missing or zero total_price values.' END",
    *[
        f"CASE WHEN filled_{c} > 0 THEN 'Imputed ' || filled_{c} || "
        f"' blank values in ''{c}'' with ''{d}''.' END"
        for c, d in TEXT_DEFAULTS.items()
    ],
    "CASE WHEN high > 0 THEN 'Flagged ' || high || ' high-value transaction(s) exceeding $' || "
    "format('{:,.2f}', threshold) || ' for analyst review.' END",
]

LISTED = f""",
listed AS (
  SELECT list_filter([{', '.join(_ACTIONS)}], lambda x: x IS NOT NULL) AS actions
  FROM figures, limits,
       (SELECT count(*) AS high FROM cleaned, limits WHERE total_price > threshold))
"""
ACTIONS = figures(f"""{LISTED}
SELECT CAST(generate_subscripts(actions, 1) AS BIGINT) AS step, unnest(actions) AS action
FROM listed""")

AUDIT_COLUMNS = f"""total_rows, valid_records, total_rows - unique_rows AS duplicate_rows,
  {IMPUTED} AS missing_values_handled, rejected_rows,
  greatest(0.0, least(100.0, round(CAST(valid_records AS DOUBLE) / greatest(total_rows, 1) * 100.0, 2)))
    AS quality_score"""


def _values(rows) -> str:
    def literal(value):
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)

    return ", ".join(
        f"({i}, {', '.join(map(literal, row))})" for i, row in enumerate(rows)
    )


MASTER = f"""
master_regions AS (
  SELECT * FROM (VALUES {_values(REGIONS)}) t(position, region_name, code, country)),
all_regions AS (
  SELECT region_id, region_name, code, country FROM star_regions
  UNION ALL
  SELECT CAST((SELECT max(region_id) FROM star_regions) + row_number() OVER (ORDER BY position)
              AS INTEGER), region_name, code, country
  FROM master_regions WHERE region_name NOT IN (SELECT region_name FROM star_regions)),
master_categories AS (
  SELECT * FROM (VALUES {_values(CATEGORIES)}) t(position, category_name, description)),
base_categories AS (
  SELECT category_id, category_name, CAST(NULL AS VARCHAR) AS description FROM star_categories
  UNION ALL
  SELECT CAST((SELECT max(category_id) FROM star_categories) + row_number() OVER (ORDER BY position)
              AS INTEGER), category_name, description
  FROM master_categories WHERE category_name NOT IN (SELECT category_name FROM star_categories)),
master_products AS (
  SELECT * FROM (VALUES {_values(products())})
    t(position, product_code, product_name, category_name, unit_price, cost_price)),
base_products AS (
  SELECT product_id, product_code, product_name, category_id, unit_price, cost_price, sku
  FROM star_products
  UNION ALL
  SELECT (SELECT max(product_id) FROM star_products) + row_number() OVER (ORDER BY position),
         product_code, product_name, category_id, CAST(m.unit_price AS DECIMAL(10,2)),
         CAST(m.cost_price AS DECIMAL(10,2)), 'SKU-' || product_code
  FROM master_products m JOIN base_categories USING (category_name)
  WHERE product_code NOT IN (SELECT product_code FROM star_products))"""

COMMIT = f"""
{STAR.strip()},{MASTER},{CLEANED},
added_customers AS (
  SELECT (SELECT max(customer_id) FROM star_customers) + row_number() OVER (ORDER BY first_row)
           AS customer_id, customer_code
  FROM (SELECT customer_code, min(row_idx) AS first_row FROM cleaned GROUP BY 1)
  WHERE customer_code NOT IN (SELECT customer_code FROM star_customers)),
all_customers AS (
  SELECT customer_id, customer_code FROM star_customers
  UNION ALL SELECT customer_id, customer_code FROM added_customers),
added_categories AS (
  SELECT CAST((SELECT max(category_id) FROM base_categories)
              + row_number() OVER (ORDER BY first_row) AS INTEGER) AS category_id, category_name
  FROM (SELECT category_name, min(row_idx) AS first_row FROM cleaned GROUP BY 1)
  WHERE category_name NOT IN (SELECT category_name FROM base_categories)),
all_categories AS (
  SELECT category_id, category_name FROM base_categories
  UNION ALL SELECT category_id, category_name FROM added_categories),
added_products AS (
  SELECT (SELECT max(product_id) FROM base_products) + row_number() OVER (ORDER BY row_idx)
           AS product_id, product_code, product_name, category_id,
         CAST(unit_price AS DECIMAL(20,2)) AS unit_price,
         CAST(round(CAST(unit_price AS DECIMAL(20,2)) * CAST(0.65 AS DECIMAL(3,2)), 2)
              AS DECIMAL(20,2)) AS cost_price
  FROM (SELECT * FROM cleaned
        QUALIFY row_number() OVER (PARTITION BY product_code ORDER BY row_idx) = 1)
  LEFT JOIN all_categories USING (category_name)
  WHERE product_code NOT IN (SELECT product_code FROM base_products)),
all_products AS (
  SELECT product_id, product_code FROM base_products
  UNION ALL SELECT product_id, product_code FROM added_products),
rolled AS (
  SELECT c.order_number, row_idx AS first_row, customer_code, region_name, order_date,
         payment_method, order_status, t.total_amount, t.line_count
  FROM cleaned c JOIN (
    SELECT order_number, min(row_idx) AS first_row, count(*) AS line_count,
           sum(CAST(total_price AS DECIMAL(20,2))) AS total_amount
    FROM cleaned GROUP BY 1) t ON t.order_number = c.order_number AND t.first_row = c.row_idx),
placed AS (
  SELECT r.*, coalesce(g.region_id, (SELECT min(region_id) FROM all_regions)) AS region_id,
         g.region_id IS NULL AS unknown_region
  FROM rolled r LEFT JOIN all_regions g USING (region_name)),
added_orders AS (
  SELECT (SELECT max(order_id) FROM star_orders) + row_number() OVER (ORDER BY first_row)
           AS order_id, p.*, customer_id
  FROM placed p JOIN all_customers USING (customer_code)
  WHERE order_number NOT IN (SELECT order_number FROM star_orders)),
all_orders AS (
  SELECT order_id, o.order_number, o.customer_id, o.region_id, o.order_date, o.payment_method,
         o.order_status, coalesce(r.total_amount, o.total_amount) AS total_amount
  FROM star_orders o LEFT JOIN rolled r ON r.order_number = o.order_number
  UNION ALL
  SELECT order_id, order_number, customer_id, region_id, order_date, payment_method, order_status,
         total_amount FROM added_orders)"""


def commit(body: str) -> str:
    return f"WITH {COMMIT.strip()}{body}"
