"""DuckDB text for the bound star tables and the report queries over them."""

from __future__ import annotations

STAR = """
star_regions AS (
  SELECT r_regionkey AS region_id, r_name AS region_name, substr(r_name, 1, 2) AS code, c.country
  FROM region JOIN (SELECT n_regionkey, min(n_name) AS country FROM nation GROUP BY 1) c
    ON c.n_regionkey = r_regionkey
),
star_categories AS (
  SELECT CAST(min(p_partkey) AS INTEGER) AS category_id, p_type AS category_name
  FROM part WHERE p_type IS NOT NULL GROUP BY p_type
),
star_customers AS (
  SELECT c_custkey AS customer_id, c_name AS customer_code,
         split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
         lower(c_name) || '@example.com' AS email, 'Standard' AS segment,
         n_name AS city, CAST(NULL AS VARCHAR) AS state, n_name AS country
  FROM customer JOIN nation ON n_nationkey = c_nationkey
),
star_products AS (
  SELECT p_partkey AS product_id, 'PROD-' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS product_code,
         p_name AS product_name, c.category_id,
         CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price,
         CAST(round(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.65 AS DECIMAL(3,2)), 2)
              AS DECIMAL(10,2)) AS cost_price,
         p_brand AS sku, true AS is_active
  FROM part JOIN star_categories c ON c.category_name = p_type
),
star_orders AS (
  SELECT o_orderkey AS order_id, 'ORD-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS order_number,
         CAST(o_orderdate AS TIMESTAMP) AS order_timestamp, o_custkey AS customer_id, n_regionkey AS region_id, CAST(o_orderdate AS DATE) AS order_date,
         o_orderpriority AS payment_method,
         CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Shipped'
              WHEN 'P' THEN 'Processing' END AS order_status,
         CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
),
star_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(CAST((2 * CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT)
                    + CAST(l_quantity AS INTEGER)) // (2 * CAST(l_quantity AS INTEGER)) AS DOUBLE)
              / 100 AS DECIMAL(10,2)) AS unit_price,
         CAST(l_discount AS DECIMAL(5,4)) AS discount_rate,
         CAST(round(CAST(l_extendedprice AS DECIMAL(12,2))
                    * (1 - CAST(l_discount AS DECIMAL(5,4))), 2) AS DECIMAL(12,2)) AS total_price
  FROM lineitem
),
lines AS (
  SELECT o.order_id, o.order_number, o.customer_id, o.region_id, o.order_date, o.payment_method,
         o.order_status, i.product_id, i.quantity, i.unit_price, i.discount_rate, i.total_price,
         p.product_code, p.product_name, p.category_id, p.unit_price AS list_price, p.cost_price
  FROM star_orders o JOIN star_items i ON i.order_id = o.order_id
  JOIN star_products p ON p.product_id = i.product_id
)"""

REVENUE = "order_status IN ('Completed', 'Shipped')"
AOV = ("round(CAST(sum(total_price) AS DOUBLE) / nullif(count(DISTINCT order_id), 0), 2)")
SUM_REVENUE = "coalesce(CAST(sum(total_price) AS DOUBLE), 0.0)"
SUM_UNITS = "CAST(coalesce(sum(quantity), 0) AS BIGINT)"
N_ORDERS = "count(DISTINCT order_id)"


def star(body: str) -> str:
    """A statement over the star tables; ``body`` may open with further CTEs."""
    return f"WITH {STAR.strip()}{body}"


def kpi_primary(where: str) -> str:
    return star(f"""
SELECT {SUM_REVENUE} AS total_revenue, {N_ORDERS} AS total_orders, {SUM_UNITS} AS units_sold,
       count(DISTINCT customer_id) AS total_customers
FROM lines WHERE {where}""")


def kpis(current: str, prior: str, status: str = REVENUE) -> str:
    """``current`` and ``prior`` are date conditions."""
    return star(f""",
cur AS (SELECT * FROM lines WHERE {status} AND {current}),
figures AS (
  SELECT {SUM_REVENUE} AS total_revenue, {N_ORDERS} AS total_orders, {SUM_UNITS} AS units_sold,
         count(DISTINCT customer_id) AS total_customers FROM cur),
earlier AS (SELECT {SUM_REVENUE} AS prior_revenue FROM lines WHERE {status} AND {prior}),
best_product AS (
  SELECT product_name AS name, CAST(sum(total_price) AS DOUBLE) AS revenue
  FROM cur GROUP BY product_id, product_name ORDER BY sum(total_price) DESC, product_id LIMIT 1),
top_region AS (
  SELECT region_name AS name, CAST(sum(total_price) AS DOUBLE) AS revenue
  FROM cur JOIN star_regions USING (region_id)
  GROUP BY region_id, region_name ORDER BY sum(total_price) DESC, region_id LIMIT 1),
kpi_row AS (
SELECT total_revenue, total_orders, units_sold, total_customers,
       CASE WHEN total_orders > 0 THEN round(total_revenue / total_orders, 2) ELSE 0.0 END AS aov,
       CASE WHEN prior_revenue > 0
              THEN round((total_revenue - prior_revenue) / prior_revenue * 100.0, 2)
            WHEN prior_revenue = 0 AND total_revenue > 0 THEN 100.0 ELSE 0.0 END AS growth_pct,
       prior_revenue,
       coalesce((SELECT name FROM best_product), 'N/A') AS best_product_name,
       coalesce((SELECT revenue FROM best_product), 0.0) AS best_product_revenue,
       coalesce((SELECT name FROM top_region), 'N/A') AS top_region_name,
       coalesce((SELECT revenue FROM top_region), 0.0) AS top_region_revenue
FROM figures, earlier)""")


def kpi_row(current: str, prior: str) -> str:
    return kpis(current, prior) + "\nSELECT * FROM kpi_row"


def report_summary(current: str, prior: str) -> str:
    return kpis(current, prior) + """
SELECT CAST(position AS BIGINT) AS position, metric, value FROM (
  SELECT 1 AS position, 'TOTAL REVENUE' AS metric, format('${:,.2f}', total_revenue) AS value FROM kpi_row
  UNION ALL SELECT 2, 'Units Sold', format('{:,}', units_sold) FROM kpi_row
  UNION ALL SELECT 3, 'TOTAL ORDERS', format('{:,}', total_orders) FROM kpi_row
  UNION ALL SELECT 4, 'Avg Order Value (AOV)', format('${:,.2f}', aov) FROM kpi_row
  UNION ALL SELECT 5, 'TOTAL CUSTOMERS', format('{:,}', total_customers) FROM kpi_row
  UNION ALL SELECT 6, 'YoY Revenue Growth', format('{:+.2f}%', growth_pct) FROM kpi_row
  UNION ALL SELECT 7, 'TOP PERFORMING REGION', top_region_name FROM kpi_row
  UNION ALL SELECT 8, 'Best-Selling Product', best_product_name FROM kpi_row)"""


def monthly(where: str = REVENUE) -> str:
    return star(f"""
SELECT strftime(order_date, '%Y-%m') AS year_month, {SUM_REVENUE} AS revenue,
       {N_ORDERS} AS orders_count, {SUM_UNITS} AS units_sold, {AOV} AS aov
FROM lines WHERE {where} GROUP BY 1""")


def categories(where: str = REVENUE) -> str:
    return star(f"""
SELECT category_id, category_name, {SUM_REVENUE} AS total_revenue, {SUM_UNITS} AS units_sold,
       {N_ORDERS} AS orders_count,
       round(CAST(sum(unit_price) AS DOUBLE) / count(*), 2) AS avg_item_price,
       round(CAST(sum(total_price) AS DOUBLE)
             / CAST(sum(sum(total_price)) OVER () AS DOUBLE) * 100.0, 2) AS share_pct
FROM lines JOIN star_categories USING (category_id)
WHERE {where} GROUP BY category_id, category_name""")


def _regions(where: str) -> str:
    return star(f""",
perf AS (
SELECT region_id, region_name, code AS region_code, country, {SUM_REVENUE} AS total_revenue,
       {N_ORDERS} AS total_orders, {SUM_UNITS} AS units_sold, {AOV} AS aov,
       row_number() OVER (ORDER BY sum(total_price) DESC, region_id) AS rank,
       round(CAST(sum(total_price) AS DOUBLE)
             / CAST(sum(sum(total_price)) OVER () AS DOUBLE) * 100.0, 2) AS share_pct
FROM lines JOIN star_regions USING (region_id)
WHERE {where} GROUP BY region_id, region_name, code, country)""")


def regions(where: str = REVENUE) -> str:
    return _regions(where) + "\nSELECT * FROM perf"


def report_regions() -> str:
    return _regions(REVENUE) + """
SELECT rank AS "Rank", region_name AS "Region Name", region_code AS "Region Code",
       country AS "Country", total_orders AS "Total Orders", units_sold AS "Units Sold",
       total_revenue AS "Total Revenue ($)", share_pct / 100.0 AS "Revenue Share %", aov AS "AOV ($)"
FROM perf"""


def _segments(hi: int, mid: int, where: str) -> str:
    return star(f""",
spend AS (
  SELECT customer_id, sum(total_price) AS spend, {N_ORDERS} AS orders
  FROM lines WHERE {where} GROUP BY 1),
tiers AS (
  SELECT CASE WHEN spend >= {hi} THEN 'High Spending (VIP)'
              WHEN spend >= {mid} THEN 'Medium Spending' ELSE 'Low Spending' END AS segment_name,
         count(*) AS customer_count, CAST(sum(spend) AS DOUBLE) AS total_segment_spend,
         round(CAST(sum(spend) AS DOUBLE) / count(*), 2) AS avg_spend_per_customer,
         CAST(sum(orders) AS BIGINT) AS total_orders,
         round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER () AS DOUBLE) * 100.0, 2) AS share_pct
  FROM spend GROUP BY 1)""")


def segments(hi: int, mid: int, where: str = REVENUE) -> str:
    return _segments(hi, mid, where) + "\nSELECT * FROM tiers"


def report_segments(hi: int, mid: int) -> str:
    return _segments(hi, mid, REVENUE) + """
SELECT segment_name AS "Segment Name", customer_count AS "Customer Count",
       share_pct / 100.0 AS "Share %", total_orders AS "Total Orders",
       total_segment_spend AS "Total Segment Spend ($)",
       avg_spend_per_customer AS "Avg Spend / Customer ($)"
FROM tiers"""


def payments(where: str = REVENUE) -> str:
    return star(f"""
SELECT payment_method, {SUM_REVENUE} AS total_revenue, {N_ORDERS} AS orders_count,
       round(CAST(sum(total_price) AS DOUBLE)
             / CAST(sum(sum(total_price)) OVER () AS DOUBLE) * 100.0, 2) AS share_pct
FROM lines WHERE {where} GROUP BY 1""")


def top_products(limit: int, columns: str, where: str = REVENUE) -> str:
    return star(f""",
best AS (
SELECT product_id, product_code, product_name, category_name,
       CAST(list_price AS DOUBLE) AS unit_price, {SUM_UNITS} AS units_sold,
       {SUM_REVENUE} AS total_revenue,
       row_number() OVER (ORDER BY sum(total_price) DESC, product_id) AS rank
FROM lines JOIN star_categories USING (category_id) WHERE {where}
GROUP BY product_id, product_code, product_name, category_name, list_price)
SELECT {columns} FROM best WHERE rank <= {limit}""")


TOP_CUSTOMERS = star(f"""
SELECT customer_id, customer_code, first_name || ' ' || last_name AS customer_name, email, city,
       country, {N_ORDERS} AS orders_count, {SUM_REVENUE} AS total_spent, {AOV} AS avg_order_val
FROM lines JOIN star_customers USING (customer_id) WHERE {REVENUE}
GROUP BY customer_id, customer_code, first_name, last_name, email, city, country
ORDER BY sum(total_price) DESC, customer_id LIMIT 10""")

YOY_LONG = star(f"""
SELECT CAST(year(order_date) AS INTEGER) AS order_year,
       CAST(month(order_date) AS INTEGER) AS order_month, {SUM_REVENUE} AS revenue
FROM lines WHERE {REVENUE} GROUP BY 1, 2""")


def yoy_matrix(month_names) -> str:
    slots = ",\n       ".join(
        f"coalesce(CAST(sum(total_price) FILTER (month(order_date) = {i}) AS DOUBLE), 0.0) AS \"{name}\""
        for i, name in enumerate(month_names, start=1)
    )
    return star(f"""
SELECT CAST(year(order_date) AS INTEGER) AS order_year,
       {slots}
FROM lines WHERE {REVENUE} GROUP BY 1""")


MONTHLY_YOY_LAG = star(f""",
monthly AS (
  SELECT strftime(order_date, '%Y-%m') AS year_month,
         CAST(sum(total_price) AS DOUBLE) AS current_revenue, {N_ORDERS} AS total_orders
  FROM lines WHERE {REVENUE} GROUP BY 1),
lagged AS (
  SELECT *, lag(current_revenue, 12) OVER (ORDER BY year_month) AS prior FROM monthly)
SELECT year_month, current_revenue, coalesce(prior, 0.0) AS prior_year_revenue, total_orders,
       CASE WHEN prior IS NULL OR prior = 0 THEN 'N/A (Baseline)'
            ELSE CAST(round((current_revenue - prior) / prior * 100.0, 2) AS VARCHAR) || '%'
       END AS yoy_growth_pct
FROM lagged ORDER BY year_month DESC LIMIT 24""")

REGIONAL_DENSE_RANK = star(f""",
totals AS (
  SELECT region_name, country, {N_ORDERS} AS total_orders, {SUM_UNITS} AS total_units,
         sum(total_price) AS revenue
  FROM lines JOIN star_regions USING (region_id) WHERE {REVENUE} GROUP BY 1, 2)
SELECT dense_rank() OVER (ORDER BY revenue DESC) AS sales_rank, region_name, country, total_orders,
       total_units, CAST(revenue AS DOUBLE) AS territory_revenue,
       CAST(round(CAST(revenue AS DOUBLE) * 100.0 / CAST(sum(revenue) OVER () AS DOUBLE), 2)
            AS VARCHAR) || '%' AS global_share_pct
FROM totals""")

TOP_PRODUCTS_PER_CATEGORY = star(f""",
sales AS (
  SELECT category_name, product_code, product_name, {SUM_UNITS} AS units_sold,
         sum(total_price) AS revenue
  FROM lines JOIN star_categories USING (category_id) WHERE {REVENUE} GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY category_name ORDER BY revenue DESC) AS category_rank
  FROM sales)
SELECT category_name, category_rank, product_code, product_name, units_sold,
       CAST(revenue AS DOUBLE) AS total_revenue
FROM ranked WHERE category_rank <= 3""")


def customer_value(hi: int, mid: int) -> str:
    return star(f"""
SELECT customer_code, first_name || ' ' || last_name AS customer_name, city, country,
       {N_ORDERS} AS total_orders, {SUM_UNITS} AS total_items_bought,
       CAST(sum(total_price) AS DOUBLE) AS lifetime_spend,
       round(CAST(sum(total_price) AS DOUBLE) / count(*), 2) AS avg_item_spend,
       max(order_date) AS most_recent_purchase,
       CASE WHEN sum(total_price) >= {hi} THEN 'VIP / High Value'
            WHEN sum(total_price) >= {mid} THEN 'Mid-Tier Spender'
            ELSE 'Casual Spender' END AS spending_segment
FROM lines JOIN star_customers USING (customer_id) WHERE order_status = 'Completed'
GROUP BY customer_id, customer_code, first_name, last_name, city, country
ORDER BY sum(total_price) DESC, customer_id LIMIT 20""")


RUNNING_TOTAL = star(f""",
daily AS (
  SELECT order_date, {N_ORDERS} AS daily_orders, sum(total_price) AS revenue
  FROM lines WHERE {REVENUE} GROUP BY 1)
SELECT order_date, daily_orders, CAST(revenue AS DOUBLE) AS daily_revenue,
       CAST(sum(revenue) OVER (ORDER BY order_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            AS DOUBLE) AS cumulative_revenue
FROM daily ORDER BY order_date DESC LIMIT 30""")


def category_profit(min_orders: int) -> str:
    return star(f""",
sums AS (
  SELECT category_name, {N_ORDERS} AS orders, {SUM_UNITS} AS units, sum(total_price) AS revenue,
         sum(quantity * cost_price) AS cost
  FROM lines JOIN star_categories USING (category_id) WHERE order_status = 'Completed'
  GROUP BY category_id, category_name HAVING count(DISTINCT order_id) >= {min_orders})
SELECT category_name, orders AS order_occurrences, units AS total_units_sold,
       CAST(revenue AS DOUBLE) AS gross_revenue, CAST(cost AS DOUBLE) AS estimated_cost,
       CAST(revenue - cost AS DOUBLE) AS estimated_gross_profit,
       CAST(round(CAST(revenue - cost AS DOUBLE) / CAST(revenue AS DOUBLE) * 100.0, 2)
            AS VARCHAR) || '%' AS gross_margin_pct
FROM sums""")


def ledger(limit: int, offset: int) -> str:
    return star(f"""
SELECT order_id, order_number, order_date, customer_code,
       first_name || ' ' || last_name AS customer_name, region_name, payment_method, order_status,
       count(*) AS items_count, {SUM_REVENUE} AS order_total
FROM lines JOIN star_customers USING (customer_id) JOIN star_regions USING (region_id)
WHERE {REVENUE} GROUP BY ALL ORDER BY order_date DESC, order_id DESC LIMIT {limit} OFFSET {offset}""")


LEDGER_COUNT = star(f"""
SELECT {N_ORDERS} AS total_count,
       greatest(CAST(1 AS BIGINT), ({N_ORDERS} + 24) // 25) AS total_pages
FROM lines WHERE {REVENUE}""")

EXPORT_LINES = star(f"""
SELECT order_number AS "Order ID", order_date AS "Order Date", customer_code AS "Customer Code",
       first_name || ' ' || last_name AS "Customer Name", city AS "City", c.country AS "Country",
       region_name AS "Region", product_code AS "Product Code", product_name AS "Product Name",
       category_name AS "Category", quantity AS "Quantity",
       CAST(unit_price AS DOUBLE) AS "Unit Price", CAST(discount_rate AS DOUBLE) AS "Discount Rate",
       CAST(total_price AS DOUBLE) AS "Line Total", payment_method AS "Payment Method",
       order_status AS "Status"
FROM lines JOIN star_categories USING (category_id) JOIN star_customers c USING (customer_id)
JOIN star_regions USING (region_id)
WHERE {REVENUE}
ORDER BY order_date DESC, order_id DESC, product_id, quantity, total_price, unit_price, discount_rate""")
EXPORT_NEWEST_ROWS = 20_000
EXPORT_NEWEST = f"{EXPORT_LINES}\nLIMIT {EXPORT_NEWEST_ROWS}"
