"""DuckDB text for the synthetic sales."""

from __future__ import annotations

from martlight.functions import draws
from martlight.operators import generate as g
from martlight.operators.master import REGIONS, products
from martlight.plans.clean_sql import MASTER
from martlight.plans.star_sql import STAR


def seed(i: str) -> str:
    p = draws.MODULUS - 1
    return f"(({i} + (({i} // {p}) % {p}) * {draws.WRAP_STEP}) % {p} + 1)"


def draw(i: str, number: int) -> str:
    first = f"({seed(i)} * CAST({draws.stream_multiplier(number)} AS BIGINT)) % {draws.MODULUS}"
    return f"((({first}) * {draws.SCRAMBLE_MULTIPLIER}) % {draws.SCRAMBLE_MODULUS})"


def pick(i: str, number: int, size) -> str:
    return f"({draw(i, number)} % {size})"


def quoted(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def weighted(i: str, number: int, values, weights) -> str:
    u, reached, parts = draw(i, number), 0.0, []
    for value, weight in zip(values[:-1], weights[:-1]):
        reached += weight
        limit = round(reached * draws.SCRAMBLE_MODULUS)
        parts.append(f"WHEN {u} < {limit} THEN {quoted(value)}")
    return f"CASE {' '.join(parts)} ELSE {quoted(values[-1])} END"


def one_of(i: str, number: int, values) -> str:
    return f"[{', '.join(map(quoted, values))}][{pick(i, number, len(values))} + 1]"


DAYS = (g.LAST_DAY - g.FIRST_DAY).days + 1
DAY = f"(DATE '{g.FIRST_DAY}' + CAST({pick('id', g.DAY, DAYS)} AS INTEGER))"
WEIGHT = f"""list_extract([{', '.join(f'{w}::DOUBLE' for w in g.MONTH_WEIGHTS)}], month(order_date))
  * CASE WHEN month(order_date) = 11 AND day(order_date) >= 20 THEN {g.LATE_NOVEMBER}::DOUBLE
         WHEN month(order_date) = 12 AND day(order_date) <= 22 THEN {g.EARLY_DECEMBER}::DOUBLE
         ELSE 1.0::DOUBLE END"""
REGION_NAMES = [r[0] for r in REGIONS]

CANDIDATES = f"""
ids AS (SELECT o_orderkey AS id FROM orders),
dated AS (SELECT id, {DAY} AS order_date FROM ids),
candidates AS (
  SELECT id, order_date,
         CAST({draw('id', g.ACCEPT)} AS DOUBLE) / {float(draws.SCRAMBLE_MODULUS)}::DOUBLE
           <= ({WEIGHT}) / {g.FULL_ACCEPTANCE}::DOUBLE AS accepted
  FROM dated)"""

ATTRIBUTES = f"""{weighted('id', g.REGION, REGION_NAMES, g.REGION_WEIGHTS)} AS region_name,
  {weighted('id', g.PAYMENT, g.PAYMENT_METHODS, g.PAYMENT_WEIGHTS)} AS payment_method,
  {weighted('id', g.STATUS, g.STATUSES, g.STATUS_WEIGHTS)} AS order_status,
  CAST({weighted('id', g.ITEMS, g.ITEM_COUNTS, g.ITEM_COUNT_WEIGHTS)} AS INTEGER) AS item_count"""

_SECONDS = (f"({pick('id', g.HOUR, g.OPEN_HOURS)} + {g.OPENING_HOUR}) * 3600 + "
            f"{pick('id', g.MINUTE, 60)} * 60 + {pick('id', g.SECOND, 60)}")
_STEPS = [s for s in range(1, len(products())) if s * 2 != len(products())]


def _by_position(number: int, values, weights, kind: str) -> str:
    parts = " ".join(
        f"WHEN position = {k} THEN CAST({weighted('id', g.ITEM_DRAWS + 10 * k + number, values, weights)} AS {kind})"
        for k in range(max(g.ITEM_COUNTS))
    )
    return f"CASE {parts} END"


_CATALOGUE = ", ".join(
    f"({slot}, {', '.join(map(quoted, row))})" for slot, row in enumerate(products(), start=1)
)
_SHIPPING = ", ".join(f"CAST({c} AS DECIMAL(10,2))" for c in g.SHIPPING_COSTS)

# The target is half the number of ids: it is reached before the ids run out.
SALES = f"""{CANDIDATES},
accepted AS (SELECT id, order_date, {ATTRIBUTES} FROM candidates WHERE accepted),
cut AS (
  SELECT * EXCLUDE (so_far) FROM (
    SELECT *, sum(item_count) OVER (ORDER BY id) AS so_far FROM accepted)
  WHERE so_far - item_count < (SELECT count(*) // 2 FROM orders)),
numbered AS (
  SELECT id, (SELECT max(o_orderkey) + 1 FROM orders) + row_number() OVER (ORDER BY id) - 1 AS order_id,
         order_date, CAST(order_date AS TIMESTAMP) + to_seconds({_SECONDS}) AS order_timestamp,
         region_name, payment_method, order_status, item_count
  FROM cut),
sold AS (
  SELECT *, 'ORD-' || year(order_date) || '-' || lpad(CAST(order_id AS VARCHAR), 7, '0') AS order_number
  FROM numbered),
catalogue AS (
  SELECT * FROM (VALUES {_CATALOGUE})
    t(slot, product_code, product_name, category_name, unit_price, cost_price)),
placed AS (
  SELECT *, CAST(({pick('id', g.FIRST_PRODUCT, len(products()))}
                  + position * {one_of('id', g.PRODUCT_STEP, _STEPS)}) % {len(products())} + 1 AS INTEGER) AS slot,
         {_by_position(g.QUANTITY, g.QUANTITIES, g.QUANTITY_WEIGHTS, 'INTEGER')} AS quantity,
         {_by_position(g.DISCOUNT, g.DISCOUNTS, g.DISCOUNT_WEIGHTS, 'DECIMAL(5,4)')} AS discount_rate
  FROM (SELECT id, order_id, CAST(unnest(range(item_count)) AS INTEGER) AS position FROM sold)),
sold_items AS (
  SELECT order_id, id, position, product_code, product_name, category_name, quantity, discount_rate,
         CAST(unit_price AS DECIMAL(10,2)) AS unit_price, CAST(cost_price AS DECIMAL(10,2)) AS cost_price,
         CAST(round(quantity * CAST(unit_price AS DECIMAL(10,2)) * (1 - discount_rate), 2)
              AS DECIMAL(12,2)) AS total_price
  FROM placed JOIN catalogue USING (slot)),
subtotals AS (SELECT order_id, sum(total_price) AS subtotal FROM sold_items GROUP BY 1),
buyers AS (
  SELECT customer_id, row_number() OVER (ORDER BY customer_id) AS number FROM star_customers),
totalled AS (
  SELECT s.*, b.customer_id,
         CASE WHEN subtotal > {g.FREE_SHIPPING_ABOVE} THEN CAST(0 AS DECIMAL(10,2))
              ELSE [{_SHIPPING}][{pick('id', g.SHIPPING, len(g.SHIPPING_COSTS))} + 1] END AS shipping_cost,
         subtotal
  FROM sold s JOIN subtotals USING (order_id)
  JOIN buyers b ON b.number = {pick('id', g.CUSTOMER, '(SELECT count(*) FROM star_customers)')} + 1)"""


def candidates(body: str) -> str:
    return f"WITH {CANDIDATES.strip()}{body}"


def sales(body: str) -> str:
    return f"WITH {STAR.strip()},{SALES}{body}"


DIMENSIONS = f"""WITH {STAR.strip()},{MASTER}
SELECT 'regions' AS table_name, CAST(region_id AS BIGINT) AS id, region_name AS name,
       country AS detail, CAST(NULL AS DOUBLE) AS price
FROM all_regions
UNION ALL SELECT 'categories', category_id, category_name, description, NULL FROM base_categories
UNION ALL SELECT 'products', product_id, product_code, sku, CAST(unit_price AS DOUBLE) FROM base_products"""

_CITIES = ", ".join(
    f"{{'city': {quoted(c)}, 'state': {quoted(s)}, 'country': {quoted(n)}}}" for c, s, n in g.CITIES
)
CUSTOMERS = f"""
WITH ids AS (SELECT c_custkey + 1 AS id FROM customer),
drawn AS (
  SELECT id, {one_of('id', g.FIRST, g.FIRST_NAMES)} AS first_name,
         {one_of('id', g.LAST, g.LAST_NAMES)} AS last_name,
         {one_of('id', g.DOMAIN, g.MAIL_DOMAINS)} AS domain,
         [{_CITIES}][{pick('id', g.CITY, len(g.CITIES))} + 1] AS place,
         DATE '{g.FIRST_DAY}' + CAST({pick('id', g.JOINED, g.CUSTOMER_DAYS)} AS INTEGER) AS created_on
  FROM ids)
SELECT id, 'CUST-' || lpad(CAST(id AS VARCHAR), CAST(greatest(5, length(CAST(id AS VARCHAR))) AS INTEGER), '0') AS customer_code,
       first_name, last_name,
       lower(last_name) || '-' || lower(substr(first_name, 1, 1)) || id || '@' || domain AS email,
       'Standard' AS segment, place.city AS city, place.state AS state, place.country AS country,
       created_on
FROM drawn"""
