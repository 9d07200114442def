"""Synthetic sales as a distributed job: every value is a function of a row id."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.functions.draws import SCRAMBLE_MODULUS, draw, pick, weighted
from martlight.functions.money import PRICE, RATE, TOTAL, line_total
from martlight.functions.numbering import number_rows, running_totals
from martlight.operators.ingest import next_ids, refresh_segments
from martlight.operators.master import REGIONS, ensure_master, products
from martlight.schema import column_types
from martlight.session import stored
from martlight.sources.star import LOGS, Draft, Star, largest_id, read_star, spend_of, with_month

# Distributions of the generated sales.
FIRST_DAY = dt.date(2023, 1, 1)
LAST_DAY = dt.date(2026, 3, 31)
MONTH_WEIGHTS = (0.85, 0.90, 1.00, 1.02, 1.05, 1.08, 1.10, 1.15, 1.12, 1.18, 1.45, 1.60)
LATE_NOVEMBER = 1.35
EARLY_DECEMBER = 1.25
FULL_ACCEPTANCE = 1.7
REGION_WEIGHTS = (0.38, 0.28, 0.20, 0.08, 0.06)
PAYMENT_METHODS = ("Credit Card", "PayPal", "Bank Transfer", "Debit Card")
PAYMENT_WEIGHTS = (0.46, 0.26, 0.18, 0.10)
STATUSES = ("Completed", "Shipped", "Processing", "Cancelled", "Refunded")
STATUS_WEIGHTS = (0.90, 0.05, 0.02, 0.015, 0.015)
ITEM_COUNTS = (1, 2, 3, 4)
ITEM_COUNT_WEIGHTS = (0.65, 0.22, 0.10, 0.03)
QUANTITIES = (1, 2, 3, 4, 5)
QUANTITY_WEIGHTS = (0.72, 0.16, 0.07, 0.03, 0.02)
DISCOUNTS = ("0.00", "0.05", "0.10", "0.15", "0.20")
DISCOUNT_WEIGHTS = (0.60, 0.16, 0.14, 0.07, 0.03)
SHIPPING_COSTS = ("9.99", "14.99", "19.99")
FREE_SHIPPING_ABOVE = 150
OPENING_HOUR, OPEN_HOURS = 8, 15
CUSTOMER_COUNT = 2500
ENOUGH_CUSTOMERS = 1500
CUSTOMER_DAYS = 701
DEFAULT_RECORDS = 50_000
LOG_FILENAME = "synthetic_sales_generator"
LOG_FILE_TYPE = "Synthetic Generator"
LOG_STATUS = "Generated"

# Sample values of generated customers; own choice, nothing depends on them.
FIRST_NAMES = ("Ada", "Ben", "Chloe", "Dev", "Elif", "Finn", "Grace", "Hugo", "Ines", "Jonas")
LAST_NAMES = ("Abel", "Bauer", "Costa", "Diaz", "Evans", "Fischer", "Gupta", "Haas", "Ito", "Jansen")
MAIL_DOMAINS = ("example.com", "example.org", "example.net")
CITIES = (
    ("Chicago", "IL", "United States"), ("Toronto", "ON", "Canada"),
    ("Berlin", "Berlin", "Germany"), ("Madrid", "Madrid", "Spain"),
    ("Tokyo", "Kanto", "Japan"), ("Sydney", "NSW", "Australia"),
    ("Lima", "Lima", "Peru"), ("Santiago", "Santiago", "Chile"),
    ("Dubai", "Dubai", "United Arab Emirates"), ("Nairobi", "Nairobi", "Kenya"),
)

# Draw numbers, one per decision. Items use their own block of numbers per position.
(DAY, ACCEPT, HOUR, MINUTE, SECOND, CUSTOMER, REGION, PAYMENT, STATUS, ITEMS, FIRST_PRODUCT,
 PRODUCT_STEP, SHIPPING) = range(13)
FIRST, LAST, DOMAIN, CITY, JOINED = range(20, 25)
ITEM_DRAWS, QUANTITY, DISCOUNT = 40, 0, 1


def season_weight(day: Column) -> Column:
    month, day_of_month = F.month(day), F.dayofmonth(day)
    weight = F.element_at(F.array(*map(F.lit, MONTH_WEIGHTS)), month)
    return (
        F.when((month == 11) & (day_of_month >= 20), weight * LATE_NOVEMBER)
        .when((month == 12) & (day_of_month <= 22), weight * EARLY_DECEMBER)
        .otherwise(weight)
    )


def candidates(ids: DataFrame) -> DataFrame:
    """One possible order per id: a uniform day and whether the season accepts it."""
    day = F.date_add(F.lit(FIRST_DAY), pick(F.col("id"), DAY, (LAST_DAY - FIRST_DAY).days + 1)
                     .cast("int"))
    days = ids.select("id", day.alias("order_date"))
    u = draw(F.col("id"), ACCEPT) / F.lit(float(SCRAMBLE_MODULUS))
    return days.withColumn(
        "accepted", u <= season_weight(F.col("order_date")) / FULL_ACCEPTANCE
    )


def order_attributes(ids: DataFrame) -> DataFrame:
    """Weighted choices per id."""
    i = F.col("id")
    choices = {
        "region_name": (REGION, [r[0] for r in REGIONS], REGION_WEIGHTS),
        "payment_method": (PAYMENT, PAYMENT_METHODS, PAYMENT_WEIGHTS),
        "order_status": (STATUS, STATUSES, STATUS_WEIGHTS),
        "item_count": (ITEMS, ITEM_COUNTS, ITEM_COUNT_WEIGHTS),
    }
    drawn = ids.withColumns({f"_{name}": draw(i, choice[0]) for name, choice in choices.items()})
    return drawn.withColumns({
        name: weighted(F.col(f"_{name}"), values, weights)
        for name, (_, values, weights) in choices.items()
    }).drop(*[f"_{name}" for name in choices])


def orders_until(ids: DataFrame, total_records: int | Column | None = None,
                 first_number: int | Column = 1) -> DataFrame:
    """Accepted orders in id order, numbered, up to the one that reaches the record target."""
    accepted = order_attributes(candidates(ids).where("accepted").drop("accepted"))
    # One pass gives both: orders are cut behind the target, so their numbers stay without gaps.
    numbered = running_totals(
        accepted, "id", {"_so_far": F.col("item_count"), "_n": F.lit(1)}
    ).withColumn("order_id", F.col("_n") + first_number - 1)
    if total_records is not None:
        numbered = numbered.where(F.col("_so_far") - F.col("item_count") < total_records)
    i = F.col("id")
    seconds = (
        (pick(i, HOUR, OPEN_HOURS) + OPENING_HOUR) * 3600
        + pick(i, MINUTE, 60) * 60 + pick(i, SECOND, 60)
    )
    return numbered.select(
        "id", "order_id",
        F.concat(
            F.lit("ORD-"), F.year("order_date").cast("string"), F.lit("-"),
            F.format_string("%07d", F.col("order_id")),
        ).alias("order_number"),
        "order_date",
        (F.col("order_date").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds))
        .alias("order_timestamp"),
        "region_name", "payment_method", "order_status", "item_count",
    )


def explode_items(orders: DataFrame) -> DataFrame:
    """The items of each order: distinct products, quantity, discount and line total.

    Products step through the catalogue from a drawn start; a step other than half its length never
    meets the same product twice within four items.
    """
    catalogue = products()
    size = len(catalogue)
    i, position = F.col("id"), F.col("position")
    steps = [s for s in range(1, size) if s * 2 != size]
    step = F.element_at(
        F.array(*map(F.lit, steps)), (pick(i, PRODUCT_STEP, len(steps)) + 1).cast("int"))
    entries = F.array(*[
        F.struct(
            F.lit(code).alias("product_code"), F.lit(name).alias("product_name"),
            F.lit(category).alias("category_name"),
            F.lit(price).cast(PRICE).alias("unit_price"),
            F.lit(cost).cast(PRICE).alias("cost_price"),
        )
        for code, name, category, price, cost in catalogue
    ])

    def item_draw(number: int) -> Column:
        # A draw number per item position: the order id is the same for all its items.
        numbers = [ITEM_DRAWS + 10 * k + number for k in range(max(ITEM_COUNTS))]
        return draw(i, numbers, position)

    exploded = orders.withColumn(
        "position", F.explode(F.sequence(F.lit(0), F.col("item_count") - 1)))
    drawn = exploded.withColumns({
        "_slot": ((pick(i, FIRST_PRODUCT, size) + position * step) % size + 1).cast("int"),
        "_quantity": item_draw(QUANTITY),
        "_discount": item_draw(DISCOUNT),
    })
    chosen = drawn.withColumns({
        "quantity": weighted(F.col("_quantity"), QUANTITIES, QUANTITY_WEIGHTS),
        "discount_rate": weighted(F.col("_discount"), DISCOUNTS, DISCOUNT_WEIGHTS).cast(RATE),
    }).drop("_quantity", "_discount")
    named = chosen.withColumn("_product", F.element_at(entries, F.col("_slot"))).select(
        *[c for c in chosen.columns if c != "_slot"], "_product.*"
    )
    amount = F.col("quantity").cast("decimal(4,0)") * F.col("unit_price")
    return named.withColumn("total_price", line_total(amount, F.col("discount_rate")))


def shipping_cost(subtotal: Column) -> Column:
    i = F.col("id")
    paid = F.element_at(
        F.array(*[F.lit(c).cast(PRICE) for c in SHIPPING_COSTS]),
        (pick(i, SHIPPING, len(SHIPPING_COSTS)) + 1).cast("int"),
    )
    return F.when(subtotal > FREE_SHIPPING_ABOVE, F.lit(0).cast(PRICE)).otherwise(paid)


def with_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with shipping and total from their items' line totals."""
    subtotals = items.groupBy("order_id").agg(F.sum("total_price").alias("_subtotal"))
    priced = orders.join(subtotals, "order_id").withColumn(
        "shipping_cost", shipping_cost(F.col("_subtotal")))
    return priced.withColumn(
        "total_amount", (F.col("_subtotal") + F.col("shipping_cost")).cast(TOTAL)
    ).drop("_subtotal")


def assign_customers(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """A uniform choice of customer per order: a drawn number joined to numbered customers."""
    numbered = number_rows(customers.select("customer_id"), "customer_id", "_number")
    total = customers.agg(F.count("*").alias("n")).scalar()
    drawn = orders.withColumn("_number", pick(F.col("id"), CUSTOMER, total) + 1)
    return drawn.join(numbered, "_number").drop("_number")


def new_customers(ids: DataFrame) -> DataFrame:
    """One customer per id, counted from 1."""
    i = F.col("id")

    def one_of(values, number: int) -> Column:
        return F.element_at(
            F.array(*map(F.lit, values)), (pick(i, number, len(values)) + 1).cast("int"))

    city = F.element_at(
        F.array(*[
            F.struct(F.lit(c).alias("city"), F.lit(s).alias("state"), F.lit(n).alias("country"))
            for c, s, n in CITIES
        ]),
        (pick(i, CITY, len(CITIES)) + 1).cast("int"),
    )
    named = ids.select(
        "id",
        F.format_string("CUST-%05d", i).alias("customer_code"),
        one_of(FIRST_NAMES, FIRST).alias("first_name"),
        one_of(LAST_NAMES, LAST).alias("last_name"),
        one_of(MAIL_DOMAINS, DOMAIN).alias("_domain"),
        city.alias("_city"),
        F.date_add(F.lit(FIRST_DAY), pick(i, JOINED, CUSTOMER_DAYS).cast("int"))
        .alias("created_on"),
    )
    email = F.concat(
        F.lower("last_name"), F.lit("-"), F.lower(F.substring("first_name", 1, 1)), i.cast("string"),
        F.lit("@"), F.col("_domain"),
    )
    return named.select(
        "id", "customer_code", "first_name", "last_name", email.alias("email"),
        F.lit("Standard").alias("segment"), "_city.city", "_city.state", "_city.country",
        "created_on",
    )


def flat_rows(orders: DataFrame, items: DataFrame) -> DataFrame:
    """The denormalized sales file: one row per item."""
    facts = orders.select(
        "order_id", "order_number", "order_date", "order_timestamp", "customer_id", "region_name",
        "payment_method", "order_status",
    )
    lines = items.select(
        "order_id", "category_name", "product_code", "product_name", "unit_price", "cost_price",
        "quantity", "discount_rate", "total_price",
    )
    rows = facts.join(lines, "order_id")
    return rows.select(
        F.col("order_number").alias("Order_ID"),
        F.col("order_date").alias("Order_Date"),
        F.date_format("order_timestamp", "yyyy-MM-dd HH:mm:ss").alias("Order_Timestamp"),
        F.format_string("CUST-%05d", F.col("customer_id")).alias("Customer_ID"),
        F.col("region_name").alias("Region"),
        F.col("category_name").alias("Category"),
        F.col("product_code").alias("Product_Code"),
        F.col("product_name").alias("Product_Name"),
        F.col("unit_price").cast("double").alias("Unit_Price"),
        F.col("cost_price").cast("double").alias("Cost_Price"),
        F.col("quantity").alias("Quantity"),
        F.col("discount_rate").cast("double").alias("Discount"),
        F.col("total_price").cast("double").alias("Total_Price"),
        F.col("payment_method").alias("Payment_Method"),
        F.col("order_status").alias("Order_Status"),
        F.lit("Yes").alias("Is_Synthetic"),
    )


def _candidate_count(total_records: int) -> int:
    # An accepted order has at least one item and two candidates in three are accepted, with about
    # one and a half items each; twice the target leaves a wide margin at any size.
    return 2 * total_records + 1_000


@dataclass(frozen=True)
class GeneratedSales:
    """The grown star, the rows that are new in it, and the flat sales rows."""

    star: Star
    new_items: DataFrame
    flat: DataFrame
    new_orders: DataFrame
    new_customers: DataFrame


def _typed(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in column_types(table)])


def generate(spark: SparkSession, star: Star, total_records: int = DEFAULT_RECORDS
             ) -> GeneratedSales:
    """Add generated orders to a star, with master records and customers where they are missing."""
    base = ensure_master(spark, star)
    customers, fresh = base.customers, base.customers.limit(0)
    if customers.limit(ENOUGH_CUSTOMERS).count() < ENOUGH_CUSTOMERS:
        made = next_ids(
            new_customers(spark.range(1, CUSTOMER_COUNT + 1)), "id", customers, "customer_id")
        fresh = made.join(customers.select("customer_code"), "customer_code", "left_anti")
        customers = _typed(customers, "customers").unionByName(_typed(fresh, "customers"))

    next_order = base.orders.agg(
        (F.coalesce(F.max("order_id"), F.lit(0)) + 1).cast("bigint").alias("n")).scalar()
    ids = spark.range(1, _candidate_count(total_records) + 1)
    # Drawn once: items, totals and the flat rows start from the stored orders.
    orders = stored(assign_customers(orders_until(ids, total_records, next_order), customers), "orders")
    items = explode_items(orders)
    orders = with_totals(orders, items)

    # Both lookups hold at most the master records: names and codes are unique.
    regions = base.regions.where(F.col("region_name").isin(*[r[0] for r in REGIONS])).groupBy(
        "region_name").agg(F.min("region_id").alias("region_id"))
    codes = base.products.where(F.col("product_code").isin(*[p[0] for p in products()])).groupBy(
        "product_code").agg(F.min("product_id").alias("product_id"))
    new_orders = orders.join(F.broadcast(regions), "region_name").withColumns({
        "discount_amount": F.lit(0), "is_synthetic": F.lit(True)})
    new_items = _typed(items.join(F.broadcast(codes), "product_code"), "order_items")
    new_orders = _typed(new_orders, "orders")
    all_orders = _typed(base.orders, "orders").unionByName(new_orders)
    grown = base.replace({
        "customers": refresh_segments(customers, all_orders),
        "orders": all_orders,
        "order_items": _typed(base.order_items, "order_items").unionByName(new_items),
    })
    return GeneratedSales(
        grown, new_items, flat_rows(orders, items), new_orders, _typed(fresh, "customers"))


def generation_log(flat: DataFrame, import_id: Column, created_at: dt.datetime) -> DataFrame:
    """The import log row of a generator run: everything valid, nothing filled in."""
    counted = flat.agg(F.count("*").alias("total_rows"))
    message = f"%,d synthetic sales rows, order dates from {FIRST_DAY} to {LAST_DAY}"
    return _typed(counted.withColumns({
        "import_id": import_id,
        "filename": F.lit(LOG_FILENAME),
        "file_type": F.lit(LOG_FILE_TYPE),
        "valid_records": F.col("total_rows"),
        "duplicate_rows": F.lit(0),
        "missing_values_handled": F.lit(0),
        "rejected_rows": F.lit(0),
        "quality_score": F.lit(100.0),
        "status": F.lit(LOG_STATUS),
        "audit_details": F.format_string(message, F.col("total_rows")),
        "created_at": F.lit(created_at.isoformat(sep=" ")).cast("timestamp_ntz"),
    }), "data_import_logs")


def seed_star(spark: SparkSession, root: str, version: int, total_records: int,
              created_at: dt.datetime) -> int:
    """Publish generated sales as star version ``version`` + 1 and return that number."""
    old, draft = read_star(spark, root, version), Draft(spark, root, version + 1)
    sales, extra = generate(spark, old, total_records), ensure_master(spark, old, missing_only=True)
    for table in ("regions", "categories", "products"):
        draft.write(table, extra.table(table))
    customers, orders = stored(sales.new_customers, "customers"), stored(sales.new_orders, "orders")
    draft.used_to("customer_id", largest_id(customers, "customer_id"))
    draft.used_to("order_id", largest_id(orders, "order_id"))
    draft.write_customers(customers)
    draft.write_orders(orders)
    draft.write("customer_spend", spend_of(orders))
    draft.write("order_items", with_month(sales.new_items, orders))
    if old.rollups:
        draft.write_rollups(sales.new_items, orders)
    log = old.table(LOGS)
    next_id = log.agg((F.coalesce(F.max("import_id"), F.lit(0)) + 1).alias("n")).scalar()
    draft.write(LOGS, generation_log(sales.new_items, next_id, created_at))
    draft.publish(old.keys_verified)
    return version + 1
