"""The star schema seen through the generic order tables of the test data."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.functions.money import PRICE, RATE, TOTAL, from_cents
from martlight.sources.star import Star

# Declared here, a table needs no job to look into its files first.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def bind_star(spark: SparkSession, folder: str) -> Star:
    @cache
    def read(name: str) -> DataFrame:
        return read_table(spark, folder, name)

    builders = {
        "regions": lambda: _regions(read),
        "categories": lambda: _categories(read),
        "customers": lambda: _customers(read),
        "products": lambda: _products(read),
        "orders": lambda: _orders(read),
        "order_items": lambda: _order_items(read),
    }
    return Star(lambda name: builders[name]())


def _regions(read) -> DataFrame:
    countries = (
        read("nation").groupBy(F.col("n_regionkey").alias("region_id"))
        .agg(F.min("n_name").alias("country"))
    )
    return (
        read("region")
        .select(
            F.col("r_regionkey").alias("region_id"),
            F.col("r_name").alias("region_name"),
            F.substring("r_name", 1, 2).alias("code"),
        )
        .join(countries, "region_id")
    )


def _numbered_categories(read) -> DataFrame:
    """A category's id is the smallest product key in it: unique, and no numbering of names."""
    named = read("part").where(F.col("p_type").isNotNull())
    return named.groupBy(F.col("p_type").alias("category_name")).agg(
        F.min("p_partkey").cast("int").alias("category_id"))


def _categories(read) -> DataFrame:
    return _numbered_categories(read).select(
        "category_id", "category_name", F.lit(None).cast("string").alias("description"))


def _customers(read) -> DataFrame:
    nations = read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    name = F.col("c_name")
    return (
        read("customer")
        .join(nations, "c_nationkey")
        .select(
            F.col("c_custkey").alias("customer_id"),
            name.alias("customer_code"),
            F.split_part(name, F.lit("#"), F.lit(1)).alias("first_name"),
            F.split_part(name, F.lit("#"), F.lit(2)).alias("last_name"),
            F.concat(F.lower(name), F.lit("@example.com")).alias("email"),
            F.lit("Standard").alias("segment"),
            F.col("n_name").alias("city"),
            F.lit(None).cast("string").alias("state"),
            F.col("n_name").alias("country"),
        )
    )


def product_code(key: Column) -> Column:
    return F.concat(F.lit("PROD-"), F.lpad(key.cast("string"), 7, "0"))


def order_number(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(key.cast("string"), 9, "0"))


def _products(read) -> DataFrame:
    price = F.col("p_retailprice").cast(PRICE)
    categories = _numbered_categories(read).withColumnRenamed("category_name", "p_type")
    return read("part").join(categories, "p_type", "left").select(
        F.col("p_partkey").alias("product_id"),
        product_code(F.col("p_partkey")).alias("product_code"),
        F.col("p_name").alias("product_name"),
        "category_id",
        price.alias("unit_price"),
        F.round(price * F.lit("0.65").cast("decimal(3,2)"), 2).cast(PRICE).alias("cost_price"),
        F.col("p_brand").alias("sku"),
        F.lit(True).alias("is_active"),
    )


def _orders(read) -> DataFrame:
    # Grouping by the customer key makes the right side unique, so Catalyst drops this left join
    # from every plan that does not use region_id.
    nations = read("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    home_region = (
        read("customer").select(F.col("c_custkey").alias("customer_id"), "c_nationkey")
        .join(nations, "c_nationkey")
        .groupBy("customer_id").agg(F.min("n_regionkey").alias("region_id"))
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", "Completed")
        .when(F.col("o_orderstatus") == "O", "Shipped")
        .when(F.col("o_orderstatus") == "P", "Processing")
    )
    day = F.col("o_orderdate").cast("date")
    return (
        read("orders")
        .select(
            F.col("o_orderkey").alias("order_id"),
            order_number("ORD-", F.col("o_orderkey")).alias("order_number"),
            F.col("o_custkey").alias("customer_id"),
            day.alias("order_date"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("order_timestamp"),
            F.col("o_orderpriority").alias("payment_method"),
            status.alias("order_status"),
            F.lit(0).cast(PRICE).alias("shipping_cost"),
            F.lit(0).cast(PRICE).alias("discount_amount"),
            F.col("o_totalprice").cast(TOTAL).alias("total_amount"),
            F.lit(True).alias("is_synthetic"),
        )
        .join(home_region, "customer_id", "left")
    )


def _order_items(read) -> DataFrame:
    # Integer arithmetic throughout: cents, ten-thousandths of discount, halves rounded up.
    quantity = F.col("l_quantity").cast("bigint")
    amount = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    discount = F.rint(F.col("l_discount") * 10000).cast("bigint")
    half = F.when(amount < 0, -5000).otherwise(5000)
    total_cents = F.call_function("div", amount * (F.lit(10000) - discount) + half, F.lit(10000))
    unit_cents = F.call_function("div", amount * 2 + quantity, quantity * 2)
    return read("lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        quantity.alias("quantity"),
        from_cents(unit_cents, PRICE).alias("unit_price"),
        F.col("l_discount").cast(RATE).alias("discount_rate"),
        from_cents(total_cents).alias("total_price"),
        unit_cents.alias("unit_cents"),
        total_cents.alias("total_cents"),
    )
