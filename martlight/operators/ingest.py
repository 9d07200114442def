"""Import of cleaned rows into the star tables as set operations."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.functions.money import MONEY, PRICE, RATE, TOTAL
from martlight.functions.numbering import number_rows
from martlight.functions.tiers import spend_tier
from martlight.operators.cleaning import Cleaning
from martlight.operators.master import ensure_master
from martlight.schema import COMPLETED, MIDDLE_TIER_SPEND, TOP_TIER_SPEND, column_types
from martlight.session import stored
from martlight.sources import rollup
from martlight.sources.star import LOGS, MONTH, Draft, PublishedStar, month_of, read_star, spend_of
from martlight.sources.upload import ROW_INDEX

# Attributes of customers, categories and log rows created by an import.
IMPORTED_FIRST_NAME = "Imported"
IMPORTED_EMAIL_DOMAIN = "@imported-customer.com"
IMPORTED_COUNTRY = "United States"
IMPORTED_SEGMENT = "Standard"
IMPORTED_CATEGORY = "Imported category"
COST_SHARE = "0.65"
UPLOAD_FILE_TYPE = "Uploaded File"
COMMITTED = "Committed"


def next_ids(df: DataFrame, position: str, existing: DataFrame | int, id_column: str) -> DataFrame:
    """Give rows the ids after the largest existing one, in order of ``position``.

    ``existing`` holds the ids in use, or is the largest of them.
    """
    if isinstance(existing, int):
        largest = F.lit(existing).cast("bigint")
    else:
        largest = existing.agg(
            F.coalesce(F.max(id_column), F.lit(0)).cast("bigint").alias("largest")).scalar()
    numbered = number_rows(df, position, "_n").withColumn(id_column, F.col("_n") + largest).drop("_n")
    # Numbering reads its input twice: what is joined to it next should not repeat that.
    return stored(numbered, id_column)


def _shaped(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(c).cast(kind).alias(c) for c, kind in column_types(table)])


def _first_rows(cleaned: DataFrame, key: str, *attributes: str) -> DataFrame:
    """One row per key with the attributes of its first input row."""
    if not attributes:
        return cleaned.groupBy(key).agg(F.min(ROW_INDEX).alias("first_row"))
    first = F.min_by(F.struct(*attributes), ROW_INDEX).alias("first")
    return (
        cleaned.groupBy(key)
        .agg(first, F.min(ROW_INDEX).alias("first_row"))
        .select(key, "first_row", "first.*")
    )


def number_new(cleaned: DataFrame, key: str, existing: DataFrame, id_column: str,
               *attributes: str) -> DataFrame:
    """Keys the existing table lacks, numbered on from its largest id by first appearance.

    Ids are given before anything is joined: numbering reads its input twice.
    """
    unknown = _first_rows(cleaned, key, *attributes).join(existing.select(key), key, "left_anti")
    return next_ids(unknown, "first_row", existing, id_column)


def new_customers(cleaned: DataFrame, customers: DataFrame) -> DataFrame:
    return imported_customers(number_new(cleaned, "customer_code", customers, "customer_id"))


def imported_customers(numbered: DataFrame) -> DataFrame:
    """Whole customer rows from new codes and their ids."""
    code = F.col("customer_code")
    rows = numbered.withColumns({
        "first_name": F.lit(IMPORTED_FIRST_NAME),
        "last_name": F.concat(F.lit("User_"), F.right(code, F.lit(4))),
        "email": F.concat(F.lower(code), F.lit(IMPORTED_EMAIL_DOMAIN)),
        "segment": F.lit(IMPORTED_SEGMENT),
        "city": F.lit(None),
        "state": F.lit(None),
        "country": F.lit(IMPORTED_COUNTRY),
    })
    return _shaped(rows, "customers")


def new_categories(cleaned: DataFrame, categories: DataFrame) -> DataFrame:
    rows = number_new(cleaned, "category_name", categories, "category_id")
    return _shaped(rows.withColumn("description", F.lit(IMPORTED_CATEGORY)), "categories")


def _first_id(dimension: DataFrame, id_column: str) -> Column:
    """The fallback for lookups that find nothing: the row with the smallest id."""
    return dimension.agg(F.min(id_column).alias("first_id")).scalar()


def new_products(cleaned: DataFrame, products: DataFrame, categories: DataFrame) -> DataFrame:
    """Unknown product codes with name, price and category of their first row."""
    numbered = number_new(cleaned, "product_code", products, "product_id",
                          "product_name", "unit_price", "category_name")
    price = F.col("unit_price").cast(PRICE)
    rows = numbered.join(
        categories.select("category_name", "category_id"), "category_name", "left"
    ).withColumns({
        "category_id": F.coalesce("category_id", _first_id(categories, "category_id")),
        "cost_price": F.round(price * F.lit(COST_SHARE).cast("decimal(3,2)"), 2),
        "sku": F.col("product_code"),
        "is_active": F.lit(True),
    })
    return _shaped(rows, "products")


def roll_up_orders(cleaned: DataFrame) -> DataFrame:
    """One row per order number: attributes of its first row, sum of its line totals.

    Sums and first rows combine map-side, so one order number on a third of all rows (rows without
    a number share one) costs one row per split in the shuffle.
    """
    attributes = ("customer_code", "region_name", "order_date", "payment_method", "order_status")
    return (
        cleaned.groupBy("order_number")
        .agg(
            F.min_by(F.struct(*attributes), ROW_INDEX).alias("first"),
            F.min(ROW_INDEX).alias("first_row"),
            F.sum(F.col("total_price").cast(MONEY)).cast(TOTAL).alias("total_amount"),
            F.count("*").alias("line_count"),
        )
        .select("order_number", "first_row", "first.*", "total_amount", "line_count")
    )


def look_up_regions(rollup: DataFrame, regions: DataFrame) -> DataFrame:
    """Region id by name; unknown names fall to the first region and are marked."""
    found = rollup.join(regions.select("region_name", "region_id"), "region_name", "left")
    return found.withColumn("unknown_region", F.col("region_id").isNull()).withColumn(
        "region_id", F.coalesce("region_id", _first_id(regions, "region_id"))
    )


def number_new_orders(rollup: DataFrame, orders: DataFrame) -> DataFrame:
    """Rolled-up orders whose number is not known yet, with their new ids."""
    unknown = rollup.join(orders.select("order_number"), "order_number", "left_anti")
    return next_ids(unknown, "first_row", orders, "order_id")


def new_orders(rollup: DataFrame, orders: DataFrame, customers: DataFrame,
               regions: DataFrame) -> DataFrame:
    return imported_orders(number_new_orders(rollup, orders), customers, regions)


def imported_orders(numbered: DataFrame, customers: DataFrame, regions: DataFrame) -> DataFrame:
    """Whole order rows from rolled-up orders and their ids."""
    placed = look_up_regions(numbered, regions).join(
        customers.select("customer_code", "customer_id"), "customer_code", "left"
    )
    rows = placed.withColumns({
        "customer_id": F.coalesce("customer_id", _first_id(customers, "customer_id")),
        "order_timestamp": F.col("order_date").cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS"),
        "shipping_cost": F.lit(0),
        "discount_amount": F.lit(0),
        "is_synthetic": F.lit(False),
    })
    return _shaped(rows, "orders")


def new_items(cleaned: DataFrame, orders: DataFrame, products: DataFrame, *kept: str) -> DataFrame:
    """Every cleaned row becomes an item, also for orders that existed before. ``kept`` names columns
    of the order that its items carry."""
    rows = (
        cleaned.join(orders.select("order_number", "order_id", *kept), "order_number")
        .join(products.select("product_code", "product_id"), "product_code", "left")
        .withColumn("product_id", F.coalesce("product_id", _first_id(products, "product_id")))
    )
    return rows.select(
        "order_id", "product_id", F.col("quantity").cast("bigint").alias("quantity"),
        F.col("unit_price").cast(PRICE).alias("unit_price"),
        F.col("discount_rate").cast(RATE).alias("discount_rate"),
        F.col("total_price").cast(MONEY).alias("total_price"), *kept,
    )


def refresh_segments(customers: DataFrame, orders: DataFrame,
                     hi=TOP_TIER_SPEND, mid=MIDDLE_TIER_SPEND) -> DataFrame:
    """Tier of each customer from the totals of completed orders, shipping included."""
    spent = (
        orders.where(F.col("order_status") == COMPLETED)
        .groupBy("customer_id").agg(F.sum("total_amount").alias("_spent"))
    )
    tier = spend_tier(F.coalesce("_spent", F.lit(0)), hi=hi, mid=mid)
    return _shaped(
        customers.join(spent, "customer_id", "left").withColumn("segment", tier), "customers"
    )


def import_log_row(audit: DataFrame, actions: DataFrame, import_id: int | Column, filename: str,
                   created_at: dt.datetime, file_type: str = UPLOAD_FILE_TYPE,
                   status: str = COMMITTED) -> DataFrame:
    details = actions.select(F.to_json("actions").alias("audit_details"))
    rows = audit.withColumns({
        "import_id": import_id if isinstance(import_id, Column) else F.lit(import_id),
        "filename": F.lit(filename),
        "file_type": F.lit(file_type),
        "status": F.lit(status),
        "audit_details": details.scalar(),
        "created_at": F.lit(created_at.isoformat(sep=" ")).cast("timestamp_ntz"),
    })
    return _shaped(rows, "data_import_logs")


@dataclass(frozen=True)
class Commit:
    """What a commit wrote: the version to read, and its row counts."""

    version: int
    orders_inserted: int
    items_inserted: int


class StageUsed(RuntimeError):
    """The staged rows have been committed already."""


def commit(spark: SparkSession, root: str, version: int, staged: Cleaning, filename: str,
           created_at: dt.datetime) -> Commit:
    """Publish star version ``version`` + 1 from the current one and a staged, approved import.

    Only what the import brings is read and written: its keys are looked up in the folders they fall
    in, new totals and spend are added as rows of their own (see ``sources.star``), and ids come from
    the ranges the version before left free.

    Readers keep using ``version`` until the caller hands them the new number, so an import that dies
    at any step changes nothing and can be run again. Of two imports that start from one version the
    later one raises VersionConflict and can be run again on the new version. Which stages a version
    holds is part of the version, so a stage is used up exactly when its import is published. Each
    table is written before the next step reads it: later steps start from files, not from the whole
    lineage.
    """
    old = read_star(spark, root, version)
    if staged.folder and not old.rows("used_stages").where(F.col("stage") == staged.folder).isEmpty():
        raise StageUsed(f"{staged.folder} has been committed before")
    draft, cleaned = Draft(spark, root, version + 1), staged.cleaned()
    base, extra = ensure_master(spark, old), ensure_master(spark, old, missing_only=True)
    draft.write("regions", extra.regions)
    draft.write("categories", extra.categories.unionByName(new_categories(cleaned, base.categories)))
    draft.write("products", extra.products.unionByName(
        new_products(cleaned, base.products, draft.table("categories"))))

    codes = stored(old.look_up("customer_keys", _first_rows(cleaned, "customer_code")), "codes")
    made = _numbered(draft, codes.where("customer_id is null").drop("customer_id"), "customer_id")
    draft.write_customers(imported_customers(made))
    buyers = codes.where("customer_id is not null").unionByName(made).select("customer_code", "customer_id")

    rollup = stored(roll_up_orders(cleaned), "rollup")
    numbers = stored(old.look_up("order_keys", rollup), "numbers")
    known = numbers.where("order_id is not null")
    made = _numbered(draft, numbers.where("order_id is null").drop("order_id", MONTH), "order_id")
    orders = stored(imported_orders(made, buyers, draft.table("regions")), "orders")
    draft.write_orders(orders)
    draft.write("order_totals", known)
    draft.write("customer_spend", spend_of(orders).unionByName(_changed_spend(old, known)))
    months = orders.select("order_number", "order_id", month_of(F.col("order_date")).alias(MONTH))
    placed = known.select("order_number", "order_id", MONTH).unionByName(months)
    draft.write("order_items", new_items(cleaned, placed, draft.table("products"), MONTH))
    if old.rollups:
        _roll_up(draft, draft.written("order_items"), orders, old, known)

    log = old.table(LOGS)
    next_id = log.agg((F.coalesce(F.max("import_id"), F.lit(0)) + 1).alias("next_id")).scalar()
    draft.write(LOGS, import_log_row(staged.audit(), staged.actions(), next_id, filename, created_at))
    if staged.folder:
        draft.write("used_stages", spark.range(1).select(F.lit(staged.folder).alias("stage")))
    # Every imported row got an existing parent, so the keys are as sound as they were.
    draft.publish(old.keys_verified)
    return Commit(version + 1, orders.count(), cleaned.count())


def remove_customers(spark: SparkSession, root: str, version: int, doomed: DataFrame) -> Commit:
    """Publish star version ``version`` + 1 without the given customers, their orders and the items of these.

    ``doomed`` holds customer_id values; unknown and repeated ones, and nulls, do nothing. No table is
    rewritten: the version adds the ids that are gone (see ``sources.star``). Orders are read for their
    customers, items in the months of the orders that go. A deleted order number or customer code that is
    imported later is a new one, with an id of its own.
    """
    old, draft = read_star(spark, root, version), Draft(spark, root, version + 1)
    gone = stored(old.customers.select("customer_id").join(
        doomed.select("customer_id"), "customer_id", "left_semi"), "gone")
    orders = stored(old.orders.join(gone, "customer_id", "left_semi").select(
        "order_id", "customer_id", MONTH, *rollup.KEYS), "gone-orders")
    draft.write("deleted_customers", gone)
    draft.write("deleted_orders", orders)
    if old.rollups:
        draft.take_back(_old_orders(old, orders, "order_items"), orders)
    draft.publish(old.keys_verified, old.marker["tiers"])
    return Commit(version + 1, 0, 0)


def _numbered(draft: Draft, rows: DataFrame, id_column: str) -> DataFrame:
    """Rows with ids of a range that this version reserves."""
    return next_ids(rows, "first_row", draft.free_ids(id_column, rows.count()), id_column)


def _old_orders(old: PublishedStar, known: DataFrame, table: str) -> DataFrame:
    """Rows of known orders in a table of the star before.

    Only the months of these orders are read: their numbers, one per calendar month at most, come to
    the driver first.
    """
    months = [r[0] for r in known.select(MONTH).distinct().collect()]
    rows = old.table(table).where(F.col(MONTH).isin(*months) if months else F.lit(False))
    return rows.join(known.select("order_id", MONTH), ["order_id", MONTH], "left_semi")


def _roll_up(draft: Draft, items: DataFrame, orders: DataFrame, old: PublishedStar, known: DataFrame) -> None:
    """Add imported items to the sums per day."""
    again = _old_orders(old, known, "orders")
    seen = _old_orders(old, known, "order_items").select("order_id")
    columns = ["order_id", "customer_id", *rollup.KEYS]
    draft.write_rollups(items, orders.select(*columns).unionByName(again.select(*columns)), seen)


def _changed_spend(old: PublishedStar, known: DataFrame) -> DataFrame:
    """What new totals of known orders change in their customers' spend."""
    totals = known.select("order_id", MONTH, F.col("total_amount").alias("_imported"))
    changed = _old_orders(old, known, "orders").join(totals, ["order_id", MONTH]).withColumn(
        "total_amount", F.col("_imported") - F.col("total_amount"))
    return spend_of(changed)
