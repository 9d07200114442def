"""Sums per day that merge, kept beside the facts.

``sales_by_day`` has one row per day, region, payment method and status: cents, units, lines and orders with
at least one item. An order has one day, region, method and status, so its counts add up over rows and over
parts; a part counts an order only if no part before it brought the order an item. ``product_by_day`` has
the same keys and the product, without orders, which do not add up over products. ``customers_by_day`` holds
bitmaps of the customers behind a day's revenue, by blocks of ids: or-ed over days and counted they give
exact distinct customers of any period, which no sum of counts could.

Deleted customers take their orders along: their sums are added once more with the opposite sign. Bits cannot
be taken back, but as all orders of such a customer are gone, it is enough to leave them out when counting.

Each is at most as large as what it sums up, and is cut to months like the facts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlight.schema import REVENUE_STATUSES
from martlight.session import stored

KEYS = ("order_date", "region_id", "payment_method", "order_status")
#: Lines whose sums by product are made at a time. They shuffle as many rows as there are lines, four times; in slices
#: only those of one slice are on disk.
SLICE_LINES = 1 << 23
# Tables of sums: what a row stands for, and what is summed.
GRAIN = {
    "sales_by_day": (KEYS, ("revenue", "units", "lines", "orders")),
    "product_by_day": ((*KEYS, "product_id"), ("revenue", "units", "lines")),
}


def _summed(rows: DataFrame, name: str, *more_keys: str) -> DataFrame:
    keys, sums = GRAIN[name]
    return rows.groupBy(*keys, *more_keys).agg(*[F.sum(c).alias(c) for c in sums])


def counted(
    items: DataFrame, orders: DataFrame, seen: DataFrame | None = None, folder: str | None = None
) -> DataFrame:
    """Orders with the sums of their items, and 1 for those that had none before; with ``folder`` also the first and
    last folder that their items are in. ``orders`` holds the orders of all items, ``seen`` the order_id of those that
    had items before."""
    folders = [F.min(_folder(folder)).alias("first_folder"), F.max(_folder(folder)).alias("last_folder")] if folder else []
    per_order = items.groupBy("order_id").agg(
        F.sum("total_cents").alias("revenue"), F.sum("quantity").alias("units"), F.count("*").alias("lines"), *folders)
    rows = orders.select("order_id", "customer_id", *KEYS).join(per_order, "order_id")
    if seen is None:
        return rows.withColumn("orders", F.lit(1))
    before = seen.select("order_id").distinct().withColumn("_seen", F.lit(True))
    return rows.join(before, "order_id", "left").withColumn("orders", F.when(F.col("_seen"), 0).otherwise(1))


def _by_product(items: DataFrame, orders: DataFrame) -> DataFrame:
    # Summed per order and product first: the order's attributes meet sums, not lines.
    lines = items.groupBy("order_id", "product_id").agg(
        F.sum("total_cents").alias("revenue"), F.sum("quantity").alias("units"), F.count("*").alias("lines"))
    return _summed(orders.select("order_id", *KEYS).join(lines, "order_id"), "product_by_day")


def from_counts(counts: DataFrame) -> dict[str, DataFrame]:
    """The rows that the sums per order add to the tables without products."""
    buyers = counts.where(F.col("order_status").isin(*REVENUE_STATUSES)).where("customer_id is not null")
    return {"sales_by_day": _summed(counts, "sales_by_day"), "customers_by_day": customer_bits(buyers, "order_date")}


def additions(items: DataFrame, orders: DataFrame, seen: DataFrame | None = None) -> dict[str, DataFrame]:
    """The rows that these items add to each table. ``orders`` holds the orders of all items, ``seen`` the
    order_id of those that had items before."""
    # Written, so that two tables start from the sums per order and not from the items.
    counts = stored(counted(items, orders, seen), "counted")
    return from_counts(counts) | {"product_by_day": _by_product(items, orders)}


def _folder(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def product_slices(items: DataFrame, counts: DataFrame, folder: str | None) -> Iterator[DataFrame]:
    """The rows that items add to ``product_by_day``, in slices of whole folders with about SLICE_LINES items at most
    (a folder with more is one slice); without a folder in one.

    ``counts`` are the sums per order with their folders: a slice has all orders that items of it may belong to. The
    number of items in each folder, one per calendar month, comes to the driver.
    """
    sizes = items.groupBy(_folder(folder).alias("folder")).agg(F.count("*").alias("n")).collect() if folder else []
    total, before, slices = sum(row.n for row in sizes), 0, {}
    parts = -(-total // SLICE_LINES)
    for name, n in sorted(map(tuple, sizes)):
        slices.setdefault(before * parts // total, []).append(name)
        before += n
    if len(slices) < 2:
        yield _by_product(items, counts)
        return
    for names in slices.values():
        first, last = names[0], names[-1]
        orders = counts.where((F.col("first_folder") <= last) & (F.col("last_folder") >= first))
        yield _by_product(items.where(_folder(folder).between(first, last)), orders)


def withdrawals(items: DataFrame, orders: DataFrame) -> dict[str, DataFrame]:
    """The rows that take orders, with all the items they have, out of the sums."""
    added = {"sales_by_day": _summed(counted(items, orders), "sales_by_day"), "product_by_day": _by_product(items, orders)}
    return {
        name: added[name].withColumns({c: -F.col(c) for c in sums}) for name, (_, sums) in GRAIN.items()
    }


def merged(rows: DataFrame, name: str, *more_keys: str) -> DataFrame:
    """One row per key of a table of sums, without those whose lines are all gone."""
    return _summed(rows, name, *more_keys).where("lines > 0")


def merged_bits(rows: DataFrame) -> DataFrame:
    """One row per day and block of ``customers_by_day``."""
    return rows.groupBy("order_date", "block").agg(F.bitmap_or_agg("customers").alias("customers"))


def customer_bits(rows: DataFrame, *keys: str) -> DataFrame:
    """Bitmaps of the customers in ``rows``, by the given keys and blocks of ids.

    A bitmap has 4 KB however few customers it holds, and every task would send one for each key it sees. So
    customers travel, once each, to the task of their keys and block, and bitmaps are built only there.
    """
    ids = rows.select(*keys, "customer_id").distinct().withColumn("block", F.bitmap_bucket_number("customer_id"))
    return ids.repartition(*keys, "block").groupBy(*keys, "block").agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("customer_id")).alias("customers"))


def count_customers(rows: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """One row, ``total_customers``: distinct customers in rows of ``customers_by_day``, without those gone.

    There is no "and not" for bitmaps: the customers or those gone are counted, less those gone.
    """
    bits = rows.select("block", "customers", F.lit(None).cast("binary").alias("gone"))
    if gone is not None:
        blocks = customer_bits(gone)
        bits = bits.unionAll(blocks.select("block", "customers", F.col("customers").alias("gone")))
    counts = bits.groupBy("block").agg(
        (F.bitmap_count(F.bitmap_or_agg("customers")) - F.bitmap_count(F.bitmap_or_agg("gone"))).alias("n"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_customers"))
