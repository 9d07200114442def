"""The declared keys and rules of the star schema, checked as jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlight.schema import FOREIGN_KEYS, NOT_NULL_COLUMNS, UNIQUE_KEYS
from martlight.sources.star import Star


def _stack(frames: list[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionAll(frame)
    return result


def duplicate_keys(star: Star) -> DataFrame:
    """Per unique key: how many values occur more than once, and the rows beyond the first."""

    def check(table: str, key: str) -> DataFrame:
        repeated = star.table(table).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
        return repeated.agg(
            F.lit(table).alias("table_name"),
            F.lit(key).alias("key_column"),
            F.count("*").alias("repeated_values"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("extra_rows"),
        )

    return _stack([check(*key) for key in UNIQUE_KEYS])


def orphans(star: Star) -> DataFrame:
    """Per foreign key: rows without a parent. Rows and parents are counted together per key value, so a hot
    value is a single row per task when it is sent. (Catalyst would put an anti-join with the parents before the
    counting, and send every row.)"""

    def check(child: str, key: str, parent: str) -> DataFrame:
        rows = star.table(child).select(key, F.lit(1).alias("n"), F.lit(0).alias("parents"))
        parents = star.table(parent).where(F.col(key).isNotNull()).select(key, F.lit(0), F.lit(1))
        values = rows.unionAll(parents).groupBy(key).agg(F.sum("n").alias("n"), F.max("parents").alias("parents"))
        return values.where("parents = 0").agg(
            F.lit(child).alias("table_name"),
            F.lit(key).alias("key_column"),
            F.lit(parent).alias("parent_table"),
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("orphan_rows"),
        )

    return _stack([check(*key) for key in FOREIGN_KEYS])


def verify_keys(star: Star) -> Star:
    """Check every foreign key; only if no orphan exists, reports may skip existence joins."""
    lost = orphans(star).agg(F.sum("orphan_rows").alias("n")).first().n
    return star.replace(keys_verified=lost == 0)


def null_counts(star: Star) -> DataFrame:
    def check(table: str, columns: tuple[str, ...]) -> DataFrame:
        counts = star.table(table).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        entries = [
            F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"),
                     F.col(c).alias("null_rows"))
            for c in columns
        ]
        return counts.select(F.inline(F.array(*entries)))

    return _stack([check(*entry) for entry in NOT_NULL_COLUMNS.items()])


def rule_violations(star: Star) -> DataFrame:
    """Quantity above zero, discount between 0 and 1."""
    rules: dict[str, Column] = {
        "quantity > 0": F.col("quantity") <= 0,
        "discount_rate between 0 and 1": ~F.col("discount_rate").between(0, 1),
    }
    counts = star.order_items.agg(
        F.count("*").alias("rows_checked"),
        *[F.count_if(broken).alias(f"r{i}") for i, broken in enumerate(rules.values())],
    )
    entries = [
        F.struct(F.lit(name).alias("rule"), F.col("rows_checked").alias("rows_checked"),
                 F.col(f"r{i}").alias("violations"))
        for i, name in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*entries)))


def delete_customers(star: Star, doomed: DataFrame) -> Star:
    """The star without the given customers, their orders, and the items of those orders.

    ``doomed`` holds the customer_id values to delete. The parents decide: orders and items go with
    the row that owned them.
    """
    gone_orders = star.orders.join(doomed.select("customer_id"), "customer_id", "left_semi").select(
        "order_id"
    )
    return star.replace({
        "customers": star.customers.join(doomed, "customer_id", "left_anti"),
        "orders": star.orders.join(doomed, "customer_id", "left_anti"),
        "order_items": star.order_items.join(gone_orders, "order_id", "left_anti"),
    })
