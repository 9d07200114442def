"""The fact join every report starts from, at line grain and at order grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlight.operators.filters import EVERYTHING, Period, SalesFilter, in_months
from martlight.sources import rollup
from martlight.sources.star import MONTH, Star


def order_keys(star: Star) -> list[str]:
    """What orders and items are joined by. A published star's items carry the month of their order:
    with it in the key, months that a filter on orders leaves out are pruned from the items too."""
    return ["order_id", MONTH] if MONTH in star.order_items.columns else ["order_id"]


def _in_periods(rows: DataFrame, *periods: Period) -> DataFrame:
    return rows.where(in_months(F.col(MONTH), *periods)) if MONTH in rows.columns else rows


def matched_items(star: Star, flt: SalesFilter, *product_columns: str,
                  periods: tuple[Period, ...] | None = None) -> DataFrame:
    """Order items whose product exists and passes the filter, with the wanted product columns.

    Items that carry a month are cut to the months of the filter's dates (or of ``periods``), which
    prunes whole folders. No broadcast is forced: Catalyst broadcasts a product table under its size
    limit and shuffles a larger one, where AQE splits a hot product.
    """
    items = _in_periods(star.order_items, *(periods or (flt.period(),)))
    wanted = [c for c in product_columns if c != "product_id"]
    if wanted or flt.category_id is not None:
        products = star.products.where(flt.product_condition()).select("product_id", *wanted)
        return items.join(products, "product_id")
    if star.keys_verified:
        return items
    return items.join(star.products.select("product_id"), "product_id", "left_semi")


def matched_orders(star: Star, flt: SalesFilter, *columns: str, when: Column | None = None,
                   periods: tuple[Period, ...] | None = None) -> DataFrame:
    orders = star.orders.where(flt.order_condition() if when is None else when)
    keys = order_keys(star)
    wanted = [c for c in columns if c not in keys]
    return _in_periods(orders, *(periods or (flt.period(),))).select(*keys, *wanted)


def sales_base(
    star: Star,
    flt: SalesFilter = EVERYTHING,
    order_columns: tuple[str, ...] = ("customer_id", "region_id", "order_date",
                                      "payment_method", "order_status"),
    product_columns: tuple[str, ...] = (),
) -> DataFrame:
    """One row per order item that survives the filter."""
    return matched_orders(star, flt, *order_columns).join(
        matched_items(star, flt, *product_columns), order_keys(star)
    )


def sum_by_order(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.sum("total_cents").alias("revenue"),
        F.sum("quantity").alias("units"),
        F.count("*").alias("lines"),
    )


def order_grain(star: Star, flt: SalesFilter, *order_columns: str,
                when: Column | None = None, periods: tuple[Period, ...] | None = None) -> DataFrame:
    """One row per order with at least one matching item: revenue (in cents), units and lines.

    Items are summed before they meet the orders. The partial sums run map-side, so an order
    holding a large part of all items shrinks to one row per input split, and the join reuses the
    order_id partitioning of the sums. Order counts above this grain are plain counts, not distinct.
    ``when`` replaces the filter's condition on orders; ``periods`` then are the dates it can match.
    """
    keys = order_keys(star)
    return matched_orders(star, flt, *order_columns, when=when, periods=periods).join(
        sum_by_order(matched_items(star, flt, periods=periods), keys), keys
    )


def rolled_up(star: Star, flt: SalesFilter, *columns: str) -> bool:
    """Whether the sums per day answer for this filter and these columns: the star keeps them, every item
    counts (no orphans), and categories are not asked for, as sums per day do not know them."""
    return (star.rollups and star.keys_verified and flt.category_id is None
            and set(columns) <= set(rollup.KEYS))


def rolled_rows(star: Star, flt: SalesFilter, table: str, when: Column | None = None,
                periods: tuple[Period, ...] | None = None) -> DataFrame:
    rows = star.table(table).where(flt.order_condition() if when is None else when)
    return _in_periods(rows, *(periods or (flt.period(),)))


def order_sums(star: Star, flt: SalesFilter, *order_columns: str, when: Column | None = None,
               periods: tuple[Period, ...] | None = None) -> DataFrame:
    """The wanted columns of orders with revenue (in cents), units, lines and ``orders``: rows per day if
    the star keeps them, else rows per order. Their sums over any of the columns are the same."""
    if rolled_up(star, flt, *order_columns):
        rows = rolled_rows(star, flt, "sales_by_day", when, periods)
        return rows.select(*order_columns, "revenue", "units", "lines", "orders")
    return order_grain(star, flt, *order_columns, when=when, periods=periods).withColumn("orders", F.lit(1))
