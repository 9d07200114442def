"""Plans and hot keys: what keeps the jobs workable on very large inputs."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from martlight.plans import all_queries as queries
from martlight.functions.draws import SCRAMBLE_MODULUS, draw
from martlight.functions.numbering import number_rows, running_total
from martlight.operators import metrics, ranking
from martlight.operators.base import order_grain, sales_base
from martlight.operators.cleaning import clean, drop_duplicates
from martlight.operators.export import export_lines
from martlight.operators.filters import EVERYTHING, SalesFilter
from martlight.operators.generate import candidates, explode_items, orders_until
from martlight.operators.ingest import roll_up_orders
from martlight.session import scratch_path, tune
from martlight.sources.bound import bind_star
from martlight.sources.star import read_star, write_star
from tests.shop import make_star
from tests.test_cleaning import AS_OF, raw

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    """Tables too large to broadcast."""
    tune(spark)
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    for key, value in changed.items():
        spark.conf.set(key, value)
    yield
    for key in changed:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_cross_join(spark, name):
    text = plan(queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "PythonUDF" not in text and "EvalPython" not in text


def hot_star(spark):
    """One order, one product and one customer hold a third of all rows."""
    star = make_star(spark)
    n = 60_000
    hot = F.col("id") % 3 == 0
    items = spark.range(n).select(
        F.when(hot, 7).otherwise(F.col("id")).alias("order_id"),
        F.when(hot, 2).otherwise(F.col("id") % 3 + 1).alias("product_id"),
        F.lit(1).alias("quantity"),
        F.lit(20).cast("decimal(10,2)").alias("unit_price"),
        F.lit(0).cast("decimal(5,4)").alias("discount_rate"),
        F.lit(20).cast("decimal(12,2)").alias("total_price"),
    )
    orders = spark.range(n).select(
        F.col("id").alias("order_id"),
        F.concat(F.lit("N"), F.col("id")).alias("order_number"),
        F.when(hot, 1).otherwise(F.col("id") % 3 + 1).alias("customer_id"),
        F.lit(1).alias("region_id"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 300).cast("int")).alias("order_date"),
        F.lit("Cash").alias("payment_method"),
        F.lit("Completed").alias("order_status"),
        F.lit(20).cast("decimal(12,2)").alias("total_amount"),
    )
    return star.replace({"orders": orders, "order_items": items}), n


def test_hot_order_shrinks_before_the_shuffle(spark, no_broadcast):
    star, n = hot_star(spark)
    text = plan(order_grain(star, EVERYTHING, "order_date"))
    # Partial sums sit below the exchange, and the join adds none on that side.
    assert re.search(r"Exchange hashpartitioning\(order_id[^\n]*\n[^\n]*HashAggregate\(keys=\[order_id",
                     text)
    row = metrics.kpi_primary(star).first()
    assert (row.total_revenue, row.units_sold, row.total_customers) == (20.0 * n, n, 2)
    # Two thirds of the rows have their own order; order 7 is one of them and also the hot one.
    assert row.total_orders == n * 2 // 3


def test_hot_order_is_split_in_the_line_join(spark, no_broadcast):
    star, n = hot_star(spark)
    result = metrics.category_performance(star)
    rows = {r.category_name: r for r in result.collect()}
    assert rows["Tools"].units_sold + rows["Toys"].units_sold == n
    final = result._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in final


def test_hot_duplicate_key_keeps_one_row_per_split(spark):
    rows = spark.range(50_000).select(
        F.col("id").alias("row_idx"),
        F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("order_number"),
        F.lit("x").alias("product_code"),
    )
    kept = drop_duplicates(rows)
    text = plan(kept)
    partial = text.index("row_number(), 1, Partial")
    assert text.index("Exchange hashpartitioning") < partial
    # 33,333 numbered rows and the first of the 16,667 without a number.
    assert kept.count() == 33_334
    assert kept.where("order_number is null").first().row_idx == 0


def test_hot_category_sends_only_leaders(spark):
    text = plan(ranking.top_products_per_category(bind_star(spark, FOLDER)))
    assert re.search(r"rank\(revenue[^\n]*\), 3, Partial", text)


def test_hot_order_number_rolls_up_map_side(spark):
    rows = raw(spark, ["order", "sku", "total"],
               [(None, f"p{i}", "2") for i in range(400)] + [("b", "p1", "3")])
    rolled = roll_up_orders(clean(rows, AS_OF).cleaned())
    assert "partial_sum" in plan(rolled) and "partial_min_by" in plan(rolled)
    assert {r.order_number: (r.line_count, float(r.total_amount)) for r in rolled.collect()} == {
        "nan": (400, 800.0), "b": (1, 3.0)}


def test_columns_and_filters_reach_the_scan(spark):
    root = scratch_path(spark, "star")
    write_star(spark, make_star(spark), root)
    star = read_star(spark, root, 0)
    days = SalesFilter(start_date=dt.date(2024, 1, 1), order_status="Completed")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    text = plan(metrics.monthly_sales_trend(star, days))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(order_date,2024-01-01)" in text
    assert "EqualTo(order_status,Completed)" in text
    assert re.search(r"ReadSchema: struct<order_id:bigint,order_date:date,order_status:string>", text)
    assert re.search(
        r"ReadSchema: struct<order_id:bigint,product_id:bigint,quantity:bigint,total_price:decimal",
        text)
    assert re.search(r"PartitionFilters: \[[^\]]*version", text)


def test_verified_keys_leave_out_existence_joins(spark):
    star = bind_star(spark, FOLDER)
    trusted = star.replace(keys_verified=True)
    assert "part.parquet" in plan(metrics.kpi_primary(star))
    assert "part.parquet" not in plan(metrics.kpi_primary(trusted))
    for report in (metrics.kpi_primary, metrics.region_performance, metrics.kpi_best_product,
                   ranking.top_products, ranking.top_customers, ranking.customer_value,
                   ranking.orders_table):
        assert report(star).collect() == report(trusted).collect()


def test_region_lookup_is_dropped_when_unused(spark):
    star = bind_star(spark, FOLDER)
    assert "customer.parquet" not in plan(metrics.monthly_sales_trend(star))
    assert "customer.parquet" in plan(metrics.region_performance(star))


@pytest.mark.parametrize("limit", [1, 7, 1000, 3990, 10**6])
def test_export_cut_is_exact(spark, limit):
    star = bind_star(spark, FOLDER)
    whole = export_lines(star, max_rows=10**6).collect()
    order = [(r["Order Date"], r["Order ID"]) for r in whole]
    assert order == sorted(order, reverse=True)
    assert export_lines(star, max_rows=limit).collect() == whole[:limit]


@pytest.mark.parametrize("width", [1, 3, 64, 1 << 20])
def test_numbering(spark, width):
    rows = spark.range(500).where("id % 7 != 2").repartition(5)
    got = number_rows(rows, "id", "n", width).orderBy("id").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))
    sums = running_total(rows, "id", F.col("id") * 2, "s", width).orderBy("id").collect()
    reached = 0
    for r in sums:
        reached += r.id * 2
        assert r.s == reached


def test_numbering_beyond_int_range(spark):
    rows = spark.range(3).select((F.col("id") * 10**13 + 10**17).alias("id"))
    assert [r.n for r in number_rows(rows, "id", "n").orderBy("id").collect()] == [1, 2, 3]


def test_generated_rows_do_not_depend_on_partitions(spark):
    def rows(parts):
        orders = orders_until(spark.range(1, 2000, numPartitions=parts), 900)
        return sorted(map(str, explode_items(orders).collect()))

    assert rows(1) == rows(13)


def test_draws_look_uniform_and_independent(spark):
    n = 200_000
    ids = spark.range(n)
    a, b = (draw(F.col("id"), k) / SCRAMBLE_MODULUS for k in (5, 6))
    row = ids.select(a.alias("a"), b.alias("b")).agg(
        F.avg("a").alias("mean"), F.corr("a", "b").alias("corr"),
        F.count_if((F.col("a") < 0.1) & (F.col("b") < 0.1)).alias("corner"),
    ).first()
    assert abs(row.mean - 0.5) < 0.005 and abs(row["corr"]) < 0.01
    assert abs(row.corner / n - 0.01) < 0.001


def test_season_shapes_the_year(spark):
    days = candidates(spark.range(200_000)).where("accepted")
    share = {r.m: r["count"] for r in days.where("year(order_date) = 2024").groupBy(
        F.month("order_date").alias("m")).count().collect()}
    assert abs(share[12] / share[1] - 1.7 / 0.85) < 0.25
    assert abs(share[10] / share[3] - 1.18) < 0.12


def test_every_item_counts_in_the_base(spark):
    star = bind_star(spark, FOLDER)
    assert sales_base(star).count() == metrics.order_grain(star, EVERYTHING).agg(
        F.sum("lines")).first()[0]
