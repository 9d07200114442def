"""Published stars: parts, months, indexes, merging at read, compaction, crashes."""

import datetime as dt
import glob
import json
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from martlight.operators import export, metrics, ranking
from martlight.operators.cleaning import load_staged, stage
from martlight.operators.filters import EVERYTHING, SalesFilter
from martlight.operators.ingest import StageUsed, commit, refresh_segments, remove_customers
from martlight.operators.quality import duplicate_keys, orphans, verify_keys
from martlight.session import create_once, read_small, scratch_path
from martlight.sources import star as stars
from martlight.sources.bound import bind_star
from martlight.sources.star import Draft, compact, read_star, write_star
from tests.shop import make_star
from tests.test_cleaning import AS_OF, raw

FOLDER = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 6, 1, 8)
HEADERS = ["order", "date", "customer id", "region", "category", "sku", "price", "qty", "total"]


@pytest.fixture(scope="module")
def published(spark):
    """The bound test star, published; tests add versions of their own folders only by reading."""
    root = scratch_path(spark, "star")
    write_star(spark, verify_keys(bind_star(spark, FOLDER)), root)
    return root


def staged(spark, rows, headers=HEADERS):
    folder = scratch_path(spark, "stage")
    stage(raw(spark, headers, rows), folder, AS_OF)
    return load_staged(spark, folder)


def files(root, name, version):
    return [f for f in glob.glob(f"{root}/{name}/version={version}/**/*.parquet", recursive=True)]


def files_read(spark, df):
    """Files that the scans of a query read, by table."""
    df.collect()
    store = spark._jsparkSession.sharedState().statusStore()
    executions = store.executionsList()
    last = executions.apply(executions.size() - 1).executionId()
    values = store.executionMetrics(last)
    nodes, found = store.planGraph(last).allNodes(), {}
    for k in range(nodes.size()):
        node = nodes.apply(k)
        metrics_of = node.metrics()
        for m in range(metrics_of.size()):
            metric = metrics_of.apply(m)
            value = values.get(metric.accumulatorId())
            if metric.name() == "number of files read" and value.isDefined():
                marks = {"total_price#": "order_items", "order_status#": "orders"}
                table = next((t for mark, t in marks.items() if mark in node.desc()), "other")
                found[table] = found.get(table, 0) + int(value.get().replace(",", ""))
    return found


def test_reports_equal_those_of_the_bound_star(spark, published):
    star, bound = read_star(spark, published, 0), bind_star(spark, FOLDER)
    month = SalesFilter(start_date=dt.date(1996, 3, 1), end_date=dt.date(1996, 5, 15))
    for flt in (EVERYTHING, month, SalesFilter(region_id=2, order_status="Completed")):
        for report in (metrics.monthly_sales_trend, metrics.category_performance, metrics.region_performance,
                       ranking.top_products, ranking.orders_table, export.export_lines):
            assert report(star, flt).collect() == report(bound, flt).collect()
        assert metrics.kpis(star, flt, AS_OF).collect() == metrics.kpis(bound, flt, AS_OF).collect()
    assert metrics.customer_segments(star).collect() == metrics.customer_segments(bound).collect()


def test_one_month_reads_one_month(spark, published):
    star = read_star(spark, published, 0)
    one = SalesFilter(start_date=dt.date(1996, 3, 1), end_date=dt.date(1996, 3, 31))
    held = len([f for f in files(published, "order_items", 0) if "order_month=199603" in f])
    every = len(files(published, "order_items", 0))
    assert every > 20 * held
    assert files_read(spark, metrics.monthly_sales_trend(star, one)) == {"order_items": held, "orders": held}
    # The key figures read the month and the period it is compared with.
    found = files_read(spark, metrics.kpi_prior_revenue(star, one, AS_OF))
    assert found["order_items"] <= 3 * held


def test_filters_on_orders_prune_items(spark, published):
    """No dates in the filter: the months of the orders that are left prune the items at run time."""
    star = read_star(spark, published, 0)
    some = star.orders.where("order_number < 'ORD-000000040'")
    few = star.replace({"orders": F.broadcast(some)})
    df = metrics.monthly_sales_trend(few)
    assert "dynamicpruning" in df._jdf.queryExecution().executedPlan().toString()
    months = some.where("order_status in ('Completed', 'Shipped')").select("order_month").distinct().count()
    every = len(files(published, "order_items", 0))
    assert months < every / 2
    assert files_read(spark, df)["order_items"] < every


def test_days_inside_a_month_are_sorted(spark, published):
    import pyarrow.parquet as pq

    for file in files(published, "orders", 0)[:20]:
        days = pq.read_table(file, columns=["order_date"])["order_date"].to_pylist()
        assert days == sorted(days)


def test_small_upload_writes_and_reads_its_own_folders(spark):
    root = scratch_path(spark, "star")
    write_star(spark, bind_star(spark, FOLDER), root)
    size = {n: sum(map(os.path.getsize, files(root, n, 0))) for n in ("orders", "customers", "order_keys", "order_items")}
    old = read_star(spark, root, 0).orders.where("order_status = 'Completed'").orderBy("order_id").first()
    upload = staged(spark, [(old.order_number, "2024-05-01", "Customer#000000001", "South", "Tools", "P1", "10", "1", "10")])
    done = commit(spark, root, 0, upload, "one.csv", NOW)
    assert (done.orders_inserted, done.items_inserted) == (0, 1)
    assert files(root, "orders", 1) == [] and files(root, "order_keys", 1) == []
    month = old.order_date.year * 100 + old.order_date.month
    for name in ("order_items", "order_totals"):
        (only,) = files(root, name, 1)
        assert f"order_month={month}" in only
    written = sum(os.path.getsize(f) for n in size for f in files(root, n, 1))
    assert written < size["orders"] / 10

    star = read_star(spark, root, 1)
    row = star.orders.where(F.col("order_id") == old.order_id).first()
    assert row.total_amount == Decimal("10.00")
    assert row.asDict() | {"total_amount": 0} == old.asDict() | {"total_amount": 0}
    # The index is read in the folder of that number alone.
    wanted = spark.createDataFrame([(old.order_number,)], "order_number string")
    looked = star.look_up("order_keys", wanted)
    assert looked.first().order_id == old.order_id
    plan = looked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan
    # A report that needs no total does not read the new totals.
    text = metrics.monthly_sales_trend(star)._jdf.queryExecution().executedPlan().toString()
    assert "order_totals" not in text and "customer_spend" not in text


def full_tiers(star):
    plain = refresh_segments(star.customers.drop("segment").withColumn("segment", F.lit("")), star.orders)
    return sorted((r.customer_id, r.segment) for r in plain.collect())


def uploads(spark):
    yield staged(spark, [("N2", "2024-05-01", "C1", "South", "Tools", "P1", "10", "1", "7000"),
                         ("A1", "2024-05-02", "C3", "South", "Tools", "P1", "10", "1", "5000")])
    yield staged(spark, [("A1", "2024-05-02", "C3", "South", "Tools", "P2", "10", "1", "10"),
                         ("A2", "2023-12-31", "ZED", "North", "Pets", "P8", "10", "1", "1600")])
    yield staged(spark, [("N1", "2020-01-01", "C2", "South", "Tools", "P1", "10", "2", "20"),
                         ("A2", "2023-12-31", "ZED", "North", "Pets", "P8", "10", "1", "1")])
    yield staged(spark, [("A3", "2024-02-29", "ZED", "North", "Pets", "P7", "10", "1", "9000")])


def contents(star):
    tables = {}
    for name in ("regions", "categories", "customers", "products", "orders", "order_items"):
        columns = [c for c, _ in stars.column_types(name)]
        tables[name] = sorted(map(str, star.table(name).select(*columns).collect()))
    return tables


def test_merged_totals_and_tiers_equal_a_full_recount(spark, monkeypatch):
    monkeypatch.setattr(stars, "MAX_PARTS", 3)
    root = scratch_path(spark, "star")
    write_star(spark, make_star(spark), root)
    sizes = []
    for version, upload in enumerate(uploads(spark)):
        before = contents(read_star(spark, root, version))
        commit(spark, root, version, upload, f"{version}.csv", NOW)
        star = read_star(spark, root, version + 1)
        assert sorted((r.customer_id, r.segment) for r in star.customers.collect()) == full_tiers(star)
        assert duplicate_keys(star).where("extra_rows > 0").count() == 0
        assert orphans(star).where("orphan_rows > 0").count() == 0
        assert len(star.marker["parts"]) <= 4
        sizes.append(len(json.dumps(star.marker)))
        # Versions before stay as they were.
        assert contents(read_star(spark, root, version)) == before
        with pytest.raises(StageUsed):
            commit(spark, root, version + 1, upload, "again.csv", NOW)
    totals = {r.order_number: r.total_amount for r in star.orders.collect()}
    assert totals == {"N1": 20, "N2": 7000, "N3": 1500, "N4": 99, "N5": 40, "A1": 10, "A2": 1, "A3": 9000}
    assert star.table("data_import_logs").count() == 4
    assert max(sizes) < 2 * sizes[0]

    last = compact(spark, root, 4)
    folded = read_star(spark, root, last)
    assert len(folded.marker["parts"]) == 1 and contents(folded) == contents(star)
    assert folded.table("data_import_logs").count() == 4
    with pytest.raises(StageUsed):
        commit(spark, root, last, upload, "again.csv", NOW)
    assert commit(spark, root, last, staged(spark, [("A4", "2024-01-01", "C1", "North", "Tools", "P1", "1", "1", "1")]), "a4.csv", NOW).version == 6
    assert read_star(spark, root, 6).orders.where("order_number = 'A4'").first().order_id == 9


def test_crash_at_any_step_changes_nothing(spark, monkeypatch):
    root = scratch_path(spark, "star")
    write_star(spark, make_star(spark), root)
    before = contents(read_star(spark, root, 0))
    upload = next(uploads(spark))
    write, steps = Draft.write, []

    def dies_after(n):
        left = [n]

        def failing(self, name, rows):
            steps.append(name)
            if left[0] == 0:
                raise RuntimeError("lost")
            left[0] -= 1
            write(self, name, rows)

        return failing

    for n in (0, 4, 8, 10):
        monkeypatch.setattr(Draft, "write", dies_after(n))
        with pytest.raises(RuntimeError):
            commit(spark, root, 0, upload, "a.csv", NOW)
        assert contents(read_star(spark, root, 0)) == before
        with pytest.raises(ValueError):
            read_star(spark, root, 1)
    monkeypatch.setattr(Draft, "write", write)
    monkeypatch.setattr(Draft, "publish", dies_after(0))
    with pytest.raises(TypeError):
        commit(spark, root, 0, upload, "a.csv", NOW)
    monkeypatch.undo()
    assert commit(spark, root, 0, upload, "a.csv", NOW).version == 1
    star = read_star(spark, root, 1)
    assert star.orders.count() == 6 and star.order_items.count() == 7


def test_markers_appear_with_their_text(spark):
    path = f"{scratch_path(spark, 'marker')}/0000000001"
    assert create_once(spark, path, "first") and not create_once(spark, path, "second")
    assert read_small(spark, path) == "first"
    left = [f for f in os.listdir(os.path.dirname(path)) if "crc" not in f]
    assert left == ["0000000001"]


def test_hot_month_is_spread(spark):
    """A month with most of the orders goes to several tasks."""
    day = F.date_add(F.lit(dt.date(2024, 1, 1)), F.when(F.col("id") % 3 > 0, F.col("id") % 20).otherwise(F.col("id") % 700).cast("int"))
    orders = spark.range(20_000).select(
        F.col("id").alias("order_id"), F.format_string("N%05d", F.col("id")).alias("order_number"), F.lit(1).alias("customer_id"),
        F.lit(1).alias("region_id"), day.alias("order_date"), F.lit(None).alias("order_timestamp"), F.lit("Cash").alias("payment_method"),
        F.lit("Completed").alias("order_status"), F.lit(0).alias("shipping_cost"), F.lit(0).alias("discount_amount"),
        F.lit(1).alias("total_amount"), F.lit(False).alias("is_synthetic"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    root = scratch_path(spark, "star")
    write_star(spark, make_star(spark).replace({"orders": orders}), root)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([f for f in files(root, "orders", 0) if "order_month=202401" in f]) >= 4
    assert read_star(spark, root, 0).orders.count() == 20_000


def test_rollups_follow_imports(spark, monkeypatch):
    """Reports from sums per day equal those from the facts, after seeding, imports and compaction."""
    root = scratch_path(spark, "star")
    write_star(spark, verify_keys(make_star(spark)), root, rollups=True)
    filters = [
        EVERYTHING, SalesFilter(start_date=dt.date(2024, 1, 1), end_date=dt.date(2024, 5, 1)), SalesFilter(region_id=2),
        SalesFilter(order_status="Cancelled"), SalesFilter(payment_method="Cash", end_date=dt.date(2024, 1, 31)),
        SalesFilter(start_date=dt.date(2030, 1, 1)), SalesFilter(category_id=1),
    ]
    reports = (metrics.kpi_primary, metrics.kpi_aov, metrics.monthly_sales_trend, metrics.region_performance,
               metrics.payment_methods, metrics.yoy_long, ranking.top_products)

    def compare(version):
        star = read_star(spark, root, version)
        facts = star.replace({})
        assert star.rollups and star.keys_verified and not facts.rollups
        for flt in filters:
            for report in reports:
                assert report(star, flt).collect() == report(facts, flt).collect(), (version, flt, report)
            assert metrics.kpis(star, flt, AS_OF).collect() == metrics.kpis(facts, flt, AS_OF).collect()
            assert metrics.distinct_customers(star, flt).first() == metrics.distinct_customers(facts, flt).first()

    # Order 5 has no items at first, and gets one with the second import; N1 and A1 get more.
    uploads = (
        [("N1", "2024-05-01", "C1", "South", "Tools", "P1", "10", "1", "7000"),
         ("A1", "2024-05-02", "C3", "South", "Tools", "P1", "10", "1", "5000")],
        [("N5", "2024-05-01", "C1", "South", "Tools", "P1", "10", "1", "10"),
         ("A1", "2024-05-02", "C3", "South", "Tools", "P2", "10", "1", "10"),
         ("A2", "2023-12-31", "ZED", "North", "Pets", "P8", "10", "1", "1600")],
    )
    for version, rows in enumerate(uploads):
        commit(spark, root, version, staged(spark, rows), f"{version}.csv", NOW)
    compare(2)
    star = read_star(spark, root, compact(spark, root, 2))
    assert star.table("sales_by_day").agg(F.sum("orders")).first()[0] == 7
    compare(3)
    # The facts are not read at all.
    for report in reports[:-1]:
        text = report(star)._jdf.queryExecution().executedPlan().toString()
        assert "order_item" not in text and "/orders" not in text and "_by_day" in text


def test_removed_customers_are_gone_everywhere(spark):
    """Deletions are rows of their own; facts, sums, indexes and distinct customers leave out what went."""
    root = scratch_path(spark, "star")
    write_star(spark, verify_keys(make_star(spark)), root, rollups=True)
    doomed = spark.createDataFrame([(1,), (1,), (77,), (None,)], "customer_id bigint")
    assert remove_customers(spark, root, 0, doomed).version == 1
    assert read_star(spark, root, 0).order_items.count() == 5
    # Only the ids and the sums taken back are written.
    assert not any(files(root, name, 1) for name in ("orders", "order_items", "customers", "order_keys"))

    def compare(version):
        star = read_star(spark, root, version)
        facts = star.replace({})
        for report in (metrics.kpi_primary, metrics.region_performance, ranking.top_products, ranking.orders_table):
            assert report(star).collect() == report(facts).collect(), (version, report)
        assert orphans(star).where("orphan_rows > 0").count() == 0
        return star

    star = compare(1)
    assert {r.customer_code for r in star.customers.collect()} == {"C2", "C3"}
    assert {r.order_number for r in star.orders.collect()} == {"N3", "N4", "N5"}
    assert {r.order_id for r in star.order_items.collect()} == {3, 4}
    # Region 1 had only orders of that customer, so it is no row of the report.
    assert [r.region_id for r in metrics.region_performance(star).collect()] == [2]
    # Number and code come back as new ones, also beside old ones, and count again.
    again = [("N1", "2024-01-10", "C1", "North", "Tools", "P1", "10", "2", "20"),
             ("N3", "2023-01-10", "C2", "South", "Tools", "P2", "10", "1", "10")]
    commit(spark, root, 1, staged(spark, again), "1.csv", NOW)
    star = compare(2)
    back = star.orders.where("order_number = 'N1'").first()
    assert (back.order_id, back.customer_id) == (6, 4)
    assert metrics.distinct_customers(star).first()[0] == 2

    last = compact(spark, root, 2)
    folded = compare(last)
    assert not folded.has("deleted_orders") and folded.gone_customers is None
    assert contents(folded) == contents(star)
    # Nobody to remove: a version with the same rows.
    empty = spark.createDataFrame([], "customer_id bigint")
    assert remove_customers(spark, root, last, empty).version == last + 1
    assert contents(read_star(spark, root, last + 1)) == contents(star)


def test_removal_that_dies_changes_nothing(spark, monkeypatch):
    root = scratch_path(spark, "star")
    write_star(spark, make_star(spark), root)
    before, write = contents(read_star(spark, root, 0)), Draft.write
    doomed = spark.createDataFrame([(2,)], "customer_id bigint")

    def failing(self, name, rows):
        write(self, name, rows)
        if name == "deleted_orders":
            raise RuntimeError("lost")

    monkeypatch.setattr(Draft, "write", failing)
    with pytest.raises(RuntimeError):
        remove_customers(spark, root, 0, doomed)
    assert contents(read_star(spark, root, 0)) == before
    monkeypatch.undo()
    assert remove_customers(spark, root, 0, doomed).version == 1
    assert {r.order_id for r in read_star(spark, root, 1).order_items.collect()} == {1, 2}


def test_deletions_are_read_in_the_months_asked_for(spark):
    root = scratch_path(spark, "star")
    write_star(spark, bind_star(spark, FOLDER), root)
    remove_customers(spark, root, 0, read_star(spark, root, 0).customers.where("customer_id % 10 = 0"))
    one = SalesFilter(start_date=dt.date(1996, 3, 1), end_date=dt.date(1996, 3, 31))
    plan = metrics.monthly_sales_trend(read_star(spark, root, 1), one)._jdf.queryExecution().optimizedPlan()
    assert "LeftAnti" in plan.toString()
    scans = [f for f in files(root, "deleted_orders", 1) if "order_month=199603" in f]
    found = files_read(spark, metrics.monthly_sales_trend(read_star(spark, root, 1), one))
    # Two scans of the deletions, one for orders and one for items.
    assert scans and found["other"] <= 2 * len(scans)


def test_far_page_reads_its_own_days(spark):
    root = scratch_path(spark, "star")
    write_star(spark, verify_keys(bind_star(spark, FOLDER)), root, rollups=True)
    star = read_star(spark, root, 0)
    facts = star.replace({})
    total = ranking.orders_count(facts).first()
    assert ranking.orders_count(star).first() == total
    last = total.total_pages
    some = SalesFilter(region_id=2, end_date=dt.date(1997, 5, 4))
    whole = {flt: ranking.orders_table(facts, flt, 1, 100_000).collect() for flt in (EVERYTHING, some)}
    for flt, page, size in ((EVERYTHING, last // 2, 25), (EVERYTHING, last, 25), (EVERYTHING, last + 1, 25), (some, 1, 25), (some, 3, 7)):
        rows = ranking.orders_table(star, flt, page, size).collect()
        assert rows == whole[flt][(page - 1) * size:page * size], (flt, page, size)
    rows = ranking.orders_table(star, page=last // 2, page_size=5).collect()
    months = {r.order_date.strftime("%Y%m") for r in rows}
    found = files_read(spark, ranking.orders_table(star, page=last // 2, page_size=5))
    held = [f for f in files(root, "order_items", 0) if any(f"order_month={m}" in f for m in months)]
    assert found["order_items"] <= len(held) and len(months) <= 2
