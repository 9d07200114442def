import datetime as dt
from decimal import Decimal

import pytest

from martlight.operators.cleaning import load_staged, stage
from martlight.operators.generate import generate, seed_star
from martlight.operators.export import write_csv, write_report
from martlight.operators.filters import EVERYTHING
from martlight.operators.ingest import StageUsed, commit
from martlight.operators.quality import (
    delete_customers,
    duplicate_keys,
    orphans,
    rule_violations,
    verify_keys,
)
from martlight.session import scratch_path
from martlight.sources.star import VersionConflict, read_star, recent_imports, write_star
from martlight.sources.upload import read_raw
from tests.shop import ROWS, make_star
from tests.test_cleaning import AS_OF, raw

NOW = dt.datetime(2024, 6, 1, 8)


def staged(spark, headers, rows):
    folder = scratch_path(spark, "stage")
    stage(raw(spark, headers, rows), folder, AS_OF)
    return load_staged(spark, folder)


def test_commit(spark):
    root = scratch_path(spark, "star")
    write_star(spark, make_star(spark), root)
    headers = ["order", "date", "customer id", "region", "category", "sku", "price", "qty", "total"]
    upload = staged(spark, headers, [
        ("N2", "2024-05-01", "C1", "South", "Tools", "P1", "10", "1", "10"),
        ("M9", "2024-05-02", "ZZ-12345", "south", "Pets", "P9", "8.10", "2", "16.20"),
        ("M9", "2024-05-03", "C2", "Nowhere", "Tools", "P1", "10", "3", ""),
        ("M8", "2024-05-04", "C2", "Nowhere", "Pets", "P9", "99", "1", "6000"),
    ])
    done = commit(spark, root, 0, upload, "may.csv", NOW)
    assert (done.version, done.orders_inserted, done.items_inserted) == (1, 2, 4)
    star = read_star(spark, root, 1)

    orders = {r.order_number: r for r in star.orders.collect()}
    assert len(orders) == 7
    # A known order only gets the imported total; all else stays.
    assert orders["N2"].total_amount == Decimal("10.00")
    assert orders["N2"].order_date == dt.date(2024, 2, 10) and orders["N2"].order_id == 2
    new = orders["M9"]
    assert new.order_id == 6 and new.total_amount == Decimal("46.20")
    assert new.order_date == dt.date(2024, 5, 2) and not new.is_synthetic
    assert new.order_timestamp == dt.datetime(2024, 5, 2, 12)
    regions = {r.region_name: r.region_id for r in star.regions.collect()}
    assert len(regions) == 7 and new.region_id == regions["South"]
    # An unknown region falls to the first one.
    assert orders["M8"].region_id == 1

    customers = {r.customer_code: r for r in star.customers.collect()}
    assert customers["ZZ-12345"].last_name == "User_2345"
    assert customers["ZZ-12345"].email == "zz-12345@imported-customer.com"
    assert new.customer_id == customers["ZZ-12345"].customer_id == 4
    assert customers["C1"].segment == "High Spending (VIP)"
    assert customers["C2"].segment == "High Spending (VIP)"
    assert customers["C3"].segment == "Low Spending"

    product = {r.product_code: r for r in star.products.collect()}["P9"]
    assert (product.unit_price, product.cost_price) == (Decimal("8.10"), Decimal("5.27"))
    categories = {r.category_id: r for r in star.categories.collect()}
    assert categories[product.category_id].category_name == "Pets"
    assert star.order_items.count() == len(ROWS["order_items"]) + 4
    assert duplicate_keys(star).where("extra_rows > 0").count() == 0
    assert orphans(star).where("orphan_rows > 0").count() == 0

    log = recent_imports(star.table("data_import_logs")).collect()
    assert [(r.import_id, r.filename, r.valid_records, r.status) for r in log] == [
        (1, "may.csv", 4, "Committed")]
    assert log[0].audit_details.startswith('["Mapped 9 column headers')
    # The version before is still what it was.
    assert read_star(spark, root, 0).orders.count() == 5


def test_commit_again(spark):
    """The same file twice: totals replaced, items appended, nothing else doubled."""
    root = scratch_path(spark, "star")
    write_star(spark, verify_keys(make_star(spark)), root)
    file = (["order", "sku", "total"], [("Q", "P1", "5"), ("Q", "P2", "7")])
    first = staged(spark, *file)
    commit(spark, root, 0, first, "a.csv", NOW)
    with pytest.raises(StageUsed):
        commit(spark, root, 1, first, "a.csv", NOW)
    again = commit(spark, root, 1, staged(spark, *file), "a.csv", NOW)
    assert (again.orders_inserted, again.items_inserted) == (0, 2)
    star = read_star(spark, root, 2)
    assert star.orders.where("order_number = 'Q'").first().total_amount == Decimal("12.00")
    assert star.orders.count() == 6 and star.order_items.count() == 9
    assert star.customers.count() == 4
    assert [r.import_id for r in recent_imports(star.table("data_import_logs")).collect()] == [2, 1]
    assert star.keys_verified and verify_keys(star).keys_verified

    # Two imports from one version: the later one is refused, loses nothing, and can be repeated.
    late = staged(spark, ["order", "sku", "total"], [("Z", "P1", "1")])
    with pytest.raises(VersionConflict):
        commit(spark, root, 1, late, "z.csv", NOW)
    star = read_star(spark, root, 2)
    assert star.order_items.count() == 9 and star.orders.where("order_number = 'Z'").count() == 0
    commit(spark, root, 2, late, "z.csv", NOW)
    assert read_star(spark, root, 3).orders.count() == 7
    assert read_star(spark, root, 2).orders.count() == 6


def test_commit_of_large_numbers(spark):
    """Quantities over 2^31, totals over 10^10, and rows without a number that add up to more."""
    root = scratch_path(spark, "star")
    write_star(spark, make_star(spark), root)
    rows = [(None, f"S{k}", "1", "9e9") for k in range(3)]
    rows += [("B", "P1", "3000000000", "5"), ("C", "P2", "1", "1e12"), ("D", "P1", "1", "1e15")]
    done = commit(spark, root, 0, staged(spark, ["order", "sku", "qty", "total"], rows), "l.csv", NOW)
    assert (done.orders_inserted, done.items_inserted) == (3, 5)
    star = read_star(spark, root, 1)
    totals = {r.order_number: r.total_amount for r in star.orders.where("order_id > 5").collect()}
    assert totals == {"nan": Decimal("27000000000.00"), "B": Decimal("5.00"), "C": Decimal("1000000000000.00")}
    assert star.order_items.agg({"quantity": "max"}).first()[0] == 3_000_000_000
    assert star.table("data_import_logs").first().rejected_rows == 1


def test_generated_sales(spark):
    sales = generate(spark, make_star(spark), 300)
    grown, flat = sales.star, sales.flat
    new = grown.orders.where("order_id > 5")
    items = grown.order_items.where("order_id > 5")
    count = items.count()
    assert 300 <= count <= 303
    assert grown.customers.count() == 2503
    assert orphans(grown).where("orphan_rows > 0").count() == 0
    assert duplicate_keys(grown).where("extra_rows > 0").count() == 0
    assert items.groupBy("order_id", "product_id").count().where("count > 1").count() == 0
    ids = [r.order_id for r in new.select("order_id").orderBy("order_id").collect()]
    assert ids == list(range(6, 6 + len(ids)))
    assert flat.count() == count
    hours = new.selectExpr("min(hour(order_timestamp)) lo", "max(hour(order_timestamp)) hi").first()
    assert hours.lo >= 8 and hours.hi <= 22

    # The flat file goes back in through the cleaner.
    path = scratch_path(spark, "flat")
    write_csv(flat, path)
    folder = scratch_path(spark, "stage")
    stage(read_raw(spark, path), folder, AS_OF)
    audit = load_staged(spark, folder).audit().first()
    assert (audit.total_rows, audit.valid_records, audit.missing_values_handled) == (count, count, 0)


def test_quality_findings(spark):
    bad_items = [*ROWS["order_items"], (99, 1, 0, Decimal(1), Decimal("1.5"), Decimal(1))]
    twice = [*ROWS["regions"], (3, "North", "NO", "Aland")]
    star = make_star(spark, order_items=bad_items, regions=twice)
    assert {(r.table_name, r.key_column, r.orphan_rows)
            for r in orphans(star).where("orphan_rows > 0").collect()} == {
        ("order_items", "order_id", 1)}
    assert [(r.table_name, r.extra_rows)
            for r in duplicate_keys(star).where("extra_rows > 0").collect()] == [("regions", 1)]
    assert [r.violations for r in rule_violations(star).collect()] == [1, 1]
    assert not verify_keys(star).keys_verified
    assert verify_keys(make_star(spark)).keys_verified


def test_cascade(spark):
    star = make_star(spark)
    left = delete_customers(star, star.customers.where("customer_code = 'C2'").select("customer_id"))
    assert left.customers.count() == 2
    assert sorted(r.order_id for r in left.orders.collect()) == [1, 2, 5]
    assert sorted(r.order_id for r in left.order_items.collect()) == [1, 1, 2]


def test_report_files(spark):
    folder = scratch_path(spark, "report")
    write_report(make_star(spark), EVERYTHING, dt.date(2024, 12, 31), folder)
    summary = spark.read.option("header", True).csv(f"{folder}/executive_summary").collect()
    assert {r.metric: r.value for r in summary}["TOTAL REVENUE"] == "$74.50"
    regions = spark.read.option("header", True).csv(f"{folder}/regional_analysis")
    assert "Revenue Share %" in regions.columns and regions.count() == 2


def test_seed(spark):
    root = scratch_path(spark, "star")
    write_star(spark, make_star(spark), root)
    assert seed_star(spark, root, 0, 150, NOW) == 1
    star = read_star(spark, root, 1)
    added = star.order_items.count() - len(ROWS["order_items"])
    assert 150 <= added <= 153
    assert orphans(star).where("orphan_rows > 0").count() == 0
    assert star.products.count() == 37 and star.regions.count() == 7
    log = star.table("data_import_logs").first()
    assert (log.status, log.total_rows, log.quality_score) == ("Generated", added, 100.0)
    totals = star.orders.where("order_id > 5").selectExpr(
        "sum(total_amount - shipping_cost) s").first().s
    assert totals == star.order_items.where("order_id > 5").selectExpr(
        "sum(total_price) s").first().s
