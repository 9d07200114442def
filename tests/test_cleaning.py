import datetime as dt
import fractions
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from martlight.operators.cleaning import (
    clean, load_staged, map_headers, mean_and_spread, moments, stage, standard_headers, tag_rows)
from martlight.functions.dates import date_text, parse_mixed_date
from martlight.operators.export import write_csv
from martlight.session import scratch_path
from martlight.sources.upload import ROW_INDEX, read_raw

AS_OF = dt.date(2024, 6, 1)


def raw(spark, headers, rows):
    text = ", ".join(f"`{h}` string" for h in headers)
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(rows)], f"{ROW_INDEX} bigint, {text}")


def test_duplicates_and_dates(spark):
    c = clean(raw(spark, ["Order ID", "Date", "Quantity", "Unit Price", "Category"], [
        ("A-1", "2024-03-01", "1", "99.50", "Garden"),
        ("A-1", "2024-03-01", "1", "99.50", "Garden"),
        ("A-2", "03/09/2024", "2", "10", "GARDEN"),
        ("A-3", "not a day", "1", "10", "Garden"),
    ]), AS_OF)
    audit = c.audit().first()
    assert (audit.total_rows, audit.duplicate_rows, audit.rejected_rows, audit.valid_records) \
        == (4, 1, 1, 2)
    assert audit.quality_score == 50.0
    assert [r.order_date for r in c.cleaned().orderBy(ROW_INDEX).collect()] == [
        dt.date(2024, 3, 1), dt.date(2024, 3, 9)]
    assert c.rejects().first().asDict() == {
        "row_index": 4, "order_number": "A-3", "failed_rule": "date",
        "reason": "Invalid or unparseable order_date value: 'not a day'"}


def test_bad_numbers(spark):
    c = clean(raw(spark, ["order_number", "order_date", "quantity", "unit_price"], [
        ("1", "2024-01-01", "-5", "10"), ("2", "2024-01-01", "0", "10"),
        ("3", "2024-01-01", "1", "-15"),
    ]), AS_OF)
    assert c.cleaned().count() == 0
    assert [r.reason for r in c.rejects_sample().collect()] == [
        "Invalid quantity value: -5.0 (must be positive integer)",
        "Invalid quantity value: 0.0 (must be positive integer)",
        "Invalid unit price value: -15.0 (must be positive number)",
    ]


def test_missing_columns(spark):
    c = clean(raw(spark, ["order_number", "order_date", "quantity", "unit_price"], [
        ("1", "2024-01-01", "4", "25"), ("2", "2024-01-02", "1", "100"),
    ]), AS_OF)
    rows = c.cleaned().orderBy(ROW_INDEX).collect()
    assert [r.total_price for r in rows] == [100.0, 100.0]
    assert rows[0].category_name == "General Supplies" and rows[0].region_name == "North America"
    assert rows[0].order_timestamp == dt.datetime(2024, 1, 1, 12)
    # Seven text columns and the total, each for two rows.
    assert c.audit().first().missing_values_handled == 16
    actions = c.actions().first().actions
    assert "Calculated line total_price = quantity * unit_price * (1 - discount)." in actions
    assert "Column 'region_name' was missing; initialized with 'North America'." in actions


def test_only_products(spark):
    c = clean(raw(spark, ["sku"], [("x",), ("y",), ("x",), (None,)]), AS_OF)
    rows = c.cleaned().orderBy(ROW_INDEX).collect()
    assert [(r.order_number, r.product_code, r.quantity, r.unit_price) for r in rows] == [
        ("IMP-ORD-000001", "x", 1, 50.0), ("IMP-ORD-000002", "y", 1, 50.0),
        ("IMP-ORD-000003", "PROD-GENERIC", 1, 50.0)]
    assert {r.order_date for r in rows} == {AS_OF}


def test_discounts_and_totals(spark):
    c = clean(raw(spark, ["order", "qty", "price", "disc", "total"], [
        ("1", "2", "10", "15", ""), ("2", "1", "1.005", "1.0", None), ("3", "3", "7", "-1", "0"),
        ("4", "1", "5", "junk", "4.999"), ("5", "1e3", " 2 ", "95", "1,5"),
    ]), AS_OF)
    rows = [(r.discount_rate, r.total_price) for r in c.cleaned().orderBy(ROW_INDEX).collect()]
    assert rows == [(0.15, 17.0), (0.9, 0.10), (0.0, 21.0), (0.0, 4.999), (0.9, 200.0)]


def test_numbers_too_large_to_store_are_rejected(spark):
    c = clean(raw(spark, ["order", "qty", "price", "total"], [
        ("1", "1e300", "1", ""), ("2", "1", "1e300", ""), ("3", "9" * 40, "1", "5"),
        ("4", "3000000000", "9", "9e9"), ("5", "1", "1", "1e14"), ("6", "1", "1e12", "1e12"),
    ]), AS_OF)
    assert sorted((r.order_number, r.quantity, r.total_price) for r in c.cleaned().collect()) == [
        ("4", 3_000_000_000, 9e9), ("6", 1, 1e12)]
    reasons = {r.order_number: r.reason for r in c.rejects().collect()}
    assert set(reasons) == {"1", "2", "3", "5"}
    assert reasons["5"] == "Value too large to store: quantity 1, unit price 1, total 1e14"


def test_blanks_are_any_white_space(spark):
    c = clean(raw(spark, ["order", "region", "category"], [
        ("1", "\tnorth america\t", "\u00a0\t"), ("2", "\u2003south\u2028", "a\tb"),
    ]), AS_OF)
    rows = c.cleaned().orderBy(ROW_INDEX).collect()
    assert [(r.region_name, r.category_name) for r in rows] == [
        ("North America", "General Supplies"), ("South", "A\tB")]


def test_dates_of_sales_exports(spark):
    day = dt.date(2024, 5, 12)
    texts = ["05/12/2024 10:30 PM", "5/12/2024 10:30:00 AM", "May 12 2024", "may 12, 2024",
             "Sunday, May 12, 2024", "2024.05.12", "\t2024-05-12 ", "2024-05-12T10:00:00+00:00",
             "2024-05-12 10:00:00.123Z", "12 May 2024", "12-MAY-2024", "20240512", "Sun 05/12/2024"]
    c = clean(raw(spark, ["order", "date"], [(str(k), t) for k, t in enumerate(texts)]), AS_OF)
    rows = c.cleaned().orderBy(ROW_INDEX).collect()
    assert [r.order_date for r in rows] == [day] * len(texts)


def test_rows_that_do_not_fit_the_header(spark):
    path = scratch_path(spark, "odd")
    spark.createDataFrame([("order,qty",), ("1,2",), ("2,2,9",), ("3",), ("4,5",)], "value string").coalesce(1).write.text(path)
    c = clean(read_raw(spark, path), AS_OF)
    assert sorted(r.order_number for r in c.cleaned().collect()) == ["1", "4"]
    assert {r.failed_rule for r in c.rejects().collect()} == {"row"}
    assert c.audit().first().rejected_rows == 2
    assert "Rejected 2 row(s) that do not fit the header." in c.actions().first().actions


def test_header_names():
    assert standard_headers(["Order ID", " QTY ", "Cost", "My Note!", "Order_Date",
                             "Order_Timestamp"]) == [
        "order_number", "quantity", "unit_price", "my_note_", "order_date", "order_timestamp"]


def test_unknown_columns_are_kept(spark):
    c = clean(raw(spark, ["order", "My Note!"], [("1", "hi")]), AS_OF)
    assert c.cleaned().first().my_note_ == "hi"


def test_null_order_numbers_form_one_order(spark):
    c = clean(raw(spark, ["order", "sku"], [(None, "a"), (None, "b"), (None, "a")]), AS_OF)
    assert [r.order_number for r in c.cleaned().collect()] == ["nan", "nan"]
    assert c.audit().first().duplicate_rows == 1


def test_outliers(spark):
    rows = [(str(i), "10") for i in range(50)] + [("x", "5000")]
    c = clean(raw(spark, ["order", "price"], rows), AS_OF)
    assert [r.order_number for r in c.outliers().collect()] == ["x"]
    assert any("Flagged 1 high-value" in a for a in c.actions().first().actions)
    same = clean(raw(spark, ["order", "price"], rows[:5]), AS_OF)
    assert not any("Flagged" in a for a in same.actions().first().actions)


def test_staged_rows_tell_the_same(spark):
    rows = raw(spark, ["order", "qty"], [("1", "1"), ("2", "x"), ("1", "1")])
    folder = scratch_path(spark, "stage")
    stage(rows, folder, AS_OF)
    staged, direct = load_staged(spark, folder), clean(rows, AS_OF)
    assert staged.audit().collect() == direct.audit().collect()
    assert staged.actions().collect() == direct.actions().collect()


def test_csv_rows_are_numbered_in_file_order(spark):
    """Many files and blocks: the number follows file name and position, not the partition."""
    path = scratch_path(spark, "many")
    rows = spark.range(5000).select(
        F.col("id").cast("string").alias("Order ID"), F.lit(" a,\"b\" ").alias("Note"),
        F.lit("NULL").alias("Gone"))
    write_csv(rows.repartitionByRange(7, F.col("Order ID").cast("int")).sortWithinPartitions(
        F.col("Order ID").cast("int")), path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        back = read_raw(spark, path)
        assert back.rdd.getNumPartitions() > 7
        assert back.where(F.col("Order ID").cast("bigint") != F.col(ROW_INDEX)).count() == 0
        assert back.select("Note", "Gone").distinct().collect() == [(" a,\"b\" ", None)]
        assert back.count() == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_threshold_has_the_same_bits_for_any_partitioning(spark):
    """Sums of integers do not depend on the order of the rows; the figures are those of plain arithmetic."""
    draw = random.Random(4)
    amounts = [round(draw.lognormvariate(5, 3), 2) for _ in range(3000)] + [9_999_999_999_999.0, 0.01, 1e12, 100_000.0, 99_999.9999]
    rows = spark.createDataFrame([(a,) for a in amounts], "total_price double")
    found = set()
    for parts in (1, 7, 211):
        sums = rows.repartition(parts).agg(*[v.alias(k) for k, v in moments(F.col("total_price")).items()])
        mean, spread = mean_and_spread()
        found.add(tuple(sums.select(mean, spread).first()))
    assert len(found) == 1
    mean, spread = found.pop()
    exact = [fractions.Fraction(round(a * 10_000), 10_000) for a in amounts]
    middle = sum(exact) / len(exact)
    deviation = math.sqrt(sum((x - middle) ** 2 for x in exact) / (len(exact) - 1))
    assert math.isclose(mean, float(middle), rel_tol=1e-15) and math.isclose(spread, deviation, rel_tol=1e-14)


@pytest.mark.parametrize("amounts", [[], [5.0], [7.25, 7.25], [99_999.9999, 100_000.0001], [1e12, 1e12 + 1], [None, 3.0, 4.0]])
def test_spread_of_few_amounts(spark, amounts):
    rows = spark.createDataFrame([(a,) for a in amounts], "total_price double")
    mean, spread = mean_and_spread()
    got = rows.agg(*[v.alias(k) for k, v in moments(F.col("total_price")).items()]).select(mean, spread).first()
    known = [a for a in amounts if a is not None]
    assert got[0] == (statistics.mean(known) if known else None)
    assert (got[1] is None) == (len(known) < 2)
    if len(known) > 1:
        assert math.isclose(got[1], statistics.stdev(known), rel_tol=1e-6)


def test_actions_read_the_rows_twice(spark):
    folder = scratch_path(spark, "stage")
    stage(raw(spark, ["order", "sku", "total"], [("a", "p", "3"), ("b", "p", "4")]), folder, AS_OF)
    staged = load_staged(spark, folder)
    actions = staged.actions()
    text = actions._jdf.queryExecution().executedPlan().toString()
    # The sums are read from their own file; the rows once more for the outliers.
    assert len(re.findall(r"FileScan parquet \[(?:[^\]]*,)?total_price#", text)) == 1
    assert actions.first() is not None


def test_cleaning_compiles(spark):
    """No stage of the cleaning is too large to be compiled."""
    raw_rows = raw(spark, ["order", "date", "customer id", "region", "category", "sku", "product", "price", "qty",
                           "discount", "total", "payment", "status"], [tuple("abcdefghijklm")])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = clean(raw_rows, AS_OF).cleaned()._jdf.queryExecution().executedPlan()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
        sizes = [stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and min(sizes) > 0 and max(sizes) < 60_000


@pytest.mark.parametrize("text, day", [
    ("2024-3-7", "2024-03-07"), ("2024/03/07", "2024-03-07"), ("2024.3.07", "2024-03-07"), ("20240307", "2024-03-07"),
    ("3/7/2024", "2024-03-07"), ("13/7/2024", "2024-07-13"), ("7-13-2024", "2024-07-13"), ("31.12.1999", "1999-12-31"),
    ("3/7/24", "2024-03-07"), ("25/12/99", "2099-12-25"), ("2024-03", "2024-03-01"), ("2024", "2024-01-01"),
    ("7-Mar-2024", "2024-03-07"), ("Mar 7 2024", "2024-03-07"), ("7 mar 2024", "2024-03-07"), ("7 March 2024", "2024-03-07"),
    ("MARCH 7, 2024", "2024-03-07"), ("Mar 2024", "2024-03-01"), ("March 2024", "2024-03-01"), ("7-march-2024", "2024-03-07"),
    ("Thursday, March 7, 2024", "2024-03-07"), ("2024-03-07T10:00:00+00:00", "2024-03-07"), ("29-02-2024", "2024-02-29"),
    ("29-02-2023", None), ("31/4/2024", None), ("2024-13-01", None), ("0000-01-01", None), ("Marc 7 2024", None),
    ("2024-03/07", None), ("32/1/2024", None), ("00/10/2024", None), ("7 2024", None), ("", None), (None, None), ("20241340", None),
])
def test_date_notations(spark, text, day):
    rows = spark.createDataFrame([(text,)], "t string")
    assert rows.select(parse_mixed_date(date_text(F.col("t"))).cast("string")).first()[0] == day


def test_quick_paths_equal_the_whole_rules(spark):
    from martlight.functions.text import SPACE, strip, title_case

    texts = ["", " ", "a", " a", "a ", "\ta\n", "a\n", " a b ", "a\u0085", "é", " é ", "~!", "\x7f", "o'neil garden-tools 2go",
             "NORTH america", "North  America ", "asia-pacific", "ÉCOLE ß", "I", "x ", "a\n b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    whole = F.regexp_replace("t", rf"^{SPACE}+|{SPACE}+$", "")
    pieces = F.split(F.lower("t"), r"(?<=[^\p{L}])")
    assert rows.where(~strip(F.col("t")).eqNullSafe(whole)).collect() == []
    assert rows.where(~title_case(F.col("t")).eqNullSafe(F.array_join(F.transform(pieces, F.initcap), ""))).collect() == []
    days = ["2024-01-02", "20240102", "1/2/24", "2024.01.02", "-", "", None, "2024-01-02 10:30", " 2024-01-02\t", "mon, JAN 2 2024", "1,2"]
    got = spark.createDataFrame([(d,) for d in days], "d string").select(date_text(F.col("d"))).collect()
    assert [r[0] for r in got] == ["2024-01-02", "20240102", "1/2/24", "2024.01.02", "-", "", None, "2024-01-02", "2024-01-02", "Jan 2 2024", "12"]


def test_generated_methods_are_small_enough_for_the_compiler(spark, tmp_path):
    headers = ["Order ID", "Date", "Customer ID", "Region", "Category", "SKU", "Product", "Price", "Qty", "Discount", "Total",
               "Payment", "Status"]
    raw(spark, headers, [("A",) * 13]).write.parquet(str(tmp_path / "raw"))
    tagged = tag_rows(map_headers(spark.read.parquet(str(tmp_path / "raw"))), AS_OF)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(tagged._jdf.queryExecution().executedPlan())
    assert stages.size()
    # Beyond 8,000 bytes a method is never compiled.
    assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) <= 8000
