import datetime as dt
import time
from decimal import Decimal

from pyspark.sql import functions as F

from martlight.schema import SCHEMAS
from martlight.sources import rollup
from martlight.sources.star import Star

DAY = dt.date(2000, 1, 1)


def test_bitmaps_are_built_where_they_are_complete(spark):
    rows = [(DAY, c) for c in (1, 1, 5, 40_000, 40_000, None)] + [(DAY + dt.timedelta(1), 1), (None, 7)]
    orders = spark.createDataFrame(rows, "order_date date, customer_id long").repartition(4)
    bits = rollup.customer_bits(orders, "order_date")
    assert bits.count() == 5
    assert rollup.count_customers(bits.where("block is not null")).first()[0] == 4
    gone = spark.createDataFrame([(5,), (5,), (9,)], "customer_id long")
    assert rollup.count_customers(bits.where("block is not null"), gone).first()[0] == 3

    # Ids are sent to the tasks, not half-filled bitmaps of 4 KB, one per task and key.
    plan = bits._jdf.queryExecution().executedPlan().toString().splitlines()
    sent = [below for above, below in zip(plan, plan[1:]) if "Exchange " in above]
    assert sent and not any("bitmap_construct" in below or "customers" in below for below in sent)


def test_a_fold_adds_up_the_sums_and_reads_facts_only_after_deletions(spark, monkeypatch, tmp_path):
    from martlight.operators.ingest import remove_customers
    from martlight.sources.star import compact, read_star, write_star

    names = ("regions", "categories", "customers", "products", "orders", "order_items")

    def rows(name, **columns):
        fields = [c.split(" ")[0] for c in SCHEMAS[name].split(", ")]
        n = len(next(iter(columns.values())))
        return spark.createDataFrame([tuple(columns[c][k] if c in columns else None for c in fields) for k in range(n)], SCHEMAS[name])

    days = [DAY, DAY, None, DAY + dt.timedelta(40)]
    frames = {n: rows(n, **{SCHEMAS[n].split(" ")[0]: []}) for n in names} | {
        "customers": rows("customers", customer_id=[5, 6, 40_000], customer_code=["a", "b", "c"]),
        "orders": rows("orders", order_id=[1, 2, 3, 4], order_number=["1", "2", "3", "4"], customer_id=[5, 6, 40_000, None],
                       order_date=days, order_status=["Completed"] * 4, total_amount=[Decimal(1)] * 4),
        "order_items": rows("order_items", order_id=[1, 1, 2, 3, 4, 9], product_id=[7, 8, 7, 7, 7, 7], quantity=[1] * 6,
                            total_price=[Decimal(2)] * 6),
    }
    root, calls, real = str(tmp_path / "star"), [], rollup.additions
    write_star(spark, Star(frames.__getitem__), root, rollups=True)
    monkeypatch.setattr(rollup, "additions", lambda *a: calls.append(1) or real(*a))

    def kept(version):
        star = read_star(spark, root, version)
        return {n: sorted(map(str, star.table(n).select(*real(star.order_items, star.orders)[n].columns).collect()))
                for n in ("sales_by_day", "product_by_day", "customers_by_day")}

    def summed(version):
        star = read_star(spark, root, version)
        return {n: sorted(map(str, r.collect())) for n, r in real(star.order_items, star.orders).items()}

    assert compact(spark, root, 0) == 1 and not calls
    assert kept(1) == kept(0) == summed(1)
    remove_customers(spark, root, 1, spark.createDataFrame([(5,)], "customer_id long"))
    compact(spark, root, 2)
    assert kept(3) == summed(3) and len(kept(3)["customers_by_day"]) == 2


def test_two_tables_of_sums_start_from_the_stored_sums_per_order(spark):
    items = spark.createDataFrame([(1, 7, 2, 100), (1, 8, 1, 50), (2, 7, 1, 5)],
                                  "order_id long, product_id long, quantity long, total_cents long")
    # Two equal rows for one order count twice.
    orders = spark.createDataFrame([(1, 5, DAY, 1, "Cash", "Completed")] * 2 + [(2, 6, DAY, 1, "Cash", "Completed")],
                                   "order_id long, customer_id long, order_date date, region_id int, payment_method string, order_status string")
    added = rollup.additions(items, orders)
    for name in ("sales_by_day", "customers_by_day"):
        plan = added[name]._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "LogicalRDD" not in plan, name
    assert [tuple(r)[4:] for r in added["sales_by_day"].collect()] == [(305, 7, 5, 3)]
    assert rollup.count_customers(added["customers_by_day"]).first()[0] == 2


def test_sums_by_product_are_written_in_slices_of_months_and_leave_no_scratch(spark, monkeypatch, tmp_path):
    from martlight import session
    from martlight.sources.star import MONTH, Draft, with_month

    days = [DAY + dt.timedelta(days=20 * k) for k in range(9)] + [None]
    rows = [(k, k % 3, day, 1, "Cash", "Completed") for k, day in enumerate(days)]
    # An order that comes twice, in two months: its items are in the folder of the first.
    rows += [(4, 1, DAY + dt.timedelta(days=170), 1, "Cash", "Completed"), (8, 2, days[8], 1, "Cash", "Completed")]
    orders = spark.createDataFrame(rows, "order_id long, customer_id long, order_date date, region_id int, payment_method string, order_status string")
    lines = [(k % 11, k % 4, k, 10, 10 * k) for k in range(60)]
    items = with_month(spark.createDataFrame(lines, "order_id long, product_id long, quantity long, unit_cents long, total_cents long"), orders)
    whole = rollup.merged(rollup.additions(items, orders)["product_by_day"], "product_by_day").collect()

    monkeypatch.setattr(rollup, "SLICE_LINES", 12)
    slices = list(rollup.product_slices(items, rollup.counted(items, orders, folder=MONTH), MONTH))
    assert len(slices) >= 4 and all(s.count() < len(whole) / 2 for s in slices)
    monkeypatch.setattr(session, "scratch_path", lambda _, label: str(tmp_path / "scratch" / label))
    draft = Draft(spark, str(tmp_path / "star"), 0)
    draft.write_rollups(items, orders)
    written = draft.written("product_by_day").drop(MONTH)
    assert draft.part["tables"].count("product_by_day") == 1
    assert sorted(map(str, rollup.merged(written, "product_by_day").collect())) == sorted(map(str, whole))
    assert (tmp_path / "scratch").is_dir() and not (tmp_path / "scratch" / "counted").exists()


def test_written_frames_leave_no_shuffle_files(spark, tmp_path):
    from martlight.session import lent, stored
    from martlight.sources.star import Draft

    def shuffles():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        files = disk.getAllFiles()
        return {files.apply(k).getName() for k in range(files.size()) if files.apply(k).getName().startswith("shuffle_")}

    sums = spark.range(1000).groupBy((F.col("id") % 100).alias("order_id")).agg(F.sum("id").alias("total_amount"))
    sums = sums.withColumn("order_month", F.lit(202001))
    draft, before = Draft(spark, str(tmp_path / "star"), 0), shuffles()
    draft.write("order_totals", sums)
    assert stored(sums, "sums").count() == 100
    with lent(sums, "sums") as rows:
        assert rows.count() == 100
    # The files go a moment after the job; the two counts of rows leave theirs.
    deadline = time.time() + 20
    while len({name.split("_")[1] for name in shuffles() - before}) > 2 and time.time() < deadline:
        time.sleep(0.2)
    assert len({name.split("_")[1] for name in shuffles() - before}) <= 2
    assert draft.written("order_totals").count() == 100
