"""The star schema as a set of DataFrames, read from versioned parquet folders or bound elsewhere.

A published star is a list of parts. A part is what one import (or seeding, or compaction) wrote, and is
never changed. An import therefore costs what it brings, not what is there already:

- ``orders`` and ``order_items`` lie in folders by month of the order, orders sorted by day: a report
  over some dates reads only these months, and only row groups with these days.
- A new total of an old order is a row in ``order_totals``; reading takes the newest per order. The
  right side of that join is unique, so Catalyst drops it from every report that needs no total.
- ``customer_spend`` holds what each part adds to a customer's completed orders. Tiers are derived from
  its sums when they are read, and again only then.
- ``sales_by_day``, ``product_by_day`` and ``customers_by_day``, if the star keeps them, hold sums (and
  bitmaps of customers) that merge: each part adds its own, and reports add them up instead of the
  facts (see ``sources.rollup``).
- ``deleted_customers`` and ``deleted_orders`` name rows that are gone: reading leaves them out, and so do the
  indexes. Sums per day take back what went. The next fold drops the rows themselves.
- ``order_keys`` and ``customer_keys`` map order numbers and customer codes to ids, in folders by a hash
  of the key: an import looks its keys up in the folders they fall in.

A part is written under a name of its own and nobody reads it before ``Draft.publish`` creates the
version's marker, if it does not exist yet. The marker names the parts of the version (MAX_PARTS at most:
the next import then folds them into one) and the next free ids.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from martlight.functions.money import cents
from martlight.functions.tiers import spend_tier
from martlight.schema import COMPLETED, SCHEMAS, TABLE_NAMES, column_types
from martlight.session import create_once, lent, read_small, shuffles_freed
from martlight.sources import rollup

MONTH = "order_month"
BUCKET = "bucket"
LOGS = "data_import_logs"
#: Parts of a version; one more import folds them into one part first.
MAX_PARTS = 32
#: Keys in one folder of an index.
BUCKET_ROWS = 1 << 22
MAX_BUCKETS = 4096

# Tables that only a published star has: name, columns.
SIDE_TABLES = {
    "order_keys": "order_number string, order_id bigint, order_month int",
    "customer_keys": "customer_code string, customer_id bigint",
    "order_totals": "order_id bigint, total_amount decimal(38,2)",
    "customer_spend": "customer_id bigint, spent decimal(38,2)",
    "used_stages": "stage string",
    "deleted_customers": "customer_id bigint",
    "deleted_orders": "order_id bigint",
    "sales_by_day": (
        "order_date date, region_id int, payment_method string, order_status string, revenue bigint, "
        "units bigint, lines bigint, orders bigint"
    ),
    "product_by_day": (
        "order_date date, product_id bigint, region_id int, payment_method string, order_status string, "
        "revenue bigint, units bigint, lines bigint"
    ),
    "customers_by_day": "order_date date, block bigint, customers binary",
}
FOLDERS = {
    "orders": MONTH, "order_items": MONTH, "order_totals": MONTH, "deleted_orders": MONTH,
    "sales_by_day": MONTH, "product_by_day": MONTH, "customers_by_day": MONTH,
    "order_keys": BUCKET, "customer_keys": BUCKET,
}
# Inside its folders a table is sorted, so that row groups can be skipped.
SORTED = {
    "orders": ("order_date", "order_id"), "order_items": ("order_id",), "order_totals": ("order_id",),
    "deleted_orders": ("order_id",),
    "sales_by_day": ("order_date",), "product_by_day": ("order_date", "product_id"), "customers_by_day": ("order_date",),
    "order_keys": ("order_number",), "customer_keys": ("customer_code",),
}
INDEXES = {"order_keys": "order_number", "customer_keys": "customer_code"}
# Which deletions hide rows of a table, and by what.
ORDER_GONE, CUSTOMER_GONE = ("deleted_orders", ["order_id", MONTH]), ("deleted_customers", ["customer_id"])
HIDDEN = {
    "orders": ORDER_GONE, "order_items": ORDER_GONE, "order_keys": ORDER_GONE,
    "customers": CUSTOMER_GONE, "customer_keys": CUSTOMER_GONE,
}


def month_of(day: Column) -> Column:
    """Year and month as one number, 0 for a missing date."""
    return F.coalesce(F.year(day) * 100 + F.month(day), F.lit(0))


def with_month(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items with the month of their order; 0 without an order."""
    months = orders.select("order_id", month_of(F.col("order_date")).alias("_month"))
    found = items.join(months.groupBy("order_id").agg(F.min("_month").alias("_month")), "order_id", "left")
    return found.withColumn(MONTH, F.coalesce("_month", F.lit(0))).drop("_month")


def spend_of(orders: DataFrame) -> DataFrame:
    """What each customer's completed orders add up to."""
    done = orders.where(F.col("order_status") == COMPLETED)
    return done.groupBy("customer_id").agg(F.sum("total_amount").alias("spent"))


def with_cents(items: DataFrame) -> DataFrame:
    """Order items with their money also as BIGINT cents, for sums. Unused columns cost nothing."""
    missing = {
        name: cents(F.col(source))
        for name, source in (("unit_cents", "unit_price"), ("total_cents", "total_price"))
        if name not in items.columns
    }
    return items.withColumns(missing) if missing else items


class Star:
    """Six tables by name. Frames are built on first use, so a query binds only what it reads.

    ``keys_verified`` states that every foreign key resolves (see ``quality.verify_keys``). Queries
    then leave out joins that only test whether a parent row exists.
    """

    #: Whether the tables of ``sources.rollup`` are there.
    rollups = False
    #: Customers whose bits in ``customers_by_day`` no longer count, None if there are none.
    gone_customers: DataFrame | None = None

    def __init__(self, build: Callable[[str], DataFrame], keys_verified: bool = False):
        self._build = build
        self._frames: dict[str, DataFrame] = {}
        self.keys_verified = keys_verified

    def table(self, name: str) -> DataFrame:
        if name not in self._frames:
            rows = self._build(name)
            self._frames[name] = with_cents(rows) if name == "order_items" else rows
        return self._frames[name]

    regions = property(lambda self: self.table("regions"))
    categories = property(lambda self: self.table("categories"))
    customers = property(lambda self: self.table("customers"))
    products = property(lambda self: self.table("products"))
    orders = property(lambda self: self.table("orders"))
    order_items = property(lambda self: self.table("order_items"))

    def replace(self, frames: Mapping[str, DataFrame] | None = None, **changes) -> Star:
        frames = dict(frames or {})
        return Star(
            lambda name: frames[name] if name in frames else self.table(name),
            changes.get("keys_verified", self.keys_verified),
        )


def register_views(star: Star) -> None:
    for name in TABLE_NAMES:
        columns = [c for c, _ in column_types(name)]
        star.table(name).select(*columns).createOrReplaceTempView(name)


def table_row_counts(spark: SparkSession) -> DataFrame:
    """Rows per registered star view; 0 where a view is absent."""
    counts = None
    for name in TABLE_NAMES:
        if spark.catalog.tableExists(name):
            one = spark.table(name).agg(F.count("*").alias("row_count"))
        else:
            one = spark.range(1).select(F.lit(0).cast("bigint").alias("row_count"))
        one = one.select(F.lit(name).alias("table_name"), "row_count")
        counts = one if counts is None else counts.unionAll(one)
    return counts


def recent_imports(logs: DataFrame, n: int = 10) -> DataFrame:
    return logs.orderBy(F.desc("created_at"), F.desc("import_id")).limit(n)


class VersionConflict(RuntimeError):
    """Another import has published this version first."""


def _marker(root: str, version: int) -> str:
    return f"{root}/_published/{version:010d}"


def _published(spark: SparkSession, root: str, version: int) -> dict:
    text = read_small(spark, _marker(root, version))
    if not text:
        raise ValueError(f"version {version} of {root} is not published")
    return json.loads(text)


def is_published(spark: SparkSession, root: str, version: int) -> bool:
    return bool(read_small(spark, _marker(root, version)))


def _declared(name: str) -> str:
    columns = SCHEMAS.get(name) or SIDE_TABLES[name]
    return f"{columns}, {FOLDERS[name]} int" if name in FOLDERS and FOLDERS[name] not in columns else columns


def _no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that needs no Python worker to be read."""
    columns = [c.strip().split(" ") for c in schema.split(", ")]
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(c) for c, kind in columns])


def _rows(spark: SparkSession, root: str, parts: list[dict], name: str) -> DataFrame:
    """All rows of a table in the given parts, with the version that brought them."""
    paths = [f"{root}/{name}/{p['path']}" for p in parts if name in p["tables"]]
    schema = f"{_declared(name)}, version int, attempt string"
    if not paths:
        return _no_rows(spark, schema).drop("attempt")
    rows = spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(*paths)
    # Only what lies in a version's folder. (No comparison here: Spark would take it for a selective
    # filter and prune orders by items instead of items by orders.)
    return rows.where(F.col("version").isNotNull()).drop("attempt")


class PublishedStar(Star):
    """The tables of one published version, and its indexes."""

    def __init__(self, spark: SparkSession, root: str, version: int, marker: dict):
        super().__init__(self._logical, marker["keys_verified"])
        self.spark, self.root, self.version, self.marker = spark, root, version, marker
        self.rollups = marker["rollups"]
        if self.has("deleted_customers"):
            self.gone_customers = self.rows("deleted_customers").select("customer_id")

    def rows(self, name: str) -> DataFrame:
        return _rows(self.spark, self.root, self.marker["parts"], name)

    def has(self, name: str) -> bool:
        return any(name in p["tables"] for p in self.marker["parts"])

    def live(self, name: str) -> DataFrame:
        """Rows of a table that no version has deleted.

        A filter on months reaches the deletions too, as the month is part of the key. Catalyst broadcasts
        them under its size limit and shuffles more of them.
        """
        rows = self.rows(name)
        gone, keys = HIDDEN.get(name, (None, []))
        return rows.join(self.rows(gone).select(*keys), keys, "left_anti") if gone and self.has(gone) else rows

    def _logical(self, name: str) -> DataFrame:
        rows = self.live(name).drop("version")
        if name in rollup.GRAIN and self.has("deleted_orders"):
            # Sums that were taken back to nothing are no rows.
            return rollup.merged(rows, name, MONTH)
        if name == "orders" and self.has("order_totals"):
            newest = self.rows("order_totals").groupBy("order_id", MONTH).agg(
                F.max_by("total_amount", "version").alias("_newest"))
            total = F.coalesce("_newest", "total_amount").cast(dict(column_types("orders"))["total_amount"])
            return rows.join(newest, ["order_id", MONTH], "left").withColumn("total_amount", total).drop("_newest")
        if name == "customers" and self.marker["tiers"]:
            spent = self.rows("customer_spend").groupBy("customer_id").agg(F.sum("spent").alias("_spent"))
            tier = spend_tier(F.coalesce("_spent", F.lit(0)))
            return rows.join(spent, "customer_id", "left").withColumn("segment", tier).drop("_spent")
        return rows

    def look_up(self, index: str, wanted: DataFrame) -> DataFrame:
        """``wanted`` with the columns of an index beside its key, null where the key is not there.

        Only the folders that the wanted keys fall in are read; their numbers (MAX_BUCKETS at most)
        come to the driver first, so that the others are not even listed.
        """
        key, folder = INDEXES[index], bucket_of(F.col(INDEXES[index]), self.marker["buckets"][index])
        hit = [r[0] for r in wanted.select(folder.alias(BUCKET)).distinct().collect()]
        entries = self.live(index).where(F.col(BUCKET).isin(*hit) if hit else F.lit(False))
        return wanted.join(entries.drop("version", BUCKET), key, "left")


def largest_id(rows: DataFrame, id_column: str) -> int:
    return rows.agg(F.coalesce(F.max(id_column), F.lit(0)).cast("bigint")).first()[0]


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_star(spark: SparkSession, root: str, version: int) -> PublishedStar:
    """The published tables of ``version``, with the keys verified if the version says so."""
    return PublishedStar(spark, root, version, _published(spark, root, version))


class Draft:
    """A version in the making, from the version before it and what ``write`` adds.

    Of two drafts of one version the second cannot be published, and its rows are never seen. If the
    version before has MAX_PARTS parts, or ``fold`` asks for it, its tables are first written whole
    as one part of this version.
    """

    def __init__(self, spark: SparkSession, root: str, version: int, fold: bool = False):
        self.spark, self.root, self.version = spark, root, version
        self.part = {"path": f"version={version}/attempt={uuid.uuid4().hex}", "tables": []}
        self.marker = {"parts": [], "keys_verified": False, "tiers": False, "rollups": False, "next": {}, "buckets": {}}
        if version:
            before = read_star(spark, root, version - 1)
            self.marker = before.marker
            if fold or len(before.marker["parts"]) >= MAX_PARTS:
                folded = self._whole(before)
                self.marker = before.marker | {"parts": [folded.part], "buckets": folded.marker["buckets"]}

    def _whole(self, star: PublishedStar) -> Draft:
        draft = Draft.__new__(Draft)
        draft.spark, draft.root, draft.version = self.spark, self.root, self.version
        draft.part = {"path": f"version={self.version}/attempt={uuid.uuid4().hex}", "tables": []}
        draft.marker = {"parts": [], "buckets": {}, "rollups": star.rollups}
        draft.write_all(star)
        draft.write(LOGS, star.table(LOGS))
        draft.write("used_stages", star.rows("used_stages"))
        return draft

    def table(self, name: str) -> DataFrame:
        """Rows of a table of this version, as far as it is written."""
        parts = [*self.marker["parts"], self.part]
        return PublishedStar(self.spark, self.root, self.version, self.marker | {"parts": parts}).table(name)

    def written(self, name: str) -> DataFrame:
        """The rows of a table that this version adds, as far as it is written."""
        return _rows(self.spark, self.root, [self.part], name).drop("version")

    def write(self, name: str, rows: DataFrame) -> None:
        """Write a table of this part, in its folders and its order."""
        self._write(name, [rows])

    def _write(self, name: str, slices: Iterable[DataFrame]) -> None:
        """Write a table of this part slice by slice: the shuffles of one are gone when the next begins."""
        for number, rows in enumerate(slices):
            with shuffles_freed(self.spark):
                self._placed(name, rows).mode("append" if number else "errorifexists").parquet(
                    f"{self.root}/{name}/{self.part['path']}")
        self.part["tables"].append(name)

    def _placed(self, name: str, rows: DataFrame) -> DataFrameWriter:
        """Rows dealt out and sorted for the folders of their table."""
        columns = [tuple(c.split(" ")) for c in _declared(name).split(", ")]
        if name in INDEXES:
            rows = rows.withColumn(BUCKET, bucket_of(F.col(INDEXES[name]), self.marker["buckets"][name]))
        if FOLDERS.get(name) == MONTH and ("order_date", "date") in columns:
            rows = rows.withColumn(MONTH, month_of(F.col("order_date")))
        rows = rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in columns])
        writer = rows.write
        if name in FOLDERS:
            order = (FOLDERS[name], *SORTED[name])
            # Ranges, not hashes: a month with a third of all rows is spread over many tasks.
            writer = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(FOLDERS[name])
        return writer

    def write_orders(self, orders: DataFrame) -> None:
        """New orders and their entries in the index."""
        self.write("orders", orders)
        self.write("order_keys", orders.withColumn(MONTH, month_of(F.col("order_date"))))

    def write_customers(self, customers: DataFrame) -> None:
        self.write("customers", customers)
        self.write("customer_keys", customers)

    def write_all(self, star: Star) -> None:
        """Every table of a star, whole."""
        for index, table in (("order_keys", "orders"), ("customer_keys", "customers")):
            rows = star.table(table).count()
            self.marker["buckets"][index] = min(max(rows // BUCKET_ROWS, 8), MAX_BUCKETS)
        for name in ("regions", "categories", "products"):
            self.write(name, star.table(name))
        self.write_customers(star.customers)
        self.write_orders(star.orders)
        dated = MONTH in star.order_items.columns
        self.write("order_items", star.order_items if dated else with_month(star.order_items, star.orders))
        self.write("customer_spend", spend_of(star.orders))
        if star.rollups:
            self._fold_rollups(star)
        elif self.marker["rollups"]:
            self.write_rollups(self.written("order_items"), self.written("orders"))

    def _fold_rollups(self, star: Star) -> None:
        """The sums per day of a star that keeps them, added up: the facts are only read for customers that
        are gone, as their bits cannot be taken back."""
        for name in rollup.GRAIN:
            self.write(name, rollup.merged(star.table(name), name))
        if star.gone_customers is None:
            self.write("customers_by_day", rollup.merged_bits(star.table("customers_by_day")))
        else:
            self.write("customers_by_day", rollup.additions(star.order_items, star.orders)["customers_by_day"])

    def write_rollups(self, items: DataFrame, orders: DataFrame, seen: DataFrame | None = None) -> None:
        """Add new items to the sums per day. ``orders`` are theirs, ``seen`` those that had items."""
        items, folder = with_cents(items), MONTH if MONTH in items.columns else None
        # Written, so that the tables start from the sums per order and not from the items.
        with lent(rollup.counted(items, orders, seen, folder), "counted") as counted:
            for name, rows in rollup.from_counts(counted).items():
                self.write(name, rows)
            self._write("product_by_day", rollup.product_slices(items, counted, folder))

    def take_back(self, items: DataFrame, orders: DataFrame) -> None:
        """Take deleted orders, with all their items, out of the sums per day."""
        for name, rows in rollup.withdrawals(with_cents(items), orders).items():
            self.write(name, rows)

    def free_ids(self, id_column: str, count: int) -> int:
        """Reserve ``count`` ids and return the largest one in use before them."""
        last = self.marker["next"].get(id_column, 1) - 1
        self.used_to(id_column, last + count)
        return last

    def used_to(self, id_column: str, largest: int) -> None:
        """Ids up to ``largest`` are in use."""
        known = self.marker["next"].get(id_column, 1)
        self.marker["next"] = self.marker["next"] | {id_column: max(known, largest + 1)}

    def publish(self, keys_verified: bool, tiers: bool = True) -> None:
        parts = [*self.marker["parts"], self.part] if self.part["tables"] else self.marker["parts"]
        content = self.marker | {"parts": parts, "keys_verified": keys_verified, "tiers": tiers}
        if not create_once(self.spark, _marker(self.root, self.version), json.dumps(content)):
            raise VersionConflict(f"version {self.version} of {self.root} exists already")


def write_star(spark: SparkSession, star: Star, root: str, rollups: bool = False) -> None:
    """Write all tables as version 0, with an empty import log.

    With ``rollups`` the star also keeps sums per day, which every later import adds to. Whether its keys are verified is the given star's word: see ``quality.verify_keys``. Customers keep
    the tiers they come with until the first import.
    """
    draft = Draft(spark, root, 0)
    draft.marker["rollups"] = rollups
    for column, rows in (("order_id", star.orders), ("customer_id", star.customers)):
        draft.used_to(column, largest_id(rows, column))
    draft.write_all(star)
    draft.write(LOGS, _no_rows(spark, SCHEMAS[LOGS]))
    draft.publish(star.keys_verified, tiers=False)


def compact(spark: SparkSession, root: str, version: int) -> int:
    """Publish version ``version`` + 1 with the same rows in one part, and return that number."""
    old, draft = read_star(spark, root, version), Draft(spark, root, version + 1, fold=True)
    draft.publish(old.keys_verified, old.marker["tiers"])
    return version + 1
