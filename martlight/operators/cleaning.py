"""Cleaning of messy sales rows: valid rows, rejected rows with reasons, and an audit.

Rows are tagged, not dropped step by step. A row carries the first rule it fails, so one pass over
the input yields valid rows, rejects and every count of the audit.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from martlight.functions.dates import date_text, parse_mixed_date
from martlight.functions.money import TOO_LARGE
from martlight.functions.numbering import number_rows
from martlight.functions.plan import settled
from martlight.functions.text import is_blank, strip, title_case, to_number
from martlight.session import stored
from martlight.sources.upload import MALFORMED, ROW_INDEX

# Standard columns with the header spellings that map to them.
SYNONYMS: Mapping[str, tuple[str, ...]] = {
    "order_number": ("order_id", "order_number", "order id", "invoice_no", "transaction_id",
                     "ordernumber", "order"),
    "order_date": ("order_date", "date", "order date", "order_timestamp", "transaction_date",
                   "orderdate"),
    "customer_code": ("customer_id", "customer_code", "customer id", "cust_id", "client_id",
                      "customercode"),
    "region_name": ("region", "region_name", "sales_region", "territory", "zone", "location",
                    "regionname"),
    "category_name": ("category", "category_name", "product_category", "department", "cat_name",
                      "categoryname"),
    "product_code": ("product_code", "product_id", "sku", "item_code", "prod_id", "productcode"),
    "product_name": ("product_name", "product", "item_name", "item_description", "description",
                     "productname"),
    "unit_price": ("unit_price", "price", "item_price", "rate", "cost", "unitprice"),
    "quantity": ("quantity", "qty", "units", "units_sold", "volume", "count"),
    "discount_rate": ("discount", "discount_rate", "discount_pct", "discount_percent", "disc"),
    "total_price": ("total_price", "total", "line_total", "amount", "sales_amount", "sales",
                    "revenue", "totalprice"),
    "payment_method": ("payment_method", "payment_type", "payment", "pay_mode", "paymentmethod"),
    "order_status": ("order_status", "status", "fulfillment_status", "state", "orderstatus"),
}

# Text for blank or absent columns, in cleaning order.
TEXT_DEFAULTS: Mapping[str, str] = {
    "customer_code": "CUST-UNASSIGNED",
    "region_name": "North America",
    "category_name": "General Supplies",
    "product_code": "PROD-GENERIC",
    "product_name": "Generic Sales Item",
    "payment_method": "Credit Card",
    "order_status": "Completed",
}
TITLE_CASED = ("region_name", "category_name", "order_status", "payment_method")
RULES = ("row", "date", "quantity", "price", "range")
DUPLICATE_KEYS = ("order_number", "product_code")
DEFAULT_PRICE = 50.0
MAX_DISCOUNT = 0.90
MISSING_TEXT = "nan"
PREVIEW_ROWS, REJECT_ROWS = 15, 50
OUTLIER_DEVIATIONS = 4

CLEANED_COLUMNS = (
    ROW_INDEX, "order_number", "order_date", "customer_code", "region_name", "category_name",
    "product_code", "product_name", "unit_price", "quantity", "discount_rate", "total_price",
    "payment_method", "order_status", "order_timestamp",
)


# Spelling -> standard column; an earlier column keeps a spelling that two list.
STANDARD_NAMES = {
    spelling: name for name, spellings in reversed(SYNONYMS.items()) for spelling in spellings
}


def normal_spelling(header: str) -> str:
    return re.sub(r"[^a-z0-9_]", "_", header.strip().lower())


def standard_name(header: str) -> str:
    normal = normal_spelling(header)
    return STANDARD_NAMES.get(normal) or STANDARD_NAMES.get(header.strip().lower(), normal)


def standard_headers(headers: list[str]) -> list[str]:
    """Standard name per header. Of two headers for one column the first wins; the later one keeps
    its own normalized spelling."""
    names: list[str] = []
    for header in headers:
        name = standard_name(header)
        if name in names:
            name = normal_spelling(header)
        while name in names:
            name += "_"
        names.append(name)
    return names


def map_headers(raw: DataFrame) -> DataFrame:
    headers = [c for c in raw.columns if c not in (ROW_INDEX, MALFORMED)]
    kept = [c for c in raw.columns if c == MALFORMED]
    renamed = [
        F.col(f"`{old}`").alias(new) for old, new in zip(headers, standard_headers(headers))
    ]
    return raw.select(ROW_INDEX, *kept, *renamed)


def duplicate_keys(columns: list[str]) -> list[str]:
    return [c for c in DUPLICATE_KEYS if c in columns]


def drop_duplicates(rows: DataFrame) -> DataFrame:
    """Keep the first row per key; missing keys equal each other.

    The filter on row_number turns into a map-side limit of one row per key, so a key that fills a
    third of the input sends one row per split through the shuffle.
    """
    keys = duplicate_keys(rows.columns)
    if not keys:
        return rows
    first = Window.partitionBy(*keys).orderBy(ROW_INDEX)
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def _shown(number: Column) -> Column:
    return F.coalesce(number.cast("string"), F.lit(MISSING_TEXT))


def _computed_total(quantity: Column, price: Column, discount: Column) -> Column:
    """quantity * price * (1 - discount) in exact decimals, in DOUBLE beyond their range."""
    exact = (
        quantity.try_cast("decimal(15,0)")
        * price.try_cast("decimal(15,2)")
        * (F.lit(1) - discount.cast("decimal(5,4)"))
    )
    rough = quantity * price * (1 - discount)
    return F.when(rough < TOO_LARGE, F.round(exact, 2).cast("double")).otherwise(rough)


# Parts of the moments of money amounts, see ``moments``.
MOMENTS = ("_n", "_high", "_low", "_high_high", "_high_low", "_low_low")
UNIT = 10_000
SPLIT = 10**9
WIDE = "decimal(38,0)"


def moments(amount: Column) -> dict[str, Column]:
    """Exact sums of an amount, in ten-thousandths, and of its square: aggregates named MOMENTS.

    Doubles added in another order give other last bits, so a threshold from them would depend on how
    the rows were partitioned. Integers do not. An amount is split in two parts so that the sums of
    their products fit a DECIMAL for any number of rows.
    """
    units = F.rint(amount * UNIT).cast("bigint")
    low = F.pmod(units, F.lit(SPLIT))
    high = F.call_function("div", units - low, F.lit(SPLIT))
    products = {"_high": high, "_low": low, "_high_high": high * high, "_high_low": high * low, "_low_low": low * low}
    return {"_n": F.count(amount)} | {name: F.sum(p.cast("decimal(20,0)")) for name, p in products.items()}


def mean_and_spread() -> tuple[Column, Column]:
    """Mean and sample standard deviation from MOMENTS, null for no rows and for one row."""
    n, high, low, hh, hl, ll = (F.col(name).cast(WIDE) for name in MOMENTS)
    total = high * SPLIT + low
    # Squares are taken around a whole number next to the mean: nothing large is subtracted.
    middle = F.call_function("div", total, F.nullif(n, F.lit(0).cast(WIDE)))
    low0 = F.pmod(middle, F.lit(SPLIT))
    high0 = F.call_function("div", middle - low0, F.lit(SPLIT)).cast(WIDE)
    low0 = low0.cast(WIDE)
    squares = (
        hh - high0 * high * 2 + n * high0 * high0,
        hl - low0 * high - high0 * low + n * high0 * low0,
        ll - low0 * low * 2 + n * low0 * low0,
    )
    exact = F.try_add(
        F.try_add(F.try_multiply(squares[0], F.lit(SPLIT**2).cast(WIDE)), F.try_multiply(squares[1], F.lit(2 * SPLIT).cast(WIDE))),
        squares[2])
    rough = squares[0].cast("double") * float(SPLIT) ** 2 + squares[1].cast("double") * 2 * SPLIT + squares[2].cast("double")
    rest = (total - n * middle.cast(WIDE)).cast("double")
    around = F.greatest(F.coalesce(exact.cast("double"), rough) - rest * rest / n.cast("double"), F.lit(0.0))
    spread = F.when(n > 1, F.sqrt(around / (n.cast("double") - 1)) / UNIT)
    return total.cast("double") / n.cast("double") / UNIT, spread


def tag_rows(rows: DataFrame, as_of: dt.date) -> DataFrame:
    """Rows with standard values, the reason of rejection, and what had to be filled in."""
    have = set(rows.columns)

    def text(name: str) -> Column:
        return F.col(name)

    # Values that decide whether a row is valid. Parsed once here and only referenced below. A few at a time: the
    # JVM leaves methods of more than 8,000 bytes to its interpreter.
    texts = [c for c in TEXT_DEFAULTS if c in have]
    days = [date_text(text("order_date")).alias("_day")] if "order_date" in have else []
    stripped = settled(rows.select("*", *days, *[strip(text(c)).alias(f"_text_{c}") for c in texts]))
    filled = settled(stripped.select(
        *[c for c in stripped.columns if c not in [f"_text_{name}" for name in texts]],
        *[is_blank(F.col(f"_text_{c}")).alias(f"_blank_{c}") for c in texts],
        *[F.when(is_blank(F.col(f"_text_{c}")), F.lit(TEXT_DEFAULTS[c])).otherwise(F.col(f"_text_{c}")).alias(f"_value_{c}")
          for c in texts],
    ))
    dated = settled(filled.select(
        "*", (parse_mixed_date(F.col("_day")) if "order_date" in have else F.lit(as_of)).alias("_date")))
    parsed = dated.select(
        "*",
        (to_number(text("quantity")) if "quantity" in have else F.lit(1.0)).alias("_quantity"),
        (to_number(text("unit_price")) if "unit_price" in have else F.lit(None).cast("double"))
        .alias("_price"),
        (to_number(text("total_price")) if "total_price" in have else F.lit(None).cast("double"))
        .alias("_total"),
        (to_number(text("discount_rate")) if "discount_rate" in have else F.lit(0.0))
        .alias("_discount"),
    )
    parsed = settled(parsed)
    date, quantity, price, total = (F.col(f"_{n}") for n in ("date", "quantity", "price", "total"))
    bad_date = date.isNull()
    # Below one unit nothing is left after truncation to whole units.
    bad_quantity = quantity.isNull() | (quantity < 1)
    bad_price = price.isNull() | (price <= 0) if "unit_price" in have else F.lit(False)

    raw_date = F.coalesce(text("order_date"), F.lit(MISSING_TEXT)) if "order_date" in have else F.lit("")
    malformed = F.col(MALFORMED).isNotNull() if MALFORMED in have else F.lit(False)
    reason = (
        F.when(malformed, F.lit("Row has more or fewer cells than the header"))
        .when(bad_date, F.concat(
            F.lit("Invalid or unparseable order_date value: '"), raw_date, F.lit("'")))
        .when(bad_quantity, F.concat(
            F.lit("Invalid quantity value: "), _shown(quantity),
            F.lit(" (must be positive integer)")))
        .when(bad_price, F.concat(
            F.lit("Invalid unit price value: "), _shown(price),
            F.lit(" (must be positive number)")))
    )
    failed = F.when(malformed, F.lit("row")).when(bad_date, F.lit("date")).when(bad_quantity, F.lit("quantity")).when(
        bad_price, F.lit("price"))

    # Beyond 2^53 a DOUBLE skips whole numbers; the range rule below refuses such rows.
    whole_units = F.when(~bad_quantity, F.floor(F.least(quantity, F.lit(2.0**53))).cast("bigint"))
    if "unit_price" in have:
        unit_price = F.round(price, 2)
    elif "total_price" in have:
        unit_price = F.round(F.try_divide(F.coalesce(total, F.lit(0.0)), whole_units), 2)
    else:
        unit_price = F.lit(DEFAULT_PRICE)
    given_discount = F.coalesce(F.col("_discount"), F.lit(0.0))
    scaled = given_discount > 1.0
    discount = F.round(
        F.least(
            F.greatest(F.when(scaled, given_discount / 100.0).otherwise(given_discount), F.lit(0.0)),
            F.lit(MAX_DISCOUNT),
        ), 4,
    )
    judged = settled(parsed.select("*", reason.alias("reject_reason"), failed.alias("failed_rule")))
    valued = judged.select(
        "*",
        whole_units.alias("_units"),
        unit_price.alias("_unit_price"),
        discount.alias("_rate"),
        scaled.alias("scaled_discount"),
        (total.isNull() | (total <= 0)).alias("filled_total_price"),
    )
    valued = settled(valued)
    new_total = F.when(
        F.col("filled_total_price"),
        _computed_total(F.col("_units"), F.col("_unit_price"), F.col("_rate")),
    ).otherwise(total)
    with_total = settled(valued.withColumn("_new_total", new_total))
    too_large = (
        (quantity >= 2.0**53) | (F.col("_unit_price") >= TOO_LARGE) | (F.col("_new_total") >= TOO_LARGE)
    )
    given = [
        F.coalesce(text(c), F.lit(MISSING_TEXT)) if c in have else F.lit(MISSING_TEXT)
        for c in ("quantity", "unit_price", "total_price")
    ]
    storable = with_total.withColumns({
        "failed_rule": F.coalesce("failed_rule", F.when(too_large, F.lit("range"))),
        "reject_reason": F.coalesce("reject_reason", F.when(too_large, F.format_string(
            "Value too large to store: quantity %s, unit price %s, total %s", *given))),
    })

    storable = settled(storable)
    result = {
        "order_date": date,
        "unit_price": F.col("_unit_price"),
        "quantity": F.col("_units"),
        "discount_rate": F.col("_rate"),
        "total_price": F.col("_new_total"),
        "order_number": (
            strip(F.coalesce(text("order_number"), F.lit(MISSING_TEXT)))
            if "order_number" in have else F.lit(None).cast("string")
        ),
        "order_timestamp": (
            text("order_timestamp").try_cast("timestamp_ntz") if "order_timestamp" in have
            else date.cast("timestamp_ntz") + F.expr("INTERVAL 12 HOURS")
        ),
    }
    flags = {}
    for name, default in TEXT_DEFAULTS.items():
        if name not in have:
            result[name] = F.lit(default)
            continue
        flags[f"filled_{name}"] = F.col(f"_blank_{name}")
        value = F.col(f"_value_{name}")
        result[name] = title_case(value) if name in TITLE_CASED else value
    extra = [c for c in rows.columns if c not in result and c not in (ROW_INDEX, MALFORMED)]
    return storable.select(
        ROW_INDEX,
        *[result[c].alias(c) for c in CLEANED_COLUMNS if c != ROW_INDEX],
        *extra,
        (text("order_number") if "order_number" in have else F.lit("N/A"))
        .alias("given_order_number"),
        "reject_reason",
        "failed_rule",
        "scaled_discount",
        "filled_total_price",
        *[flag.alias(name) for name, flag in flags.items()],
    )


TAG_COLUMNS = ("given_order_number", "reject_reason", "failed_rule", "scaled_discount")


class Cleaning:
    """Views over tagged rows: what was kept, what was refused, and the figures about both."""

    def __init__(self, tagged: DataFrame, totals: DataFrame, headers: list[str],
                 folder: str | None = None):
        self.tagged = tagged
        self.totals = totals
        self.headers = headers
        self.folder = folder  # where the rows are staged, if they are

    def _valid(self) -> DataFrame:
        return self.tagged.where(F.col("reject_reason").isNull())

    def cleaned(self) -> DataFrame:
        """Valid rows. Without order numbers in the input they are numbered in row order."""
        rows = self._valid()
        if "order_number" not in self.headers:
            rows = number_rows(rows, ROW_INDEX, "_n").withColumn(
                "order_number", F.format_string("IMP-ORD-%06d", F.col("_n"))
            )
        hidden = {*TAG_COLUMNS, "_n", *[c for c in rows.columns if c.startswith("filled_")]}
        return rows.select(*[c for c in rows.columns if c not in hidden])

    def preview(self, n: int = PREVIEW_ROWS) -> DataFrame:
        return self.cleaned().orderBy(ROW_INDEX).limit(n)

    def rejects(self) -> DataFrame:
        return self.tagged.where(F.col("reject_reason").isNotNull()).select(
            (F.col(ROW_INDEX) + 1).alias("row_index"),
            F.col("given_order_number").alias("order_number"),
            F.col("reject_reason").alias("reason"),
            "failed_rule",
        )

    def rejects_sample(self, n: int = REJECT_ROWS) -> DataFrame:
        """The first rejects as listed after an upload: by rule, then by row."""
        step = F.array_position(F.array(*map(F.lit, RULES)), F.col("failed_rule"))
        return self.rejects().orderBy(step, "row_index").limit(n).drop("failed_rule")

    def sums(self) -> DataFrame:
        """One row with every count of the audit and the moments of the valid totals, from one pass over
        the tagged rows."""
        valid = F.col("reject_reason").isNull()
        figures = {
            "unique_rows": F.count("*"),
            "valid_records": F.count_if(valid),
            "rejected_rows": F.count_if(~valid),
            "rejected_date": F.count_if(F.col("failed_rule") == "date"),
            "rejected_quantity": F.count_if(F.col("failed_rule") == "quantity"),
            "rejected_price": F.count_if(F.col("failed_rule") == "price"),
            "rejected_range": F.count_if(F.col("failed_rule") == "range"),
            "rejected_row": F.count_if(F.col("failed_rule") == "row"),
            "scaled_discount": F.count_if(valid & F.col("scaled_discount")),
            "filled_total_price": F.count_if(valid & F.col("filled_total_price")),
            **{
                c: F.count_if(valid & F.col(c))
                for c in self.tagged.columns
                if c.startswith("filled_") and c != "filled_total_price"
            },
            **moments(F.when(valid, F.col("total_price"))),
        }
        return self.tagged.agg(*[figure.alias(name) for name, figure in figures.items()])

    def counts(self, sums: DataFrame | None = None) -> DataFrame:
        """One row with every figure of the audit."""
        absent = [c for c in TEXT_DEFAULTS if c not in self.headers]
        sums = self.sums() if sums is None else sums
        sums = sums.select(*[c for c in sums.columns if c not in MOMENTS])
        filled = [F.col(c) for c in sums.columns if c.startswith("filled_")]
        filled += [F.col("valid_records")] * len(absent)
        if "unit_price" not in self.headers:
            filled.append(F.col("valid_records"))
        if "quantity" not in self.headers:
            # Filled in before prices are looked at.
            filled.append(F.col("unique_rows") - F.col("rejected_date") - F.col("rejected_row"))
        row_count = F.lit(0).cast("bigint")
        widened = sums.withColumn("total_rows", row_count).withColumn(
            "missing_values_handled", reduce(Column.__add__, filled)
        )
        # The input row count comes from a second one-row frame; adding the two rows joins them.
        names = [c for c in widened.columns if c != "total_rows"]
        totals = self.totals.select("total_rows", *[row_count.alias(c) for c in names])
        both = widened.unionByName(totals)
        return both.agg(*[F.sum(c).alias(c) for c in widened.columns]).withColumn(
            "duplicate_rows", F.col("total_rows") - F.col("unique_rows")
        )

    def audit(self) -> DataFrame:
        share = F.col("valid_records") / F.greatest(F.col("total_rows"), F.lit(1)) * 100.0
        return self.counts().select(
            "total_rows",
            "valid_records",
            "duplicate_rows",
            "missing_values_handled",
            "rejected_rows",
            F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(share, 2))).alias("quality_score"),
        )

    def threshold(self, sums: DataFrame | None = None) -> DataFrame:
        """Totals above this are worth a second look; null when the totals do not vary."""
        mean, spread = mean_and_spread()
        return (self.sums() if sums is None else sums).select(
            F.when(spread > 0, mean + OUTLIER_DEVIATIONS * spread).alias("threshold"))

    def outliers(self, sums: DataFrame | None = None) -> DataFrame:
        return self._valid().withColumn("threshold", self.threshold(sums).scalar()).where(
            F.col("total_price") > F.col("threshold")
        )

    def actions(self) -> DataFrame:
        """One row holding the list of what the cleaning did, in the order it was done."""
        have, keys = self.headers, duplicate_keys(self.headers)
        n = F.col

        def done(condition, message: str, *values: Column) -> Column:
            return F.when(condition, F.format_string(message, *values))

        always = F.lit(True)
        # Wording of the audit messages.
        steps = [F.lit(f"Mapped {len(have)} column headers to standardized schema.")]
        if keys:
            steps.append(F.when(n("duplicate_rows") > 0, F.format_string(
                f"Identified %d duplicate row(s) based on {keys}; deduplicating dataset.",
                n("duplicate_rows"),
            )).otherwise(F.lit("Zero duplicate transaction rows detected.")))
        if "order_date" in have:
            steps.append(done(n("rejected_date") > 0,
                              "Rejected %d row(s) with unparseable date formats.",
                              n("rejected_date")))
            steps.append(F.lit("Standardized order dates to ISO 8601 (YYYY-MM-DD)."))
        else:
            steps.append(F.lit("Order date column was missing; populated with default current date."))
        if "quantity" in have:
            steps.append(done(n("rejected_quantity") > 0,
                              "Rejected %d row(s) with non-positive or non-numeric quantity.",
                              n("rejected_quantity")))
        else:
            steps.append(F.lit("Quantity column missing; defaulted to 1 unit per line."))
        if "unit_price" in have:
            steps.append(done(n("rejected_price") > 0,
                              "Rejected %d row(s) with non-positive or non-numeric unit price.",
                              n("rejected_price")))
        steps.append(done(n("rejected_range") > 0,
                          "Rejected %d row(s) with values too large to store.",
                          n("rejected_range")))
        steps.append(done(n("rejected_row") > 0,
                          "Rejected %d row(s) that do not fit the header.", n("rejected_row")))
        if "unit_price" not in have and "total_price" in have:
            steps.append(F.lit("Computed unit_price from total_price / quantity."))
        if "discount_rate" in have:
            steps.append(done(n("scaled_discount") > 0,
                              "Normalized %d percentage discount values (e.g. 15%% -> 0.15).",
                              n("scaled_discount")))
        if "total_price" in have:
            steps.append(done(n("filled_total_price") > 0,
                              "Recalculated %d missing or zero total_price values.",
                              n("filled_total_price")))
        else:
            steps.append(F.lit(
                "Calculated line total_price = quantity * unit_price * (1 - discount)."))
        for name, default in TEXT_DEFAULTS.items():
            if name in have:
                steps.append(done(n(f"filled_{name}") > 0,
                                  f"Imputed %d blank values in '{name}' with '{default}'.",
                                  n(f"filled_{name}")))
            else:
                steps.append(F.lit(f"Column '{name}' was missing; initialized with '{default}'."))
        if "order_number" not in have:
            steps.append(F.lit("Generated sequential order_number identifiers."))
        steps.append(done(
            n("outliers") > 0,
            "Flagged %d high-value transaction(s) exceeding $%,.2f for analyst review.",
            n("outliers"), n("threshold"),
        ))
        # Written, so that the rows are read twice in all: for the sums, and for the outliers.
        sums = stored(self.sums(), "sums")
        figures = self.counts(sums).withColumns({
            "threshold": self.threshold(sums).scalar(),
            "outliers": self.outliers(sums).agg(F.count("*")).scalar(),
        })
        return figures.select(F.array_compact(F.array(*steps)).alias("actions"))


def clean(raw: DataFrame, as_of: dt.date) -> Cleaning:
    """Nothing runs here; the returned views are lazy."""
    rows = map_headers(raw)
    headers = [c for c in rows.columns if c not in (ROW_INDEX, MALFORMED)]
    totals = rows.agg(F.count("*").alias("total_rows"))
    return Cleaning(tag_rows(drop_duplicates(rows), as_of), totals, headers)


def stage(raw: DataFrame, folder: str, as_of: dt.date) -> None:
    """Write the tagged rows for review. Nothing reaches the star tables before a commit."""
    result = clean(raw, as_of)
    result.tagged.write.mode("errorifexists").parquet(f"{folder}/rows")
    headers = F.array(*map(F.lit, result.headers))
    result.totals.withColumn("headers", headers).write.mode("errorifexists").parquet(
        f"{folder}/totals")


def load_staged(spark: SparkSession, folder: str) -> Cleaning:
    totals = spark.read.parquet(f"{folder}/totals")
    headers = list(totals.first().headers)
    return Cleaning(spark.read.parquet(f"{folder}/rows"), totals.select("total_rows"), headers, folder)
