"""A messy sales file derived from the test orders: one raw text row per order.

Every defect follows from arithmetic on the order key, so that SQL can derive the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martlight.functions.plan import settled
from martlight.sources.bound import order_number, product_code, read_table
from martlight.sources.upload import ROW_INDEX


def _cases(pairs: list[tuple[Column, object]], other: object) -> Column:
    result = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise(other if isinstance(other, Column) else F.lit(other))


def dirty_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d")
    )
    k, cust, d = F.col("o_orderkey"), F.col("o_custkey"), F.col("d")
    # Each seventh row repeats the order number and product code of the row before it.
    kk = F.when(k % 7 == 3, k - 1).otherwise(k)
    order = F.call_function("div", kk, F.lit(3))
    code = product_code((kk * 17) % 4001)
    units = k % 6 + 1
    cents = (k * 37) % 90000 + 100
    price = (cents.cast("decimal(12,0)") / 100).cast("decimal(12,2)")
    total = (price * units.cast("decimal(10,0)")).cast("decimal(12,2)")
    columns = {
        "Order ID": _cases(
            [(kk % 53 == 5, None), (order % 2 == 0, order_number("ORD-", order))],
            order_number("WEB-", order),
        ),
        "Date": _cases(
            [
                (k % 41 == 0, "invalid_date"),
                (k % 41 == 1, ""),
                (k % 41 == 2, "2024-02-30"),
                (k % 43 == 3, F.concat(F.date_format(d, "MM/dd/yyyy"), F.lit(" 10:30 PM"))),
                (k % 43 == 4, F.concat(F.date_format(d, "M/d/yyyy"), F.lit(" 10:30:00 AM"))),
                (k % 43 == 5, F.date_format(d, "MMM d yyyy")),
                (k % 43 == 6, F.date_format(d, "EEEE, MMMM d, yyyy")),
                (k % 43 == 7, F.date_format(d, "yyyy.MM.dd")),
                (k % 43 == 8, F.concat(F.lit("\t"), d.cast("string"), F.lit(" "))),
                (k % 43 == 9, F.concat(d.cast("string"), F.lit("T10:00:00+00:00"))),
                (k % 5 == 0, d.cast("string")),
                (k % 5 == 1, F.date_format(d, "MM/dd/yyyy")),
                (k % 5 == 2, F.date_format(d, "dd-MMM-yyyy")),
                (k % 5 == 3, F.date_format(d, "yyyyMMdd")),
            ],
            F.concat(d.cast("string"), F.lit(" 10:30:00")),
        ),
        "Customer ID": _cases(
            [
                (k % 9 == 0, ""),
                (k % 9 == 1, F.concat(F.lit(" Customer#"), F.lpad(cust.cast("string"), 9, "0"))),
                (k % 9 == 2, F.concat(F.lit("NEW-"), F.lpad(cust.cast("string"), 6, "0"))),
            ],
            F.concat(F.lit("Customer#"), F.lpad(cust.cast("string"), 9, "0")),
        ),
        "Region": _cases(
            [
                (k % 13 == 0, ""),
                (k % 13 == 2, "\tnorth america\u00a0"),
                (k % 5 == 0, "north america"),
                (k % 5 == 1, "EUROPE"),
                (k % 5 == 2, "asia-pacific"),
                (k % 5 == 3, " Latin America "),
            ],
            "Atlantis",
        ),
        "Category": _cases(
            [
                (k % 13 == 1, "   "),
                (k % 26 == 14, "\t\u00a0"),
                (k % 3 == 0, "ELECTRONICS"),
                (k % 3 == 1, "office supplies"),
            ],
            "o'neil garden-tools 2go",
        ),
        "SKU": code,
        "Product": _cases([(k % 19 == 0, None)], F.concat(F.lit("Item "), code)),
        "Price": _cases(
            [(k % 31 == 0, "-4.50"), (k % 31 == 1, ""), (k % 31 == 2, "1,200")],
            price.cast("string"),
        ),
        "Qty": _cases(
            [
                (k % 1009 == 7, "3000000000"),
                (k % 29 == 0, "-5"),
                (k % 29 == 1, "0"),
                (k % 29 == 2, "abc"),
                (k % 29 == 3, "0.5"),
                (k % 29 == 4, "2.7"),
                (k % 29 == 5, " 3 "),
                (k % 29 == 6, "1e1"),
            ],
            units.cast("string"),
        ),
        "Discount": _cases(
            [
                (k % 17 == 0, "n/a"),
                (k % 17 == 1, "250"),
                (k % 17 == 2, "-0.2"),
                (k % 17 == 3, "1.0"),
                (k % 4 == 0, "15"),
                (k % 4 == 1, "0.15"),
                (k % 4 == 2, ""),
            ],
            "0.0725",
        ),
        "Total": _cases(
            [
                (k % 2003 == 7, "100000000000000"),
                (k % 4999 == 11, "1000000000000"),
                ((kk % 53 == 5) & (k % 4 == 1), "30000000000"),
                (k % 11 == 0, ""),
                (k % 11 == 1, "0"),
                (k % 997 == 2, "9999999.99"),
            ],
            total.cast("string"),
        ),
        "Payment": _cases(
            [
                (k % 6 == 0, "PayPal"),
                (k % 6 == 1, "CREDIT CARD"),
                (k % 6 == 2, "bank transfer"),
                (k % 6 == 3, ""),
            ],
            "Debit Card",
        ),
        "Status": _cases(
            [
                (k % 8 == 0, "completed"),
                (k % 8 == 1, "SHIPPED"),
                (k % 8 == 2, ""),
                (k % 8 == 3, "cancelled"),
            ],
            "Completed",
        ),
    }
    # A few columns at a time: one method for all of them is too large for the JVM to optimize.
    rows, names = orders.withColumn(ROW_INDEX, k), list(columns)
    for at in range(0, len(names), 3):
        rows = settled(rows.select("*", *[columns[n].cast("string").alias(n) for n in names[at : at + 3]]))
    return rows.select(ROW_INDEX, *names)
