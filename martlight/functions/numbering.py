"""Consecutive numbers and running totals over huge ordered inputs, without a global sort.

Rows carry a unique non-negative BIGINT position. Positions are cut into fixed ranges, so a range
never holds more than ``RANGE_WIDTH`` rows whatever the data looks like. Each range is numbered by
its own window and shifted by the total of the ranges before it. The ranges' totals are added up in the
same way, in blocks of ranges; only the blocks meet in a single task, and there are at most 2**23 of
them however sparse the positions are. The result depends on positions alone, so a lost executor can
be recomputed safely.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE_WIDTH = 1 << 20


def running_totals(
    df: DataFrame, position: str, amounts: dict[str, Column], width: int = RANGE_WIDTH
) -> DataFrame:
    """Add each name: the sum of its amount over all rows up to and including this one."""
    cut = F.call_function("div", F.col(position), F.lit(width))
    names = list(amounts)
    ranged = df.withColumn("_range", cut).withColumns(
        {f"_{n}": amount.cast("bigint") for n, amount in amounts.items()})
    sums = [F.sum(f"_{n}").alias(f"_{n}") for n in names]
    totals = ranged.groupBy("_range").agg(*sums).withColumn(
        "_block", F.call_function("div", F.col("_range"), F.lit(RANGE_WIDTH)))
    earlier = (Window.unboundedPreceding, -1)

    def before(window) -> dict[str, Column]:
        return {n: F.coalesce(F.sum(f"_{n}").over(window.rowsBetween(*earlier)), F.lit(0)) for n in names}

    over_blocks, in_block = before(Window.orderBy("_block")), before(
        Window.partitionBy("_block").orderBy("_range"))
    blocks = totals.groupBy("_block").agg(*sums).select(
        "_block", *[over_blocks[n].alias(f"_start_{n}") for n in names])
    ranges = totals.select("_range", "_block", *[in_block[n].alias(f"_in_{n}") for n in names]).join(
        blocks, "_block"
    ).select("_range", *[(F.col(f"_in_{n}") + F.col(f"_start_{n}")).alias(f"_before_{n}") for n in names])
    within = (
        Window.partitionBy("_range").orderBy(position)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = ranged.withColumns({f"_within_{n}": F.sum(f"_{n}").over(within) for n in names}).join(
        ranges, "_range")
    return found.withColumns({n: F.col(f"_within_{n}") + F.col(f"_before_{n}") for n in names}).drop(
        "_range", *[f"{part}_{n}" for n in names for part in ("", "_within", "_before")])


def running_total(
    df: DataFrame, position: str, amount: Column, name: str, width: int = RANGE_WIDTH
) -> DataFrame:
    """Add ``name``: the sum of ``amount`` over all rows up to and including this one."""
    return running_totals(df, position, {name: amount}, width)


def number_rows(df: DataFrame, position: str, name: str, width: int = RANGE_WIDTH) -> DataFrame:
    """Add ``name``: 1, 2, 3 … in the order of ``position``."""
    return running_total(df, position, F.lit(1), name, width)
