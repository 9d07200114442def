"""Reading uploaded CSV files as text, with a stable row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from martlight.session import stored

ROW_INDEX = "row_idx"
MALFORMED = "_malformed"

# Cell texts that count as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


OPTIONS = {"header": True, "quote": '"', "escape": '"'}
# A quoted cell that begins and ends on its line; quotes elsewhere are plain letters.
_WHOLE_CELL = r'(?<=^|,)"[^"]*+(?:""[^"]*+)*+"'
_OPENING = r'(?:^|,)"'
_TO_CLOSING = r'^[^"]*+(?:""[^"]*+)*+"'


class UnclosedQuote(ValueError):
    """A file ends inside a quoted cell."""


def read_raw(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Every column as text, missing cells as null, rows numbered in file order.

    Headers are in the first row of each file. No schema is inferred, which saves a pass and keeps
    codes such as ``007`` as written. ``_malformed`` holds the text of rows with more or fewer cells
    than the header, null otherwise; cleaning rejects them.

    Cells may hold line breaks between quotes. Files are still read in byte ranges by many tasks: a
    first pass finds what each range does to the state "inside a quoted cell", the ranges are chained,
    and every line then knows the record it belongs to. Files without such cells are read as they are.
    A file that ends inside a quoted cell is refused. Without ``multiline`` every line is a row.
    """
    names = spark.read.options(**OPTIONS, multiLine=multiline).csv(path).columns
    ranges = _chained(_summed(_lines(spark, path))) if multiline else None
    if ranges is None or not _spans_lines(ranges):
        schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, MALFORMED]])
        text = spark.read.schema(schema).options(**OPTIONS, columnNameOfCorruptRecord=MALFORMED).csv(path)
        located = text.select(
            *_cells(names),
            MALFORMED,
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_id"),
        )
        return with_row_index(located)
    records = _records(_lines(spark, path), ranges)
    declared = ", ".join("`" + c.replace("`", "``") + "` string" for c in [*names, MALFORMED])
    parsed = F.from_csv("_text", declared, {
        "quote": '"', "escape": '"', "multiLine": "true", "columnNameOfCorruptRecord": MALFORMED})
    return records.select(parsed.alias("_row"), ROW_INDEX).select("_row.*", ROW_INDEX).select(
        *_cells(names), MALFORMED, ROW_INDEX)


def _cells(names: list[str]) -> list[Column]:
    cells = [F.col("`" + c.replace("`", "``") + "`") for c in names]
    return [F.when(~cell.isin(*MISSING_TOKENS), cell).alias(c) for cell, c in zip(cells, names)]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their byte range and, for each, where it ends if it begins outside of a quoted cell
    (``_outside``) or inside of one (``_inside``): 1 is inside."""
    line = F.col("value")
    rows = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )

    def opens(text: Column) -> Column:
        return F.regexp_replace(text, _WHOLE_CELL, "").rlike(_OPENING).cast("int")

    quoted = F.contains(line, F.lit('"'))
    closed = F.when(line.rlike(_TO_CLOSING), opens(F.regexp_replace(line, _TO_CLOSING, "x"))).otherwise(1)
    return rows.withColumns({
        "_outside": F.when(quoted, opens(line)).otherwise(0),
        "_inside": F.when(quoted, closed).otherwise(1),
        "_blank": F.trim(F.translate(line, "\r\t", "")) == "",
    })


def _state(at_begin: Column | int) -> Column:
    """0 or 1 before the line, given the state where its range begins."""
    start = at_begin if isinstance(at_begin, Column) else F.lit(at_begin)
    fixed = F.col("_fixed")
    return F.when(fixed.isNull(), (start + F.col("_flips")) % 2).otherwise(
        (fixed["value"] + F.col("_flips") - fixed["flips"]) % 2)


def _with_state(lines: DataFrame) -> DataFrame:
    """Lines with what came before them in their range: lines that swap inside and outside
    (``_flips``), and the last line that leads to one state from both, with the swaps up to it."""
    earlier = Window.partitionBy("_file", "_start").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return _composed(lines, earlier, F.col("_outside"), F.col("_inside"))


def _composed(rows: DataFrame, earlier: WindowSpec, from_outside: Column, from_inside: Column) -> DataFrame:
    flips = F.sum(((from_outside == 1) & (from_inside == 0)).cast("int")).over(earlier)
    fixed = F.when(from_outside == from_inside, F.struct(from_outside.alias("value"), F.col("_flips").alias("flips")))
    return rows.withColumn("_flips", F.coalesce(flips, F.lit(0))).withColumn(
        "_fixed", F.last(fixed, ignorenulls=True).over(earlier))


def _starts(at_begin: Column | int) -> Column:
    """Lines that begin a record."""
    return (_state(at_begin) == 0) & ~F.col("_blank")


def _summed(lines: DataFrame) -> DataFrame:
    """One row per byte range: the state behind it and the records that begin in it, for both states
    before it. Lines are shuffled without their text."""
    def behind(at_begin: int) -> Column:
        after = F.when(_state(at_begin) == 1, F.col("_inside")).otherwise(F.col("_outside"))
        return F.max_by(after, "_id")

    slim = lines.select("_file", "_start", "_id", "_outside", "_inside", "_blank")
    return _with_state(slim).groupBy("_file", "_start").agg(
        *[behind(s).alias(f"_behind{s}") for s in (0, 1)],
        *[F.count_if(_starts(s)).alias(f"_records{s}") for s in (0, 1)],
        F.max("_outside").alias("_opens"),
    )


def _chained(ranges: DataFrame) -> DataFrame:
    """Each range's state at its begin, records in earlier ranges of the file, and data rows in earlier
    files. One row per byte range (about 128 MB) of a file meets in a task."""
    earlier = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    zero, one = F.col("_behind0"), F.col("_behind1")
    ranges = _composed(stored(ranges, "ranges"), earlier, zero, one).withColumn("_begin", _state(0))
    inside = F.col("_begin") == 1
    ranges = ranges.withColumns({
        "_records": F.when(inside, F.col("_records1")).otherwise(F.col("_records0")),
        "_end": F.when(inside, one).otherwise(zero),
    }).withColumn("_before", F.coalesce(F.sum("_records").over(earlier), F.lit(0)))
    files = ranges.groupBy("_file").agg(
        F.greatest(F.sum("_records") - 1, F.lit(0)).alias("_rows"), F.max_by("_end", "_start").alias("_unclosed"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_earlier", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    return stored(ranges.join(files, "_file").select(
        "_file", "_start", "_begin", "_before", "_earlier", "_opens", "_unclosed"), "ranges")


def _spans_lines(ranges: DataFrame) -> bool:
    found = ranges.agg(F.max("_opens").alias("opens"), F.max(F.when(F.col("_unclosed") == 1, F.col("_file"))).alias("file")).first()
    if found.file is not None:
        raise UnclosedQuote(f"{found.file} ends inside a quoted cell")
    return found.opens == 1


def _records(lines: DataFrame, ranges: DataFrame) -> DataFrame:
    """The text of every record but the headers, with its row number.

    Lines are sorted inside their byte range. Records of one line pass through; only the lines of the
    others are brought together.
    """
    state = _state(F.col("_begin"))
    within = Window.partitionBy("_file", "_start").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    known = _with_state(lines).join(ranges, ["_file", "_start"]).withColumn("_state", state)
    numbered = known.withColumns({
        "_record": F.col("_before") + F.count_if(_starts(F.col("_begin"))).over(within),
        "_after": F.when(F.col("_state") == 1, F.col("_inside")).otherwise(F.col("_outside")),
    }).where((F.col("_state") == 1) | ~F.col("_blank")).where("_record > 1")
    row = (F.col("_earlier") + F.col("_record") - 2).alias(ROW_INDEX)
    alone = (F.col("_state") == 0) & (F.col("_after") == 0)
    single = numbered.where(alone).select("value", row)
    parts = F.sort_array(F.collect_list(F.struct("_start", "_id", "value")))
    several = numbered.where(~alone).groupBy(row).agg(
        F.array_join(F.transform(parts, lambda part: part["value"]), "\n").alias("value"))
    return single.unionByName(several).select(F.regexp_replace("value", "\r$", "").alias("_text"), ROW_INDEX)


def with_row_index(located: DataFrame) -> DataFrame:
    """Turn (_file, _start, _id) into consecutive numbers from 0 in file order.

    Inside one block of one file the id grows by one per row, so a row's number is the count of rows
    in all earlier blocks plus its distance from the first id of its block. Only one row per block
    (about one per 128 MB) is ordered in a single task. Spark joins the offsets in the way their size
    at run time suggests.
    """
    blocks = located.groupBy("_file", "_start").agg(
        F.count("*").alias("_rows"), F.min("_id").alias("_first")
    )
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "_file", "_start", "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
    )
    numbered = located.join(offsets, ["_file", "_start"])
    position = F.col("_before") + F.col("_id") - F.col("_first")
    return numbered.withColumn(ROW_INDEX, position).drop(
        "_file", "_start", "_id", "_first", "_before"
    )
