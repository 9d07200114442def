"""Parsing of mixed date notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from martlight.functions.text import strip

# Names of months; short ones are the first three letters.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")
# Accepted notations by the shape of the text, and where year, month and day stand in it.
YEAR_FIRST = r"^(?!0000)\d{4}([-/.])\d{1,2}\1\d{1,2}$"
YEAR_LAST = r"^(?:\d{1,2}([-/.])\d{1,2}\1(?!0000)\d{4}|\d{1,2}/\d{1,2}/\d{2})$"
COMPACT = r"^(?!0000)\d{8}$"
YEAR_MONTH = r"^(?!0000)\d{4}(?:-\d{1,2})?$"
NAME_FIRST = r"^[A-Za-z]{3,9} (?:\d{1,2} )?(?!0000)\d{4}$"
NAME_SECOND = r"^\d{1,2}([- ])[A-Za-z]{3,9}\1(?!0000)\d{4}$"
# A time of day, with AM or PM, a zone offset, or neither.
TIME_SUFFIX = r",?[T ]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)? ?([AaPp]\.?[Mm]\.?)? ?(Z|UTC|GMT|[+-]\d{2}:?\d{2})?$"
WEEKDAY = r"^(?i:mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(?i:day)?\.?,? +"


def date_text(text: Column) -> Column:
    """The day in a cell's text: no time of day, weekday, commas or surrounding blanks; names of
    months in title case, as only those parse."""
    whole = strip(text)
    # Digits and hyphens, slashes or dots alone have neither.
    day = F.when(whole.rlike(r"^[-/.0-9]*+\z"), whole).otherwise(
        F.initcap(F.replace(F.regexp_replace(F.regexp_replace(whole, TIME_SUFFIX, ""), WEEKDAY, ""), F.lit(","), F.lit(""))))
    return day


def _month_number(name: Column) -> Column:
    """Number of a month given by its name or its first three letters, null for anything else."""
    known = [F.lit(m) for m in MONTHS] + [F.lit(m[:3]) for m in MONTHS]
    place = F.array_position(F.array(*known), F.lower(name))
    return F.when(place > 0, (place - 1) % 12 + 1).cast("string")


def parse_mixed_date(day: Column) -> Column:
    """DATE for any accepted notation of ``date_text``, null otherwise. Month before day when both fit.

    The shape tells which part is which; the parts are put together as year-month-day and cast once.
    Patterns and formats of their own for every notation would not fit into one generated method.
    """
    part = [F.get(F.split(day, "[-/. ]"), F.lit(k)) for k in range(3)]
    full_year = F.when(F.length(part[2]) == 2, F.concat(F.lit("20"), part[2])).otherwise(part[2])
    # A first number above 12 can only be a day.
    swapped = part[0].try_cast("int") > 12
    short, one = part[2].isNull(), F.lit("1")

    def joined(*ymd: Column) -> Column:
        return F.concat(ymd[0], F.lit("-"), ymd[1], F.lit("-"), ymd[2])

    return (
        F.when(day.rlike(YEAR_FIRST), joined(*part))
        .when(day.rlike(YEAR_LAST), joined(
            full_year, F.when(swapped, part[1]).otherwise(part[0]), F.when(swapped, part[0]).otherwise(part[1])))
        .when(day.rlike(COMPACT), joined(F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2)))
        .when(day.rlike(YEAR_MONTH), joined(part[0], F.coalesce(part[1], one), one))
        .when(day.rlike(NAME_SECOND), joined(part[2], _month_number(part[1]), part[0]))
        .when(day.rlike(NAME_FIRST), joined(
            F.when(short, part[1]).otherwise(part[2]), _month_number(part[0]), F.when(short, one).otherwise(part[1])))
    ).try_cast("date")
