"""Text expressions used by the cleaning and reporting jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



# White space of any kind: also tabs, line breaks and the spaces of Unicode.
SPACE = r"[\s\p{Z}\u001c-\u001f\u0085]"


NUMBER_PATTERN = rf"^{SPACE}*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?{SPACE}*$"


def strip(text: Column) -> Column:
    """Text without white space around it. Between visible ASCII there is none to look for."""
    bare = F.substring(text, 1, 1).between("!", "~") & F.substring(text, -1, 1).between("!", "~")
    return F.when(bare, text).otherwise(F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", ""))


def full_name(first: Column, last: Column) -> Column:
    return F.concat(first, F.lit(" "), last)


def is_blank(stripped: Column) -> Column:
    return stripped.isNull() | (stripped == "")


def title_case(text: Column) -> Column:
    """Upper-case every letter that follows a non-letter, lower-case the rest.

    ``initcap`` alone only starts words at blanks; here a hyphen or a digit starts one too. Text of ASCII
    letters and blanks needs no more than that.
    """
    pieces = F.split(F.lower(text), r"(?<=[^\p{L}])")
    return F.when(text.rlike(r"^[A-Za-z ]*+\z"), F.initcap(text)).otherwise(
        F.array_join(F.transform(pieces, F.initcap), ""))


def to_number(text: Column) -> Column:
    """DOUBLE for plain decimal notation, null for anything else (``12f``, ``1,200``, ``NaN``)."""
    return F.when(text.rlike(NUMBER_PATTERN), strip(text).try_cast("double"))
