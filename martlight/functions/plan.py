"""Shaping of query plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame) -> DataFrame:
    """The same rows, with every column computed once below this point.

    Without it Catalyst merges projections and copies whole expressions into each condition that refers
    to them, until the generated method is too large to compile, or too large for the JVM to optimize.
    """
    return rows.select(F.inline(F.array(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns]))))
