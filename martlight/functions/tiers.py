"""Spend tiers of customers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from martlight.schema import MIDDLE_TIER_SPEND, TIER_NAMES, TOP_TIER_SPEND


def spend_tier(spend: Column, names=TIER_NAMES, hi=TOP_TIER_SPEND, mid=MIDDLE_TIER_SPEND) -> Column:
    return (
        F.when(spend >= hi, F.lit(names[0])).when(spend >= mid, F.lit(names[1]))
        .otherwise(F.lit(names[2]))
    )
