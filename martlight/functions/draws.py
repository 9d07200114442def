"""Deterministic pseudo-random draws from a row id.

A draw depends only on the row id and the draw number, never on partitioning, so a
re-run task produces the same row. Each row starts a multiplicative congruential
stream at its id; a second modulus scrambles the lattice that neighbouring ids share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647
MULTIPLIER = 48271
SCRAMBLE_MODULUS = 2147483399
SCRAMBLE_MULTIPLIER = 40692
WRAP_STEP = 1640531


def stream_multiplier(draw: int) -> int:
    return pow(MULTIPLIER, draw + 5, MODULUS)


def seed(row_id: Column) -> Column:
    """Map any non-negative BIGINT into 1..MODULUS-1 without overflow."""
    wraps = F.call_function("div", row_id, F.lit(MODULUS - 1))
    return (row_id + (wraps % (MODULUS - 1)) * WRAP_STEP) % (MODULUS - 1) + 1


def draw(row_id: Column, number: int | Sequence[int], position: Column | None = None) -> Column:
    """BIGINT in 0..SCRAMBLE_MODULUS-1. With several numbers, ``position`` (from 0) selects one."""
    if position is None:
        multiplier = F.lit(stream_multiplier(number)).cast("bigint")
    else:
        choices = [F.lit(stream_multiplier(n)).cast("bigint") for n in number]
        multiplier = F.element_at(F.array(*choices), (position + 1).cast("int"))
    first = (seed(row_id) * multiplier) % MODULUS
    return (first * F.lit(SCRAMBLE_MULTIPLIER).cast("bigint")) % SCRAMBLE_MODULUS


def pick(row_id: Column, number: int, size: int | Column) -> Column:
    """Uniform integer in 0..size-1."""
    return draw(row_id, number) % size


def weighted(drawn: Column, values: Sequence, weights: Sequence[float]) -> Column:
    """One of ``values`` with the given probabilities (the last takes the remainder).

    ``drawn`` should be a column that already holds the draw: it is compared with every limit.
    """
    reached = 0.0
    choice = None
    for value, weight in zip(values[:-1], weights[:-1]):
        reached += weight
        hit = drawn < round(reached * SCRAMBLE_MODULUS)
        choice = F.when(hit, F.lit(value)) if choice is None else choice.when(hit, F.lit(value))
    return choice.otherwise(F.lit(values[-1]))
