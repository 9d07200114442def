"""Every named query against its SQL twin on the smallest test data."""

import pytest

from __spark_entry__ import entry
from martlight.plans import all_oracles, all_queries
from tests.compare import TEST_DATA, difference

QUERIES, ORACLES = all_queries(), all_oracles()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_result(spark, name):
    assert difference(spark, QUERIES[name], ORACLES[name], f"{TEST_DATA}/sf0.001") is None


def test_entry_returns_rows(spark):
    assert entry(spark).count() > 0
