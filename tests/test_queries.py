"""Every registered query equals its oracle."""

import pytest

import __spark_entry__ as contract
from sojourn.plans import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, con, sf_dir, name):
    difference, _ = compare(spark, con, name, sf_dir)
    # At the smallest scale a filter may leave nothing on both sides.
    assert difference in ("", "both empty"), difference


def test_contract(spark):
    assert contract.entry(spark).columns == ["period", "revenue", "bookings"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(ORACLES) == set(QUERIES)
