"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from catalog.registry import ORACLES, QUERIES
from tests.oracle_compare import compare, connect

SMALL = entry.SMALL


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    assert name in ORACLES
    problem, _ = compare(duck, df, ORACLES[name])
    assert problem == ""


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert QUERIES.keys() <= entry.queries().keys()
    assert ORACLES.keys() <= entry.oracle_sql().keys()
