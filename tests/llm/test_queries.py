"""Registered queries against their SQL twins on the smallest tables."""

import pytest

from tests.oracle_compare import compare, connect
from wardline.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    problem, _ = compare(duck, QUERIES[name](spark, SMALL), ORACLES[name])
    assert problem == ""
