"""Every registered query equals its SQL twin on the given tables."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle_check import compare, duck

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, con, key):
    rows, _, _, problems = compare(spark, con, QUERIES[key], ORACLES[key], SF)
    assert not problems, "\n".join(problems)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
