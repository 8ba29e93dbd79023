"""Training-data queries with an SQL twin equal it on the given tables."""

import pytest

from marketframe.llm.catalog import ORACLES, QUERIES
from tests.conftest import SF
from tests.oracle_check import compare, duck


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_equals_sql(spark, key):
    rows, _, _, problems = compare(spark, duck(SF), QUERIES[key], ORACLES[key], SF)
    assert rows and not problems, "\n".join(problems)


def test_every_operator_has_a_query():
    assert {int(k[2:].split("_")[0]) for k in QUERIES} == set(range(1, 14))
