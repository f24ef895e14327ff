"""Every registered query with SQL agrees with DuckDB on the small tables."""

import pytest

from tablewitness.checks import QUERIES, SQL
from tests.compare import compare, oracle
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees(spark, con, name):
    assert compare(spark, con, name, SMALL) == ""


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
