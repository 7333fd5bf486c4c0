"""Every registered query of the graph engine runs, and gives the rows of its SQL where it has one."""

import pytest
from conftest import DATA
from oracle import compare, duck

from graphloom.plans import queries


@pytest.fixture(scope="module")
def con():
    return duck(DATA)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_of_the_sql(spark, con, name):
    compare(queries.QUERIES[name](spark, DATA), con, queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
