"""Every registered operator runs over its whole table, and gives the rows of its SQL where it has one."""

import pytest
from conftest import DATA
from oracle import compare, duck

from graphloom.llm import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    if name in registry.ORACLE_SQL:
        compare(df, duck(DATA), registry.ORACLE_SQL[name])
    else:
        assert df.count() > 0
