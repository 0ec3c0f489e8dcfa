"""Every registered query against its SQL, and the entry module."""

import pytest
from conftest import compare

from lumenspan.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(name, spark, data, duck):
    compare(QUERIES[name](spark, data), duck, ORACLE[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE.keys()))
def test_query_without_sql_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
