"""Every registered query of the library against its SQL in DuckDB, over whole tables."""

import pytest

from corvexa import registry

from .conftest import SMALL, oracle_rows, spark_rows

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def test_flagship_is_registered():
    assert registry.FLAGSHIP in QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_oracle(spark, oracle, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == oracle_rows(oracle, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
