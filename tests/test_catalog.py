"""Every registered query against its DuckDB oracle."""

import oracle
import pytest

from phrasemill import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, small, name):
    assert oracle.of_spark(QUERIES[name](spark, small)) == oracle.of_duckdb(ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
