"""Every registered query with SQL gives DuckDB's rows; every other one runs."""

import oracle
import pytest

from tidemark import registry


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert oracle.difference(registry.QUERIES[name], registry.ORACLE_SQL[name], spark) == ""


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(oracle.DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
