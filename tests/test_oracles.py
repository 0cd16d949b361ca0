"""Every query with SQL against DuckDB on the same tables; every query's columns; the entry point."""

import pytest

import __spark_entry__ as entry
from tests.oracle import differences

SQL = {k: v for k, v in entry.oracle_sql().items() if k in entry.queries()}
CORE = sorted(k for m in entry._MODULES for k in m.ORACLE_SQL)


def test_each_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, data, name):
    only_spark, only_sql, _ = differences(entry.queries()[name](spark, data), SQL[name], data)
    assert not only_spark[:3] and not only_sql[:3]


@pytest.mark.parametrize("name", ["dependency_levels", "level_violations", "largest_cycles", "simple_flow_paths", "contracted_flow", "capture_chains", "connected_runtime_rows", "reexport_components", "p1_scripts", "p1_table", "p3_report"])
def test_query_runs(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    df.collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
