"""Every log query against its SQL, on the smallest driver tables."""

import subprocess
import sys
from pathlib import Path

import pytest
from logweave.plans import queries as core

QUERIES, ORACLES = core.queries(), core.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, duck):
    folder, same = duck
    same(QUERIES[name](spark, folder), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(name, spark, duck):
    assert QUERIES[name](spark, duck[0]).count() > 0


def test_entry_and_registry_agree():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


def test_queries_are_listed_without_a_session():
    said = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); from pyspark import SparkContext; assert SparkContext._active_spark_context is None"
    subprocess.run([sys.executable, "-c", said], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
