"""Every registered query with SQL must equal it exactly."""

import pytest
from check_oracle import differences, oracle_connection

import __spark_entry__ as entry
from ardoise import catalog

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return oracle_connection(folder)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, folder, con, name):
    assert differences(QUERIES[name](spark, folder), con, ORACLE[name]) == []


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "BURO_AMT_CREDIT_SUM_MEAN" in df.columns


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(ORACLE)))
def test_queries_without_sql_run(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert df.count() > 0 and len(df.columns) > 1
