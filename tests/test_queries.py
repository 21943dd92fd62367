"""Every registered query against its check SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry_module
from check import compare, connect, kinds

SMALL = "/root/testdata/sf0.001"
SQL = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = entry_module.queries()[name](spark, SMALL)
    assert kinds(df, con, SQL[name]) == []
    assert compare(df, con, SQL[name]) is None


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == spark.read.parquet(f"{SMALL}/orders.parquet").count()


def test_queries_are_not_empty(con):
    small = {name for name, sql in SQL.items() if con.execute(f"select count(*) from ({sql})").fetchone()[0] == 0}
    assert small <= {"f8_flow_by_id", "f9_steps_by_flow", "f10_edges_by_flow", "f11_agg_by_flow"}
