"""Every registered query against its SQL on the smallest tables, whole."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, compare

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    verdict, _, rows = compare(spark, con, SF, name, QUERIES[name], SQL.get(name))
    assert verdict in ("ok", "rows only"), verdict
    assert rows > 0


def test_sql_keys_are_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["ts", "event_type", "value"]
