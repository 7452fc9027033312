"""Every registered query gives the rows of its SQL."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows_of

SQL = entry.oracle_sql()
# the training-data operators have tests of their own
QUERIES = {k: v for k, v in entry.queries().items() if not re.match(r"op\d+_|pipeline$", k)}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(SQL[name])
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    assert mine == expected
    assert mine[0], "a query that finds nothing shows nothing"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["l_returnflag"] for r in rows} == {"A", "N", "R"}
    assert all(r["finished_price"] <= r["total_price"] for r in rows)
