"""Every query answers on the smallest data, with the columns and values of its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [q for q in entry.queries() if q.startswith("q_")])
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql, cols = entry.oracle_sql().get(name), sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*(f"`{c}`" for c in cols)).collect())))
    if sql:
        want = duck.sql(sql)
        assert cols == sorted(want.columns)
        assert got == sorted(map(str, want.select(", ".join(f'"{c}"' for c in cols)).fetchall()))
