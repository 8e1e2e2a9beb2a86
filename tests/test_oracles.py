"""Every registered query gives the same rows as its SQL."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from bitekst.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = driver.queries()[name](spark, SF_DIR)
    rows = df.collect()
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted_rows(df.columns, rows) == sorted_rows(columns, cursor.fetchall())


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns[0] == "lang"
    assert df.count() == 4


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
