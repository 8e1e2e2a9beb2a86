"""The queries that SQL can express give the same rows as their SQL."""

import math

import duckdb
import pytest

from bitekst.llm.oracles import ORACLES
from bitekst.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def plain(value):
    if value is None:
        return "null"
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    df = QUERIES[name](spark, SF_DIR)
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = sorted_rows(df.columns, df.collect()), sorted_rows(columns, cursor.fetchall())
    assert len(got) == len(want)
    assert got == want
