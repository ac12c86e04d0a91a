"""Every registered query against the SQL that is given for it, on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest
from quaywise.plans import catalogue as demand

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(demand.QUERIES))
def test_query(spark, sql, name):
    df = demand.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in demand.ORACLES:
        assert rows
        return
    want = sql.sql(demand.ORACLES[name])
    assert sorted(want.columns) == columns
    place = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in place]) for r in want.fetchall())
