"""Every query of the engine against its SQL at the smallest size."""

import datetime
import math

import duckdb
import pytest

from acopio.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def said(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool) or isinstance(x, (str, datetime.datetime, datetime.date)):
        return str(x)
    return f"{float(x):.6g}"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*columns).collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    want = oracle.sql(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)} FROM ({ORACLE_SQL[name]})")
    assert sorted(tuple(map(said, r)) for r in rows) == sorted(tuple(map(said, r)) for r in want.fetchall())
