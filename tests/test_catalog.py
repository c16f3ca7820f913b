"""Every registered query runs on the small tables; those with an oracle agree with DuckDB row for row."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(float(f"{float(v):.9g}")) if abs(v) < 2**53 else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = Counter(tuple(canon(r[c]) for c in cols) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(canon(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall())
    assert rows == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
