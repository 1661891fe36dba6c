import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from windrow import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def same(a, b):
    if isinstance(a, Decimal) or isinstance(b, Decimal):
        a, b = float(a), float(b)
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12)
    return a == b


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, tables, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    key = lambda row: tuple(str(v) for v in row)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    result = tables.sql(queries.ORACLES[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(map(same, a, b)), (a, b)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["window_start", "window_end", "vessel_count"]
    assert set(queries.QUERIES) <= set(entry.queries())
