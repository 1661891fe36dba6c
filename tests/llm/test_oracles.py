import glob
import os

import duckdb
import pytest

from windrow.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_vector_codes", "op13_fill_in_middle"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    result = con.sql(registry.ORACLES[name])
    at = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in result.fetchall()), key=str) and len(got) > 50
