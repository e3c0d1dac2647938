"""The queries whose whole result SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from tessera.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = QUERIES[name](spark, sf_dir)
    rel = con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert sorted(rel.columns) == cols
    want = rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select(*cols).collect())
