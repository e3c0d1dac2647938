"""Every registered query with SQL gives DuckDB's rows."""

import datetime
import glob
import os

import duckdb
import pytest

from tessera.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        if isinstance(v, datetime.datetime):
            return v.replace(tzinfo=None).isoformat()
        return v

    return sorted(([one(v) for v in r] for r in rows), key=lambda r: [(v is None, str(type(v)), v if v is not None else 0) for v in r])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = norm(tuple(r) for r in df.select(*cols).collect())
    if name not in ORACLES:
        assert got
        return
    rel = db.sql(ORACLES[name])
    assert sorted(rel.columns) == cols
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    same = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}
    assert {c: same.get(k, k) for c, k in df.dtypes} == kinds
    assert got == norm(rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
