"""Every registered query against its SQL on the smallest tables, row by row."""

import os

import duckdb
import pytest

from sparkloom.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name, tmp_path):
    at = str(tmp_path / "out")
    QUERIES[name](spark, sf_dir).write.parquet(at)
    got = db.sql(f"SELECT * FROM '{at}/*.parquet'")
    columns = sorted(got.columns)
    rows = sorted(repr([cell(r[got.columns.index(c)]) for c in columns]) for r in got.fetchall())
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(want.columns) == columns
        assert {c: str(t) for c, t in zip(want.columns, want.types, strict=True)} == {c: str(t) for c, t in zip(got.columns, got.types, strict=True)}
        assert rows == sorted(repr([cell(r[want.columns.index(c)]) for c in columns]) for r in want.fetchall())
    else:
        assert rows
