"""Every registered query at the smallest scale, against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_file

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry_file.queries(), entry_file.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def plain(rows):
    def cell(v):
        return "~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in CHECKS:
        assert rows
        return
    result = tables.execute(CHECKS[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = [tuple(row[i] for i in places) for row in result.fetchall()]
    assert plain(rows) == plain(want)


def test_entry(spark):
    df = entry_file.entry(spark)
    assert df.columns == ["repo", "language", "code"] and df.count() > 0
