"""The operators that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from sparkmend.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_rows(spark, sf_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries()[name](spark, sf_dir)
    found = con.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    rows = sorted(tuple(r[c] for c in names) for r in df.collect())
    assert rows == sorted(found.fetchall())
