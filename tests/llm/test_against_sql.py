"""The operators that plain SQL can express, against it on whole tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from loomwork.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, sf_dir)
    names, found = sorted(df.columns), con.execute(ORACLE_SQL[name])
    there = [c[0] for c in found.description]
    assert sorted(there) == names
    assert sorted(repr([r[n] for n in names]) for r in df.collect()) == sorted(repr([r[there.index(n)] for n in names]) for r in found.fetchall())
