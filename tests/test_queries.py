"""Every registered query against its SQL, and the plans of some."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomwork.plans import queries as engine


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def compare(spark, duck, sf_dir, run, sql):
    df = run(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    found = duck.execute(sql)
    there = [c[0] for c in found.description]
    assert sorted(there) == names
    theirs = sorted(repr([plain(r[there.index(n)]) for n in names]) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(engine.ORACLE_SQL))
def test_against_sql(spark, duck, sf_dir, name):
    compare(spark, duck, sf_dir, engine.QUERIES[name], engine.ORACLE_SQL[name])


@pytest.mark.parametrize("name, table, by, nulls_first", [("order_all_asc_nulls_last", "orders", 1, False), ("order_all_desc_nulls_first", "orders", 1, True), ("order_all_float_desc_nulls_first", "customer", 1, True)])
def test_whole_tables_are_sorted(spark, duck, sf_dir, name, table, by, nulls_first):
    """All rows, in the very order of the SQL, with NULLs at one end."""
    ours = [tuple(r) for r in engine.QUERIES[name](spark, sf_dir).collect()]
    assert ours == duck.execute(engine.ORACLE_SQL[name]).fetchall()
    assert len(ours) == duck.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
    null = [r[by] is None for r in ours]
    assert any(null) and not all(null) and null == sorted(null, reverse=nulls_first)


def test_entry(spark):
    assert entry.entry(spark).columns == ["o_orderkey", "o_totalprice"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown_and_top_k(spark, sf_dir):
    df = engine.QUERIES["topk_where"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "GreaterThan(o_totalprice" in plan
    assert "o_comment" not in plan and "o_custkey" not in plan.split("ReadSchema")[-1]
