"""Every registered query with SQL against DuckDB, over the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

BASE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(BASE):
        con.execute(f"create view {f[:-8]} as select * from '{BASE}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    return x


def ordered(rows):
    return sorted(rows, key=lambda t: tuple((v is None, str(v)) for v in t))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, BASE)
    cols = sorted(df.columns)
    got = ordered(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    found = duck.execute(entry.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == cols
    assert got == ordered(tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["rerank_lookup", "context_build", "rerank_topn", "result_view"])
def test_search_has_one_python_step_a_channel(spark, name):
    plan = entry.queries()[name](spark, BASE)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and 1 <= plan.count("MapInArrow") <= 2
