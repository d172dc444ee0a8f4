"""Every registered query with an oracle equals DuckDB on sf0.001 (rows, names, values)."""

import math

import pytest

import __spark_entry__ as E
from textlab.registry import ORACLE, QUERIES, load_catalog
from tests.conftest import SF_SMALL

load_catalog()  # the training-data queries are compared in tests/llm


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert df.columns == E.entry(spark).columns


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = duck.sql(ORACLE[key])
    d_cols, d_rows = rel.columns, rel.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
