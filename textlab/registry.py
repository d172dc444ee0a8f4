"""Registry of named queries and their DuckDB oracles.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the given tables; its
oracle is an SQL string DuckDB runs over the same parquet files (tables are
pre-registered as views).  Column names and types are aligned on both sides:
integers as BIGINT, doubles rounded, arrays joined to strings.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_catalog() -> None:
    # importing the catalog modules fills QUERIES / ORACLE
    from textlab import catalog  # noqa: F401
