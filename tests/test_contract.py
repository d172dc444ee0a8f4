"""Driver contract: key names, callables, oracle coverage."""

import inspect
import re

import __spark_entry__ as E
from textlab.registry import ORACLE, QUERIES, load_catalog


def test_keys_and_callables():
    assert set(E.oracle_sql()) <= set(E.queries())
    load_catalog()
    qs, sql = QUERIES, ORACLE  # the library's own; the training-data queries have names of their own
    assert len(qs) >= 107 and set(sql) <= set(qs)
    for k, fn in qs.items():
        assert re.fullmatch(r"[a-z][a-z0-9_]*", k), k
        assert "pipeline" not in k and not re.match(r"op\d+_", k), k
        assert list(inspect.signature(fn).parameters)[:2] == ["spark", "sf_dir"], k
    for k, s in sql.items():
        assert s.strip() and "sf0." not in s, k  # oracles read the pre-registered views only
