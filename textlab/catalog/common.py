"""Helpers shared by the catalog modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from textlab.sources import fixtures as fx


def longs(df: DataFrame) -> DataFrame:
    """Cast every integral column to BIGINT (DuckDB's length/count type)."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        elif isinstance(f.dataType, T.FloatType):
            out.append(F.col(f.name).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.BooleanType):
            out.append(F.col(f.name).cast("bigint").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


table = fx.table
with_ctes = fx.with_ctes


def sql_hash(seed, *key_sql: str) -> str:
    """DuckDB twin of ``textlab.functions.hashing.hash_u32``."""
    key = key_sql[0] + "::VARCHAR" if len(key_sql) == 1 else \
        " || ':' || ".join(f"{k}::VARCHAR" for k in key_sql)
    return f"('0x' || substr(md5('{seed}:' || {key}), 1, 8))::BIGINT"
