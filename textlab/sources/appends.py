"""Ordered appends to a folder, safe on retry.

A folder holds ``data/append=<n>/`` for each append and, written after it, ``log/append=<n>/`` with the name of the
append. Readers see the appends that the log holds, in the order of their numbers. An append that is
tried again under its name takes its old number and replaces what it left, so nothing is there twice, whether it
failed before the log or after. One writer appends to a folder at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_LOG = "append bigint, name string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(append, name) of the appends that are whole."""
    try:
        return spark.read.schema(_LOG).parquet(f"{path}/log").select("append", "name")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LOG)


def append(spark: SparkSession, path: str, name: str, write: Callable[[str], None]) -> int:
    """Has ``write`` write a folder's worth of data as the append ``name``; returns its number."""
    log = commits(spark, path)
    own, last = log.agg(F.max(F.when(F.col("name") == name, F.col("append"))), F.max("append")).first()
    n = own if own is not None else 0 if last is None else last + 1
    write(f"{path}/data/append={n}")
    spark.createDataFrame([(name,)], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/log/append={n}")
    return n


def committed(data: DataFrame, path: str) -> DataFrame:
    """Rows of ``data``, read from ``<path>/data`` with its append column, whose append the log holds."""
    return data.join(commits(data.sparkSession, path).select("append"), "append", "left_semi")
