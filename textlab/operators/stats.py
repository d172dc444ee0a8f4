"""Counts, shares and distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.functions.formats import ratio_half_even


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.agg(F.count("*").cast("bigint").alias("n_samples"),
                  F.count_if(F.col(label) == 1).cast("bigint").alias("n_pos"),
                  F.count_if(F.col(label) == 0).cast("bigint").alias("n_neg"))


def label_percent(df: DataFrame, value: int = 1, label: str = "label", digits: int = 2) -> DataFrame:
    """Share of one label x 100, rounded half-even on exact integers."""
    hit = F.count_if(F.col(label) == value)
    pct = ratio_half_even(hit * F.lit(100), F.count("*"), digits) / F.lit(float(10 ** digits))
    return df.agg(F.lit(value).cast("bigint").alias("label"), pct.alias("percent"))


def positive_rate(df: DataFrame, label: str = "label") -> DataFrame:
    """Positives, total, percent with two decimals."""
    pos = F.sum(F.col(label)).cast("bigint")
    n = F.count("*")
    return df.agg(pos.alias("n_pos"), n.cast("bigint").alias("n"),
                  (ratio_half_even(pos * F.lit(100), n, 2) / F.lit(100.0)).alias("pct_pos"))


def distinct_mentions(df: DataFrame, col: str = "dataset", include_none: bool = True) -> DataFrame:
    """The set of names; the negative marker 'None' counts as a name unless ``include_none`` is off."""
    names = df.select(col).distinct()
    return names if include_none else names.filter(~F.col(col).eqNullSafe(F.lit("None")))


def nunique_mentions(df: DataFrame, col: str = "dataset", approx: bool = False) -> DataFrame:
    """Distinct names without nulls; ``approx=True`` uses HyperLogLog++."""
    agg = F.approx_count_distinct(col) if approx else F.count_distinct(col)
    return df.agg(agg.cast("bigint").alias("n_unique"))


def name_length_histogram(df: DataFrame, col: str = "dataset") -> DataFrame:
    """Rows per name length, most frequent first."""
    return (df.groupBy(F.length(col).cast("bigint").alias("name_len"))
            .agg(F.count("*").cast("bigint").alias("n"))
            .orderBy(F.desc("n"), "name_len"))


def max_tokens(df: DataFrame, col: str = "ids") -> DataFrame:
    return df.agg(F.max(F.size(col)).cast("bigint").alias("max_len"))
