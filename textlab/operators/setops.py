"""Set operations on name columns and the split profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.functions.formats import ratio_half_even


def shared_mentions(a: DataFrame, b: DataFrame, col: str = "dataset") -> DataFrame:
    """Names in both (INTERSECT DISTINCT)."""
    return a.select(col).intersect(b.select(col))


def only_in(a: DataFrame, b: DataFrame, col: str = "dataset") -> DataFrame:
    """Names in ``a`` and not in ``b`` (EXCEPT DISTINCT)."""
    return a.select(col).subtract(b.select(col))


def union_splits(*frames: DataFrame) -> DataFrame:
    from functools import reduce
    return reduce(DataFrame.unionByName, frames)


def split_profile(df: DataFrame, split: str = "split", label: str = "label", name: str = "dataset",
                  first: str = "train", second: str = "test") -> DataFrame:
    """The whole split report as a tall table ``(split, measure, value)``.

    One pass over the rows: counts per (split, name), combined map-side, is
    the finest grain any measure needs.  That table (at most names x splits
    rows) is written once to the shared folder; per-split counts, shares,
    distinct names, the name-length histogram and the shared / only-in
    counts all derive from it.
    """
    from textlab.session import cut_lineage
    base = cut_lineage(df.groupBy(split, name).agg(
        F.count("*").alias("_n"), F.count_if(F.col(label) == 1).alias("_pos"),
        F.count_if(F.col(label) == 0).alias("_neg")))
    n, pos, neg = F.sum("_n"), F.sum("_pos"), F.sum("_neg")
    per = base.groupBy(split).agg(
        n.cast("double").alias("n_samples"), pos.cast("double").alias("n_pos"), neg.cast("double").alias("n_neg"),
        (ratio_half_even(pos * F.lit(100), n, 2) / F.lit(100.0)).alias("pct_pos"),
        (ratio_half_even(neg * F.lit(100), n, 2) / F.lit(100.0)).alias("pct_neg"),
        F.count(name).cast("double").alias("n_names"))
    tall = per.select(split, F.expr(
        "stack(6, 'n_samples', n_samples, 'n_pos', n_pos, 'n_neg', n_neg, 'pct_pos', pct_pos, "
        "'pct_neg', pct_neg, 'n_names', n_names) AS (measure, value)"))

    pres = (base.groupBy(name).agg(F.max((F.col(split) == first).cast("int")).alias("_a"),
                                   F.max((F.col(split) == second).cast("int")).alias("_b"))
            .agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).cast("double").alias("shared"),
                 F.count_if((F.col("_a") == 1) & (F.col("_b") == 0)).cast("double").alias("only_first"),
                 F.count_if((F.col("_a") == 0) & (F.col("_b") == 1)).cast("double").alias("only_second")))
    sets = pres.select(F.lit("both").alias(split), F.expr(
        f"stack(3, 'shared', shared, 'only_in_{first}', only_first, 'only_in_{second}', only_second) "
        "AS (measure, value)"))

    hist = (base.groupBy(split, F.length(name).alias("_len")).agg(F.sum("_n").cast("double").alias("value"))
            .select(split, F.concat(F.lit("name_len="), F.col("_len").cast("string")).alias("measure"),
                    "value"))
    return tall.unionByName(sets).unionByName(hist)
