"""Repeatable sampling, balancing and splitting keyed by a hash of (seed, key)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from textlab.functions.hashing import fraction_threshold, hash_u32
from textlab.operators.indexing import hash_dense_index, take_smallest


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def sample_fraction(df: DataFrame, frac: float, seed, key, exact: bool = False,
                    group: Sequence[str] = ()) -> DataFrame:
    """Rows whose hash of (seed, key) falls below ``frac``.  ``exact=True`` keeps
    ``round(frac * n)`` rows (half to even, as pandas) per ``group``, the
    smallest hashes.  ``seed`` may be a column (one seed per row)."""
    keys = _keys(key)
    h = df.withColumn("_h", hash_u32(seed, *keys))
    if not exact:
        return h.filter(F.col("_h") < F.lit(fraction_threshold(frac))).drop("_h")
    return take_smallest(h, "_h", keys, F.bround(F.col("n") * F.lit(float(frac)), 0), group=group).drop("_h")


def undersample(df: DataFrame, fractions: Mapping[int, float], seed, key, label: str = "label",
                exact: bool = False, group: Sequence[str] = ()) -> DataFrame:
    """Thin the listed classes to their fraction; other classes and nulls pass whole (a repeatable sampleBy).
    All classes are thinned in the same passes over the input."""
    classes = [F.col(label).eqNullSafe(F.lit(c)) for c in fractions]
    if not exact:
        h = df.withColumn("_h", hash_u32(seed, *_keys(key)))
        keep = F.lit(True)
        for cls, frac in zip(classes, fractions.values()):
            keep = F.when(cls, F.col("_h") < F.lit(fraction_threshold(frac))).otherwise(keep)
        return h.filter(keep).drop("_h")
    share = F.lit(1.0)  # other classes are a group that is taken whole
    for cls, frac in fractions.items():
        share = F.when(F.col("_class") == cls, F.lit(float(frac))).otherwise(share)
    which = F.lit(None)
    for cls, c in zip(classes, fractions):
        which = F.when(cls, F.lit(c)).otherwise(which)
    h = df.withColumn("_class", which).withColumn("_h", hash_u32(seed, *_keys(key)))
    return take_smallest(h, "_h", _keys(key), F.bround(F.col("n") * share, 0), group=[*group, "_class"], few=not group).drop("_h", "_class")


def undersample_negatives(df: DataFrame, frac: float = 0.55, seed: int = 42, key="row_id",
                          label: str = "label", exact: bool = False) -> DataFrame:
    return undersample(df, {0: frac}, seed, key, label, exact)


def oversample(df: DataFrame, copies: Mapping[int, int], label: str = "label",
               copy_col: str = "copy_no") -> DataFrame:
    """Repeat rows of the listed classes ``copies`` times (narrow: one scan, no union)."""
    n = F.lit(1)
    for cls, c in copies.items():
        n = F.when(F.col(label) == cls, F.lit(int(c))).otherwise(n)
    return df.withColumn(copy_col, F.explode(F.sequence(F.lit(1), n)))


def oversample_positives(df: DataFrame, copies: int = 4, label: str = "label") -> DataFrame:
    return oversample(df, {1: copies}, label)


def union_frames(*frames: DataFrame) -> DataFrame:
    """Bag union by column name (``pd.concat``)."""
    return reduce(DataFrame.unionByName, frames)


def shuffle_order(df: DataFrame, seed: int, key, name: str = "shuffle_pos") -> DataFrame:
    """Dense position in a seeded random order: sort by (hash(seed:key), key)."""
    keys = _keys(key)
    h = df.withColumn("_h", hash_u32(seed, *keys))
    return hash_dense_index(h, "_h", keys, name).drop("_h")


def shuffle_rows(df: DataFrame, seed: int, key) -> DataFrame:
    """Rows in seeded random order (a range-partitioned global sort; repeatable)."""
    keys = _keys(key)
    return df.withColumn("_h", hash_u32(seed, *keys)).orderBy("_h", *keys).drop("_h")


def balance_classes(df: DataFrame, neg_frac: float = 0.55, pos_copies: int = 4, seed: int = 42,
                    key="row_id", label: str = "label", exact: bool = True,
                    shuffle: bool = True) -> DataFrame:
    """Undersample class 0, repeat class 1, and give every row its shuffled position."""
    thin = undersample(df, {0: neg_frac}, seed, key, label, exact)
    out = oversample(thin, {1: pos_copies}, label)
    if shuffle:
        out = shuffle_order(out, seed, _keys(key) + ["copy_no"])
    return out


def split_by_hash(df: DataFrame, test_frac: float, seed: int, key, name: str = "split",
                  exact: bool = False, first: str = "test", second: str = "train") -> DataFrame:
    """One pass, one ``split`` column: disjoint and complete by construction.
    ``exact=True``: ``round(test_frac * n)`` rows in ``first``."""
    keys = _keys(key)
    h = df.withColumn("_h", hash_u32(seed, *keys))
    if not exact:
        return h.withColumn(name, F.when(F.col("_h") < F.lit(fraction_threshold(test_frac)), first)
                            .otherwise(second)).drop("_h")
    t = take_smallest(h, "_h", keys, F.bround(F.col("n") * F.lit(float(test_frac)), 0), flag="_in")
    return t.withColumn(name, F.when(F.col("_in"), first).otherwise(second)).drop("_h", "_in")


def train_test_split(df: DataFrame, test_frac: float = 0.2, seed: int = 42, key="row_id",
                     exact: bool = True) -> DataFrame:
    return split_by_hash(df, test_frac, seed, key, exact=exact)


def ordered_split(df: DataFrame, frac: float = 0.8, seed: int = 42, key="row_id",
                  name: str = "split") -> DataFrame:
    """Shuffle, then the first ``int(n * frac)`` rows are train, the rest test."""
    keys = _keys(key)
    h = df.withColumn("_h", hash_u32(seed, *keys))
    t = take_smallest(h, "_h", keys, F.floor(F.col("n") * F.lit(float(frac))), flag="_in")
    return t.withColumn(name, F.when(F.col("_in"), "train").otherwise("test")).drop("_h", "_in")


def validation_split(df: DataFrame, frac: float = 0.1, seed=42, key="row_id",
                     name: str = "split", group: Sequence[str] = ()) -> DataFrame:
    """After a seeded shuffle, the last ``int(n * frac)`` rows are validation and
    the first ``n - int(n * frac)`` train.  A cut of zero gives an empty validation
    set.  ``key`` may be a list; pass the original row id alone to keep copies of
    one row on one side, or (row id, copy number) to cut between copies."""
    keys = _keys(key)
    h = df.withColumn("_h", hash_u32(seed, *keys))
    k = F.col("n") - F.floor(F.col("n") * F.lit(float(frac)))
    t = take_smallest(h, "_h", keys, k, flag="_in", group=group)
    return t.withColumn(name, F.when(F.col("_in"), "train").otherwise("validation")).drop("_h", "_in")


def anti_split(df: DataFrame, test: DataFrame, key: str = "row_id") -> DataFrame:
    """Everything not in ``test`` (the reference drops the test index)."""
    return df.join(test.select(key), key, "left_anti")


def gather_split(df: DataFrame, ids: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows picked by an id list; all columns move together."""
    return df.join(ids.select(key), key, "left_semi")


def seed_grid(df: DataFrame, seeds: Sequence[int], name: str = "seed") -> DataFrame:
    """Every row once per seed, in one job (a narrow explode, no join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
