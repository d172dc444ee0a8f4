"""Repeatable randomness from a hash of (seed, key).

A generator's state depends on partitioning and task order; a hash of the
row's own key does not, so a sample or shuffle is the same with 1 or 1,000
partitions and after a task retry.  The same expression exists in DuckDB:
``('0x' || substr(md5(seed || ':' || key), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

TWO_32 = 4294967296


def hash_key(*cols) -> Column:
    """String key of one or more columns, joined with ':'; nulls count as empty, so that rows with a
    null key hash like any other."""
    parts = [F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]
    return F.coalesce(parts[0], F.lit("")) if len(parts) == 1 else F.concat_ws(":", *parts)


def hash_u32(seed, *key_cols) -> Column:
    """Unsigned 32-bit value in [0, 2^32) from the first 8 hex digits of md5(seed:key).
    ``seed`` is a constant or a column (e.g. one seed per row of a seed grid)."""
    prefix = F.concat(seed.cast("string"), F.lit(":")) if isinstance(seed, Column) else F.lit(f"{seed}:")
    s = F.concat(prefix, hash_key(*key_cols))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def digest(*cols) -> Column:
    """128-bit digest of one or more columns (nulls told apart from empty strings): what rows are
    grouped by in place of a text, so that texts are never a shuffle key."""
    parts = []
    for c in cols:
        s = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.md5(F.concat(*parts))


def fraction_threshold(frac: float) -> int:
    if not 0.0 <= frac <= 1.0:
        raise ValueError("fraction must be in [0, 1]")
    return int(frac * TWO_32)


def in_fraction(seed, frac: float, *key_cols) -> Column:
    """True for about ``frac`` of the keys, the same keys on every run."""
    return hash_u32(seed, *key_cols) < F.lit(fraction_threshold(frac))
