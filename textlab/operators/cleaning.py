"""Filters, projections and de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from textlab.functions.hashing import digest


def drop_null_text(df: DataFrame, col: str = "section_txt") -> DataFrame:
    return df.filter(F.col(col).isNotNull())


def skip_tiny_sections(df: DataFrame, col: str = "section_txt", min_chars: int = 5) -> DataFrame:
    """Drop sections with fewer than ``min_chars`` characters (before labelling)."""
    return df.filter(F.length(col) >= min_chars)


def tiny_section_report(df: DataFrame, col: str = "section_txt", min_chars: int = 5) -> DataFrame:
    """The sections ``skip_tiny_sections`` drops."""
    return df.filter(F.length(col) < min_chars)


def min_length_filter(df: DataFrame, col: str = "section_txt", gt: int = 20) -> DataFrame:
    """Keep text strictly longer than ``gt`` characters (exactly 20 is dropped)."""
    return df.filter(F.length(col) > gt)


def short_title_report(pubs: DataFrame, col: str = "publication_name", lt: int = 5) -> DataFrame:
    """First-seen titles shorter than ``lt`` characters."""
    return pubs.filter(F.length(col) < lt)


def label_filter(df: DataFrame, value: int, col: str = "label") -> DataFrame:
    return df.filter(F.col(col) == value)


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def project_text_label(df: DataFrame, key="row_id", text: str = "section_txt", label: str = "label") -> DataFrame:
    return df.select(*_keys(key), text, label)


def choose_text_column(df: DataFrame, col: str = "section_txt", key="row_id", label: str = "label") -> DataFrame:
    """Run the same pipeline on section content or on section title: the chosen
    column becomes ``text`` and rows without it are dropped."""
    return df.select(*_keys(key), F.col(col).alias("text"), label).filter(F.col("text").isNotNull())


def title_length_filter(df: DataFrame, col: str = "section_title", lt: int = 100) -> DataFrame:
    return df.filter(F.length(col) < lt)


def has_span_label(labels_col: str = "stacked_label", code: int = 3):
    return F.array_contains(F.col(labels_col), code)


def preview(df: DataFrame, order: Sequence[str], n: int = 2) -> DataFrame:
    """First ``n`` rows in a fixed order (a repeatable ``head``)."""
    return df.orderBy(*order).limit(n)


def dedup_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row (by ``order``) of every ``keys`` group.

    One aggregate: ``min(struct(order..., rest...))`` per digest of the keys,
    combined map-side, so a text repeated across a third of the corpus leaves
    each map task as one row, and rows are sorted and dealt out by 16 bytes
    whatever the keys' length.  ``order`` should be unique; otherwise ties fall
    to the remaining columns, still deterministically (``dropDuplicates`` keeps
    an arbitrary row).  The keys, the same in a whole group, stand beside the struct:
    a text that the caller does not use afterwards is neither sorted nor moved.
    """
    keys, order = list(keys), list(order)
    same = [c for c in keys if c not in order]
    rest = [c for c in df.columns if c not in order and c not in same]
    first = F.min(F.struct(*[F.col(c) for c in order + rest])).alias("_w")
    agg = df.groupBy(digest(*keys).alias("_key")).agg(first, *[F.first(c).alias(f"_k_{c}") for c in same])
    return agg.select(*[F.col(f"_k_{c}" if c in same else f"_w.{c}").alias(c) for c in df.columns])


def dedup_cascade(df: DataFrame, text: str = "section_txt", label: str = "label",
                  order: Sequence[str] = ("pub_order", "pos")) -> DataFrame:
    """Three dedups in a row (file, text, mention, label) -> (text, mention, label)
    -> (text, label) keep exactly the first row of each (text, label) group,
    because that row is also first in every finer group; so one pass does it."""
    return dedup_keep_first(df, [text, label], order)


def first_per_mention(df: DataFrame, col: str = "dataset", order: Sequence[str] = ("row_id",)) -> DataFrame:
    return dedup_keep_first(df, [col], order)


def clean_funnel(df: DataFrame, text: str = "section_txt", gt: int = 20,
                 file_col: str = "file_id", mention: str = "dataset", label: str = "label") -> DataFrame:
    """Row counts after every cleaning step, in one aggregation pass.

    The counts after each dedup step are distinct counts of that step's key
    over the length-filtered rows (a dedup cascade keeps one row per key); the
    text takes part as its digest, computed once.
    """
    df = df.select(file_col, mention, label, (F.length(text) > gt).alias("_long"), digest(text).alias("_text"))
    long_, text = F.col("_long"), "_text"

    def on_long(*cols):
        return F.when(long_, F.struct(*[F.col(c) for c in cols]))

    return df.agg(
        F.count("*").cast("bigint").alias("n_labelled"),
        F.count_if(long_).cast("bigint").alias("n_long"),
        F.count_distinct(on_long(file_col, text, mention, label)).cast("bigint").alias("n_dedup_file"),
        F.count_distinct(on_long(text, mention, label)).cast("bigint").alias("n_dedup_mention"),
        F.count_distinct(on_long(text, label)).cast("bigint").alias("n_dedup_text"),
    )
