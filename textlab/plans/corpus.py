"""Stage compositions that build labelled corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.operators import cleaning, labeling

LABELLED_COLUMNS = ["file_id", "publication_name", "section_title", "dataset", "label", "section_txt"]


def label_corpus(annotations: DataFrame, sections: DataFrame, min_chars: int = 5, gt: int = 20,
                 keep_order: bool = False, max_broadcast_bytes: int | None = None,
                 id_col: str = "id", title_col: str = "pub_title", mention_cols=("mention",),
                 order_col: str = "row_no") -> DataFrame:
    """The whole first stage: publications -> labelled sections -> cleaned, deduplicated rows.

    Plan: aggregate annotations by id (shuffle of the small side), broadcast
    it when its measured size allows, label each section inside its row,
    filter by length before anything shuffles, then one map-side-combined
    aggregate keeps the first row of each (text, label).
    """
    pubs = labeling.build_publications(annotations, id_col, title_col, mention_cols, order_col)
    secs = cleaning.skip_tiny_sections(sections, "section_txt", min_chars)
    secs = cleaning.min_length_filter(secs, "section_txt", gt)
    labelled = labeling.label_sections(secs, pubs, max_broadcast_bytes=max_broadcast_bytes)
    cols = LABELLED_COLUMNS + (["pub_order", "pos"] if keep_order else [])
    deduped = cleaning.dedup_cascade(labelled.select(*(LABELLED_COLUMNS + ["pub_order", "pos"])))
    return deduped.select(*cols)


def labelled_with_funnel(annotations: DataFrame, sections: DataFrame, min_chars: int = 5,
                         max_broadcast_bytes: int | None = None) -> DataFrame:
    """Labelled sections before any length filter or dedup (input of ``clean_funnel``)."""
    pubs = labeling.build_publications(annotations)
    secs = cleaning.skip_tiny_sections(sections, "section_txt", min_chars)
    return labeling.label_sections(secs, pubs, max_broadcast_bytes=max_broadcast_bytes)


def span_corpus(folds: DataFrame, split: str = "train", order=("fold", "file_id", "pos", "span_no"),
                text: str = "text") -> DataFrame:
    """Second-corpus stage: train rows of every fold (a partition-pruned scan) ->
    one row per mention span -> drop null text -> keep the first row of each
    (text, label)."""
    from textlab.operators import spans as sp
    rows = folds.filter(F.col("split") == split)
    ex = sp.explode_mentions(rows, text=text).withColumnRenamed(text, "section_txt")
    ex = cleaning.drop_null_text(ex, "section_txt")
    ex = ex.withColumn("span_no", F.coalesce("span_no", F.lit(-1)))
    keep = ["id", "section_txt", "label", "dataset", *order]
    return cleaning.dedup_keep_first(ex.select(*dict.fromkeys(keep)), ["section_txt", "label"], list(order))
