"""Paragraphs with stacked span annotations -> labelled paragraphs, QA records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.functions.text import extract_spans, mask_mentions
from textlab.operators.indexing import assign_row_id

MENTION_CODE = 3  # fixed value: span label code of a dataset mention


def _zipped(starts: str, ends: str, labels: str):
    return F.arrays_zip(F.col(starts).alias("s"), F.col(ends).alias("e"), F.col(labels).alias("l"))


def explode_mentions(df: DataFrame, text: str = "text", starts: str = "stacked_start",
                     ends: str = "stacked_end", labels: str = "stacked_label",
                     code: int = MENTION_CODE) -> DataFrame:
    """One row per span with ``code`` (label 1, the span text as ``dataset``);
    a paragraph without such a span gives one row with label 0 and ''.
    Adds ``span_no`` (0-based among the paragraph's mention spans, null for negatives)."""
    hits = F.filter(_zipped(starts, ends, labels), lambda x: x["l"] == code)
    d = df.select("*", F.posexplode_outer(hits).alias("span_no", "_x"))
    mention = F.substring(F.col(text), F.col("_x.s") + 1, F.col("_x.e") - F.col("_x.s"))
    return (d.withColumn("label", F.when(F.col("_x").isNull(), F.lit(0)).otherwise(F.lit(1)))
            .withColumn("dataset", F.when(F.col("_x").isNull(), F.lit("")).otherwise(mention))
            .drop("_x"))


def span_texts(df: DataFrame, text: str = "text", starts: str = "stacked_start", ends: str = "stacked_end",
               out: str = "spans") -> DataFrame:
    return df.withColumn(out, extract_spans(F.col(text), F.col(starts), F.col(ends)))


def mention_spans(df: DataFrame, text: str = "text", starts: str = "stacked_start",
                  ends: str = "stacked_end", labels: str = "stacked_label", code: int = MENTION_CODE,
                  out: str = "mentions") -> DataFrame:
    hits = F.filter(_zipped(starts, ends, labels), lambda x: x["l"] == code)
    return df.withColumn(out, F.transform(hits, lambda x: F.substring(F.col(text), x["s"] + 1, x["e"] - x["s"])))


def span_corpus_stats(exploded: DataFrame, label: str = "label") -> DataFrame:
    """Rows of the exploded corpus, positive rows (mentions), negative rows."""
    return exploded.agg(F.count("*").cast("bigint").alias("n_rows"),
                        F.count_if(F.col(label) == 1).cast("bigint").alias("n_pos"),
                        F.count_if(F.col(label) == 0).cast("bigint").alias("n_neg"))


def union_folds(folds: DataFrame, split: str = "train", col: str = "split") -> DataFrame:
    """The rows of one split of every fold, one frame (folds are a partition column, so a filter on
    the split reads only its folders)."""
    return folds.filter(F.col(col) == split).drop(col)


def qa_records(df: DataFrame, order=("file_id", "pos"), text: str = "text", starts: str = "stacked_start",
               ends: str = "stacked_end", labels: str = "stacked_label", code: int = MENTION_CODE) -> DataFrame:
    """One question-answering record per mention span:
    ``(id, context, question, answers{text[], answer_start[]}, label, masked_context)``.
    ``id`` counts the spans from 1 in ``order`` (unique per paragraph) and span order; only the order
    key is numbered, texts meet their numbers in one join."""
    m = mention_spans(df, text, starts, ends, labels, code, "_m")
    hits = F.filter(_zipped(starts, ends, labels), lambda x: x["l"] == code)
    order = list(order)
    d = m.select("*", F.posexplode(hits).alias("_k", "_x"))
    ids = assign_row_id(df.select(*order, F.posexplode(hits).alias("_k", "_x")).drop("_x"), [*order, "_k"], "_id")
    d = d.join(ids, [*order, "_k"])
    span = F.substring(F.col(text), F.col("_x.s") + 1, F.col("_x.e") - F.col("_x.s"))
    return d.select(
        (F.col("_id") + 1).cast("string").alias("id"),
        F.col(text).alias("context"), F.lit("").alias("question"),
        F.struct(F.array(span).alias("text"), F.array(F.col("_x.s")).alias("answer_start")).alias("answers"),
        F.lit(0).alias("label"),
        mask_mentions(F.col(text), F.col("_m")).alias("masked_context"),
        F.col("_k").alias("span_no"))
