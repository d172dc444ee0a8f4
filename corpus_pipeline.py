"""A training corpus from raw documents: filter by quality, drop near duplicates and leaked benchmark
passages, mix the sources, and deal the result out to shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``docs``, whatever else these hold. Between stages the documents are written as Parquet and read again. Columns may have any names but ones that begin with two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textlab.llm import decontaminate, mixing, near_dedup, quality, sharding
from textlab.llm.common import table, text_key, written
from textlab.operators.indexing import assign_row_id
from textlab.operators.joins import broadcast_if_small

#: score from which a document stays, bytes of text in a shard, and bytes of a side that may be broadcast
KEEP_FROM, SHARD_BYTES, SMALL = 0.3, 1 << 20, 8 << 20


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, text) is not in ``gone`` (doc_id, k)."""
    gone, _ = broadcast_if_small(gone.select(F.col("doc_id").alias("__gone"), F.col("k").alias("__gone_k")).distinct(), SMALL)
    same = docs["doc_id"].eqNullSafe(gone["__gone"]) & (text_key(docs["text"]) == gone["__gone_k"])
    return docs.join(gone, same, "left_anti")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores KEEP_FROM or higher; it learns from the labels of those
    documents that are still there."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.good(docs, model, KEEP_FROM)


def _copy() -> Column:
    """With doc_id, what rows may repeat: the id alone, or the text of a row without one."""
    return F.when(F.col("doc_id").isNull(), text_key())


def _repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, copy) of more than one row, with the smallest and the largest text key."""
    keys = docs.select("doc_id", _copy().alias("copy"), text_key().alias("k")).groupBy("doc_id", "copy")
    return written(keys.agg(F.count("*").alias("n"), F.min("k").alias("least"), F.max("k").alias("most")).filter("n > 1"), "twice")


def _linked_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, k) of the texts linked to one that stays, where a doc_id may have several texts: each
    text is a node of its own, numbered by (doc_id, k)."""
    texts = docs.filter("doc_id is not null").select("doc_id", text_key().alias("k")).distinct()
    nodes = written(assign_row_id(texts, ["doc_id", "k"], "node"), "nodes")
    of = nodes.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), "node")
    alone = docs.select("doc_id", "text").join(of, (F.col("doc_id") == F.col("_d")) & (text_key() == F.col("_k")))
    found = near_dedup.near_duplicates(alone.select(F.col("node").alias("doc_id"), "text"))
    gone = found.filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return nodes.join(gone, F.col("node") == F.col("_gone")).select("doc_id", "k")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. Of the texts of
    one doc_id only those go that are linked to a kept one; of the rows that still repeat a doc_id one
    stays, with the smallest text key. Of exact copies without a doc_id one stays."""
    twice = _repeated(docs)
    if twice.filter("least <> most").isEmpty():  # a text for each doc_id
        groups = near_dedup.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("__gone")).distinct()
        gone, _ = broadcast_if_small(groups, SMALL)
        rest = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    else:
        rest = written(_without(docs, _linked_texts(docs)), "rest")
        twice = _repeated(rest)
    again, _ = broadcast_if_small(twice.select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy"), F.col("least").alias("__least")), SMALL)
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & _copy().eqNullSafe(F.col("__copy"))
    once = rest.join(again, same, "left_anti")
    first = rest.join(again, same & (text_key() == F.col("__least"))).dropDuplicates(["doc_id", "__copy"])
    return once.unionByName(first.drop("__id", "__copy", "__least"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs. A document with one is dropped whole: what stands
    around a leaked passage often leaks with it."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter(F.size("spans") > 0))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated whole, or left out, as the mix takes them;
    the document at a source's cut is a row with its leading words."""
    return mixing.mixture(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document of the mix: doc_id, bytes, shard, depth, shard_bytes, shard_docs."""
    return sharding.assign_shards(docs, SHARD_BYTES).drop("k")


STAGES = [
    ("quality", quality_filter),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]

#: the classifier is fitted and near duplicates are reached transitively: no SQL for the rows as a whole
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
