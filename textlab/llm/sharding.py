"""Sharding by extendible hashing: a directory over hash-prefix bits in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import text_key, written
from textlab.llm.mixing import HASH_BITS, seeded_hash

#: bits that one pass looks ahead
STEP = 6


def assign_shards(docs: DataFrame, limit_bytes: int, seed: str = "shard") -> DataFrame:
    """One row per row of (doc_id, text): doc_id, k (the text's key), bytes, shard (its hash prefix, as
    bits), depth, shard_bytes and shard_docs.

    The directory starts as one bucket. A bucket whose texts exceed ``limit_bytes`` splits on the next
    bit of the documents' hash, and only those: each pass sums the open buckets by the next STEP bits,
    finds the first bit at which each part fits, and hands the parts that still do not to the next pass.
    Texts themselves are read once, for their size.

    A document's hash is of its doc_id and its text, so that texts which share an id, or have none, are dealt out like others.
    Nulls: a null text has 0 bytes and counts as an empty one, a null doc_id hashes as the empty string. Only rows equal in both hash
    alike and stay together; a bucket of one hash cannot split, so a shard above the limit holds copies of one
    row (all 60 bits). Empty tables give no rows. Other columns are not read.
    """
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    rest = written(docs.select("doc_id", text_key().alias("k"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
                               seeded_hash(seed, key).alias("h")), "sizes")
    out, at = None, 0
    while at < HASH_BITS:
        # the root itself is a bucket of the first pass
        levels = F.sequence(F.lit(0 if at == 0 else 1), F.lit(STEP))
        cell = F.shiftright("h", HASH_BITS - at - STEP)
        cells = rest.groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
        cells = written(cells, "cells")
        nodes = (cells.withColumn("up", F.explode(levels)).withColumn("node", F.expr(f"shiftright(cell, {STEP} - up)"))
                 .groupBy("up", "node").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")))
        last = at + STEP >= HASH_BITS
        fits = F.col("shard_bytes") <= limit_bytes
        if last:
            fits = fits | (F.col("up") == STEP)
        leaf = (cells.select("cell", F.explode(levels).alias("up")).withColumn("node", F.expr(f"shiftright(cell, {STEP} - up)"))
                .join(nodes.filter(fits), ["up", "node"]).groupBy("cell")
                .agg(F.min(F.struct("up", "node", "shard_bytes", "shard_docs")).alias("leaf")))
        leaf = leaf.select(F.col("cell").alias("_cell"), (F.lit(at) + F.col("leaf.up")).cast("int").alias("depth"), F.col("leaf.node").alias("node"),
                           "leaf.shard_bytes", "leaf.shard_docs")
        done = rest.join(leaf, cell == F.col("_cell"), "left").drop("_cell")
        done = written(done, "assigned")
        part = done.filter("depth is not null").withColumn("shard", F.expr("lpad(bin(node), depth, '0')")) \
            .select("doc_id", "k", "bytes", "shard", "depth", "shard_bytes", "shard_docs")
        out = part if out is None else out.unionByName(part)
        rest = done.filter("depth is null").select("doc_id", "k", "bytes", "h")
        if not rest.limit(1).count():
            break
        at += STEP
    return out


def write_shards(docs: DataFrame, assigned: DataFrame, path: str) -> None:
    """The documents as Parquet under ``path``, one folder for each shard. A shard is written by one
    task; its size is bounded by the limit it was made for."""
    d = docs.drop("shard")
    a = assigned.select(F.col("doc_id").alias("__id"), F.col("k").alias("__k"), F.concat(F.lit("b"), F.col("shard")).alias("shard")).distinct()
    rows = d.join(a, d["doc_id"].eqNullSafe(a["__id"]) & (text_key(d["text"]) == a["__k"])).drop("__id", "__k")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
