"""Mixing sources to target weights by capped water-filling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.llm.common import word_count, written
from textlab.operators.indexing import assign_row_id
from textlab.operators.joins import broadcast_if_small

#: hash bits of the seeded order of a source's documents
HASH_BITS = 60


def seeded_hash(seed: str, key: Column) -> Column:
    """60-bit hash of (seed, key), the same on every run and in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 15),
                  16, 10).cast("long")


def source_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights dealt in turn over the sources by code point, null last. One row per source."""
    at = assign_row_id(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_at").drop("_null")
    return at.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in cycle]),
                                                (F.col("_at") % len(cycle) + 1).cast("int")).cast("long")).drop("_at")


def water_fill(sources: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): shares of the total size by weight; a source
    whose share is above ``max_epochs`` times its size is clamped there and the rest is shared again
    by weight, until no share is above. Each pass is one aggregate over the table of sources."""
    s = sources.withColumn("cap", F.col("source_size") * max_epochs).withColumn("clamped", F.lit(False))
    total = int(s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    while True:
        free = ~F.col("clamped")
        capped, weight = s.agg(F.coalesce(F.sum(F.when(~free, F.col("cap"))), F.lit(0)),
                               F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0))).first()
        rest, weight = total - int(capped), int(weight)
        if not weight:
            break
        above = free & (F.col("weight").cast("decimal(18,0)") * F.lit(rest).cast("decimal(20,0)")
                        > F.col("cap").cast("decimal(20,0)") * F.lit(weight).cast("decimal(18,0)"))
        if not s.filter(above).limit(1).count():
            break
        s = written(s.withColumn("clamped", F.col("clamped") | above), "fill")
    share = F.lit(float(rest)) * F.col("weight").cast("double") / F.lit(float(weight or 1))
    return s.withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(share)).drop("cap", "clamped")


def _taken(docs: DataFrame, seed: str, max_epochs: int, cycle: tuple[int, ...]) -> DataFrame:
    """Rows of ``docs`` with __size, __source_size, __target and __taken.

    What a document gives follows from its own hash and its source's line in the plan, a small table. Only in
    the bucket with a source's cut (about the square root of all rows) documents are put in order, text and all, so
    that nothing has to be joined to the documents but the plan."""
    sized = written(docs.select("doc_id", "source", word_count("text").alias("size"),
                                seeded_hash(seed, F.col("doc_id")).alias("h")), "sized")
    bits = max(1, sized.count().bit_length() // 2)
    sums = sized.groupBy("source", F.shiftright("h", HASH_BITS - bits).alias("bucket")).agg(F.sum("size").alias("size"))
    sums = written(sums, "sums")
    sources = written(source_weights(sums.groupBy("source").agg(F.sum("size").alias("source_size")), cycle), "sources")
    plan = water_fill(sources, max_epochs).withColumn("words", F.floor("target").cast("long"))
    plan = (plan.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(F.lit(0)))
            .withColumn("rest", F.col("words") - F.col("whole") * F.col("source_size")))
    before = F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket")
                                           .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = (sums.withColumn("before", before).withColumnRenamed("source", "_s")
           .join(plan.select(F.col("source").alias("_p"), "rest"), F.col("_s").eqNullSafe(F.col("_p")))
           .filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("size")))
           .select(F.col("_s"), F.col("bucket").alias("cut"), (F.col("rest") - F.col("before")).alias("left")))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left")
    plan, _ = broadcast_if_small(plan.select(
        F.col("source").alias("__s"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"),
        F.col("whole").alias("__whole"), F.col("cut").alias("__cut"), F.col("left").alias("__left")), max_bytes=8 << 20)
    h = seeded_hash(seed, F.col("doc_id"))
    d = docs.join(plan, docs["source"].eqNullSafe(plan["__s"])).withColumn("__h", h).withColumn("__bucket", F.shiftright("__h", HASH_BITS - bits))
    at_cut = F.coalesce(F.col("__bucket") == F.col("__cut"), F.lit(False))  # without a cut bucket nothing of the source is left over
    inside = d.filter(at_cut).withColumn("__size", word_count("text"))
    up_to = F.coalesce(F.sum("__size").over(Window.partitionBy("__s").orderBy("__h", "doc_id", "__size")
                                            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = inside.withColumn("__extra", F.greatest(F.lit(0), F.least(F.col("__size"), F.col("__left") - up_to)))
    outside = d.filter(~at_cut).withColumn("__size", word_count("text"))
    outside = outside.withColumn("__extra", F.when(F.col("__bucket") < F.col("__cut"), F.col("__size")).otherwise(F.lit(0)))
    out = inside.unionByName(outside).withColumn("__taken", (F.col("__whole") * F.col("__size") + F.col("__extra")).cast("long"))
    return out.drop("__s", "__whole", "__cut", "__left", "__h", "__bucket", "__extra")


def mix(docs: DataFrame, seed: str = "mix", max_epochs: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """For each row of (doc_id, text, source): size in words, its source's size and target, and ``taken``,
    the words that the mix takes of it: ``taken // size`` whole repetitions, and the leading
    ``taken % size`` words as the last, fractional one.

    Every document of a source is repeated whole as often as the target holds the whole source; the
    rest is taken in the order of a seeded hash, the last document in part, so that a source's taken
    words add up to its target rounded down. To find that cut no source is sorted whole: sizes are
    summed by the leading bits of the hash, and only the documents of the one bucket with the cut are
    put in order (about the square root of all rows).

    Nulls: a null source is a source of its own, a null text has size 0 and takes nothing, a null doc_id
    hashes as the empty string. Repeated rows count one by one; among equal ones it does not matter
    which is cut. Empty tables give no rows. Other columns of ``docs`` are not read.
    """
    out = _taken(docs.select("doc_id", "text", "source"), seed, max_epochs, cycle)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
                      F.col("__target").alias("target"), F.col("__taken").alias("taken"), "source")


def mixture(docs: DataFrame, seed: str = "mix", max_epochs: int = 3, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: rows of ``docs`` (same columns) as ``mix`` takes them, each whole repetition one row and
    the fractional one a row with the leading words of the text. Column names that begin with two underscores are taken."""
    d = _taken(docs, seed, max_epochs, cycle)
    n, rest = F.expr("__taken div __size"), F.expr("__taken % __size")
    # 0 stands for the fractional repetition
    which = F.concat(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>")),
                     F.when(rest > 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<long>")))
    d = d.filter("__taken > 0").withColumn("__k", F.explode(which))
    head = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), rest.cast("string"), F.lit("}+"))
    text = F.when(F.col("__k") == 0, F.regexp_substr("text", head)).otherwise(F.col("text"))
    return d.withColumn("text", text).select(*docs.columns)
