"""Licence notices in texts by diagonal voting (DataFrame functions only).

All rolling word sequences of a text meet those of the templates in a join on their hashes. A hit at word p of the
text and word t of a template votes for the diagonal p - t; a notice that was copied whole puts all its votes
on one, and each word that was put in or left out moves the rest to a neighbouring one. Neighbouring diagonals are merged
into spans, and a span is a notice if enough of the template's words stand in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from textlab.llm.common import text_key, written

#: words of lower-cased texts
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: words of a sequence (a shorter template is one), how far apart neighbouring diagonals are, and the share of a template's words
#: that makes a span a notice
GRAM, DRIFT, SHARE = 4, 3, 0.7

# Phrases that stand for a licence wherever their words follow each other.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Passages of the licences' own notices.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _gram(words: Column, at: Column, k: int) -> Column:
    """Hash of the k words from ``at`` on."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def template_grams(spark: SparkSession, phrases=PHRASES, notices=NOTICES, gram: int = GRAM) -> DataFrame:
    """(template, label, phrase, size, k, tpos, h, gram): the word sequences of all templates, their hashes and places."""
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(i < len(phrases)).alias("phrase"), F.lit(text).alias("text"))
            for i, (label, text) in enumerate([*phrases, *notices])]
    t = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.template", "t.label", "t.phrase", _words(F.col("t.text")).alias("w"))
    t = t.withColumn("size", F.size("w")).filter("size > 0").withColumn("k", F.when(F.col("phrase"), F.col("size")).otherwise(F.least("size", F.lit(gram))))
    t = t.withColumn("tpos", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k")))).withColumn("gram", F.slice("w", F.col("tpos") + 1, F.col("k")))
    sizes = sorted({min(gram, len(x.split())) for _, x in notices} | {len(x.split()) for _, x in phrases})
    h = F.coalesce(*[F.when(F.col("k") == k, _gram(F.col("gram"), F.lit(0), k)) for k in sizes])
    return t.select("template", "label", "phrase", "size", "k", "tpos", h.alias("h"), "gram")


def hits(docs: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, key, n_words, pos, template, label, phrase, size, k, tpos): every word sequence of the texts that is one of a
    template's, and for each row of ``docs`` a line without a template."""
    d = docs.select("doc_id", text_key().alias("key"), _words(F.col("text")).alias("w"))
    # the outer form: for the other one Spark puts a filter in front that finds all words once more
    d = d.select("doc_id", "key", "w", F.posexplode_outer("w").alias("pos", "_"))
    d = d.select("doc_id", "key", "w", "pos", F.posexplode(F.array(*[_gram(F.col("w"), F.col("pos"), k) for k in sizes], F.lit(None).cast("long"))).alias("_i", "_h"))
    d = d.filter((F.col("_i") < len(sizes)) | (F.coalesce("pos", F.lit(0)) == 0))
    # the templates are a parameter: a few sequences for each of their words, whatever the number of texts
    hit = d.join(F.broadcast(grams), (F.col("_h") == F.col("h")) & (F.slice("w", F.col("pos") + 1, F.col("k")) == F.col("gram")), "left")
    hit = hit.filter(F.col("template").isNotNull() | (F.col("_i") == len(sizes)))
    n = F.greatest(F.coalesce(F.size("w"), F.lit(0)), F.lit(0)).cast("long")
    return hit.select("doc_id", "key", n.alias("n_words"), "pos", "template", "label", "phrase", "size", "k", "tpos")


def diagonals(hit: DataFrame) -> DataFrame:
    """(doc_id, key, template, label, phrase, size, k, diagonal, votes): the template places hit on each diagonal."""
    return (hit.withColumn("diagonal", F.col("pos") - F.col("tpos"))
            .groupBy("doc_id", "key", "template", "label", "phrase", "size", "k", "diagonal").agg(F.collect_set("tpos").alias("votes")))


def spans(diagonal: DataFrame, drift: int = DRIFT) -> DataFrame:
    """(doc_id, key, label, phrase, start, end, share): neighbouring diagonals of one template merged, from the first to
    the last word hit, with the share of the template's words that stand there. A phrase's diagonals are spans of their own."""
    w = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal")
    apart = F.col("phrase") | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > drift, F.lit(True))
    d = diagonal.withColumn("_g", F.sum(apart.cast("int")).over(w))
    g = d.groupBy("doc_id", "key", "template", "label", "phrase", "size", "k", "_g").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("votes")))).alias("t"),
        F.min(F.col("diagonal") + F.array_min("votes")).alias("start"), F.max(F.col("diagonal") + F.array_max("votes") + F.col("k")).alias("end"))
    steps = F.zip_with(F.slice("t", F.lit(2), F.size("t") - 1), F.slice("t", F.lit(1), F.size("t") - 1), lambda b, a: b - a)
    hit = F.col("k") + F.aggregate(steps, F.lit(0), lambda s, x: s + F.least(x, F.element_at(F.array("k"), 1)))
    return g.select("doc_id", "key", "label", "phrase", "start", "end", (hit.cast("double") / F.col("size").cast("double")).alias("share"))


def find_licenses(docs: DataFrame, phrases=PHRASES, notices=NOTICES, gram: int = GRAM, drift: int = DRIFT, share: float = SHARE) -> DataFrame:
    """For each row of (doc_id, text): doc_id, n_words, and found, an array of (start, end, label, phrase, share) in words:
    all places of phrases, and spans that hold any sequence of ``gram`` words of a notice; those with ``share`` of its words
    or more are notices.

    A-Z are lower-cased; words are runs of ASCII letters, digits and anything beyond ASCII. Null and empty texts have no words
    and nothing found. Rows with a null doc_id are judged like others; rows that repeat (doc_id, text) are each
    returned with all that is found in one. Other columns are not read; empty tables give no rows.
    """
    grams = template_grams(docs.sparkSession, phrases, notices, gram)
    sizes = sorted({min(gram, len(x.split())) for _, x in notices} | {len(x.split()) for _, x in phrases})
    every = written(hits(docs, grams, sizes), "hits")
    found = spans(diagonals(every.filter("template is not null")), drift)
    found = found.groupBy(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "phrase", "share"))).alias("found"))
    rows = every.filter("template is null").select("doc_id", F.col("key").alias("_key"), "n_words")
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    none = F.array().cast("array<struct<start:int,end:int,label:string,phrase:boolean,share:double>>")
    return out.select("doc_id", "n_words", F.coalesce("found", none).alias("found"))


def digests(found: DataFrame, share: float = SHARE) -> DataFrame:
    """The contract's columns of ``find_licenses``: phrases counted, labels with and without those of notices, and the best share."""
    base = F.filter("found", lambda f: f["phrase"])
    good = F.filter("found", lambda f: f["share"] >= share)

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda f: f["label"]))), ",")

    start = F.transform(base, lambda f: f["start"].cast("long"))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(start).alias("first_word"),
                        F.array_max(start).alias("last_word"), labels(base).alias("base_labels"), labels(good).alias("labels"),
                        F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)).alias("score"))
