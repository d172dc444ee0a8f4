"""Registered queries of the training-data operators, with their DuckDB oracles."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from textlab.llm import chat, decontaminate, licenses, line_dedup, mixing, near_dedup, pii, quality, runs, sharding, spelling, suffix_dedup, topk
from textlab.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _importable(spark: SparkSession) -> None:
    """Lets Python workers that share this file system import the package, whatever their folder;
    elsewhere it comes with spark-submit's --py-files."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def query(fn=None, *, sql: str | None = None):
    def deco(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            _importable(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return run
    return deco(fn) if fn else deco


@query(sql=r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::HUGEINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * source_size::DOUBLE / weight, source NULLS LAST) - 1 AS k FROM w),
t AS (SELECT *, sum(source_size) OVER ()
              - coalesce(sum(3 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM o),
f AS (SELECT k, rest, free FROM t WHERE weight * rest <= 3 * source_size * free ORDER BY k LIMIT 1),
g AS (SELECT t.source, t.source_size::BIGINT AS source_size,
             CASE WHEN t.k < f.k THEN (3 * t.source_size)::DOUBLE
                  ELSE f.rest::DOUBLE * t.weight::DOUBLE / f.free::DOUBLE END AS target
      FROM t, f),
p AS (SELECT *, floor(target)::BIGINT AS words,
             CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS whole FROM g),
c AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.words - p.whole * p.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM c""")
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capped water-filling over all documents: sources weigh 1, 2, 3 in turn, at most 3 epochs."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents; the smallest doc_id of each is kept."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents: fixed forms and what bootstrapped contexts add."""
    return pii.digests(pii.find_personal_data(table(spark, sf_dir, "documents")))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat 100 bytes found earlier, and what remains."""
    return suffix_dedup.removed(table(spark, sf_dir, "documents")).drop("kept")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words in all documents, by FM-indexes of training shards."""
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query(sql=r"""
WITH v AS (
  SELECT vec_id, [floor(x::DOUBLE * 256) for x in embedding] AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.z, c.z)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.z) = len(c.z) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all embeddings for every fiftieth, by an impact-ordered index."""
    return topk.search(table(spark, sf_dir, "embeddings"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by weighted tree rules over their statistics."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(sql=r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(strlen(text), 0)::BIGINT AS bytes,
         ('0x' || substr(md5('shard:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
l AS (SELECT range AS depth FROM range(61)),
n AS (SELECT depth, h >> (60 - depth) AS node, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM d, l GROUP BY ALL),
f AS (SELECT r, min(depth) AS depth FROM d, l JOIN n USING (depth) WHERE n.node = d.h >> (60 - l.depth)
      AND (shard_bytes <= 1048576 OR depth = 60) GROUP BY r)
SELECT doc_id, bytes, CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(h >> (60 - f.depth)), f.depth::INTEGER, '0') END AS shard,
       f.depth::INTEGER AS depth, shard_bytes, shard_docs
FROM d JOIN f USING (r) JOIN n ON n.depth = f.depth AND n.node = d.h >> (60 - f.depth)""")
def op3_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text over all documents."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 1 << 20).drop("k")


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks of all documents, and what remains."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).drop("kept")


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered roles and canonical form of all turns of all conversations."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query
def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of all documents (a tenth of them made to repeat), by a Re-Pair grammar."""
    return runs.digests(runs.find_runs(runs.looped(table(spark, sf_dir, "documents"))))


def _values(templates) -> str:
    return ", ".join(f"({i}, '{label}', {str(phrase).lower()}, '{text}')" for i, (label, text, phrase) in enumerate(templates))


@query(sql=rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
t0 AS (SELECT *, string_split(text, ' ') AS w
       FROM (VALUES {_values([(*x, True) for x in licenses.PHRASES] + [(*x, False) for x in licenses.NOTICES])}) v(template, label, phrase, text)),
t AS (SELECT *, len(w) AS size, CASE WHEN phrase THEN len(w) ELSE least(4, len(w)) END AS k FROM t0),
g AS (SELECT template, label, phrase, size, k, tpos, array_to_string(w[tpos + 1:tpos + k], ' ') AS gram
      FROM (SELECT *, unnest(range(0, size - k + 1)) AS tpos FROM t)),
p AS (SELECT r, w, unnest(range(0, len(w))) AS pos FROM d),
h AS (SELECT r, template, label, phrase, size, k, pos, tpos, pos - tpos AS diagonal
      FROM (SELECT r, pos, array_to_string(w[pos + 1:pos + 2], ' ') AS gram FROM p
            UNION SELECT r, pos, array_to_string(w[pos + 1:pos + 4], ' ') FROM p) JOIN g USING (gram)),
o AS (SELECT DISTINCT r, template, phrase, diagonal FROM h),
n AS (SELECT *, CASE WHEN phrase OR coalesce(diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > 3, true)
                     THEN 1 ELSE 0 END AS fresh FROM o),
m AS (SELECT r, template, diagonal, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS grp FROM n),
s AS (SELECT r, label, phrase, min(pos) AS start, count(DISTINCT tpos + j)::DOUBLE / max(size)::DOUBLE AS share
      FROM (SELECT h.*, m.grp, unnest(range(0, h.k)) AS j FROM h JOIN m USING (r, template, diagonal)) GROUP BY r, template, label, phrase, grp)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(count(*) FILTER (WHERE phrase), 0)::BIGINT AS n_base,
       min(start) FILTER (WHERE phrase) AS first_word, max(start) FILTER (WHERE phrase) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE phrase), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE share >= 0.7), '') AS labels, coalesce(max(share), 0) AS score
FROM d LEFT JOIN s USING (r) GROUP BY d.r, d.doc_id, d.w""")
def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in all documents, by votes for diagonals."""
    return licenses.digests(licenses.find_licenses(table(spark, sf_dir, "documents")))


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of all documents with each word's more frequent near word and the root of its chain."""
    return spelling.variants(table(spark, sf_dir, "documents"), typo_of=31)


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by way of all stages of the corpus pipeline: the shards of the final mix."""
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
