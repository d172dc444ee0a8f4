"""Queries: span corpus (survey 2.1 read_folds/union_folds, 2.2 has_span_label, 2.4 span stats,
2.9 extract_spans/explode_mentions/qa_records/mask_mentions, M9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.catalog.common import longs, sql_hash, with_ctes
from textlab.operators import cleaning, indexing, sampling, spans
from textlab.plans import corpus
from textlab.registry import query
from textlab.session import written
from textlab.sources import fixtures as fx

EXPLODED_SQL = """exploded AS (
  SELECT s.id, s.file_id, s.pos, s.text,
         CASE WHEN m.k IS NULL THEN 0 ELSE 1 END AS label,
         CASE WHEN m.k IS NULL THEN '' ELSE substring(s.text, m.st + 1, m.en - m.st) END AS dataset,
         m.k AS span_no
  FROM spans s LEFT JOIN (
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k, st, en FROM (
      SELECT id, unnest(range(3)) AS i, unnest(stacked_start) AS st, unnest(stacked_end) AS en,
             unnest(stacked_label) AS lb FROM spans) WHERE lb = 3) m USING (id))"""


@query("has_span_label", with_ctes("spans") + """
SELECT id, list_contains(stacked_label, 3)::BIGINT AS has_mention FROM spans""")
def q_has_span(spark, sf_dir):
    return longs(fx.spans(spark, sf_dir).select("id", cleaning.has_span_label().alias("has_mention")))


@query("extract_spans", with_ctes("spans") + """
SELECT id, substring(text, 1, 4) || '|' || substring(text, 6, 4) || '|' || substring(text, 11, 10) AS spans
FROM spans""")
def q_extract(spark, sf_dir):
    s = spans.span_texts(fx.spans(spark, sf_dir))
    return s.select("id", F.array_join("spans", "|").alias("spans"))


@query("explode_mentions", with_ctes("spans", extra=EXPLODED_SQL) + """
SELECT id, label::BIGINT AS label, dataset, span_no::BIGINT AS span_no FROM exploded""")
def q_explode(spark, sf_dir):
    return longs(spans.explode_mentions(fx.spans(spark, sf_dir)).select("id", "label", "dataset", "span_no"))


@query("span_corpus_stats", with_ctes("spans", extra=EXPLODED_SQL) + """
SELECT count(*)::BIGINT AS n_rows, count(*) FILTER (WHERE label = 1)::BIGINT AS n_pos,
       count(*) FILTER (WHERE label = 0)::BIGINT AS n_neg FROM exploded""")
def q_span_stats(spark, sf_dir):
    return spans.span_corpus_stats(spans.explode_mentions(fx.spans(spark, sf_dir)))


def _masked_sql(names: str) -> str:
    """(id, masked): texts of ``named`` (id, text, names) without the characters that any occurrence of a name covers."""
    return f"""named AS ({names}),
starts AS (SELECT id, i, length(m) AS n FROM (SELECT id, text, m, unnest(range(1, length(text) - length(m) + 2)) AS i
                                              FROM (SELECT id, text, unnest(list_distinct(names)) AS m FROM named) WHERE length(m) > 0) WHERE substring(text, i, length(m)) = m),
covered AS (SELECT DISTINCT id, unnest(range(i, i + n)) AS i FROM starts),
chars AS (SELECT id, unnest(range(1, length(text) + 1)) AS i, text FROM named),
masked AS (SELECT n.id, coalesce(k.t, '') AS masked FROM named n LEFT JOIN (
  SELECT id, string_agg(substring(text, i, 1), '' ORDER BY i) AS t FROM chars ANTI JOIN covered USING (id, i) GROUP BY id) k USING (id))"""


@query("mask_mentions", with_ctes("spans") + ",\n" + _masked_sql(
    "SELECT id, text, [substring(text, 5, 2), substring(text, 1, 6), substring(text, 4, 8), 'e', ''] AS names FROM spans") + """
SELECT id, masked AS masked_context FROM masked""")
def q_mask(spark, sf_dir):
    """Names that overlap and lie in each other, the shorter one first."""
    s = fx.spans(spark, sf_dir)
    names = F.array(*[F.substring("text", a, n) for a, n in ((5, 2), (1, 6), (4, 8))], F.lit("e"), F.lit(""))
    return s.select("id", spans.mask_mentions(F.col("text"), names).alias("masked_context"))


@query("qa_records", with_ctes("spans") + """,
hits AS (SELECT id, file_id, pos, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k, st, en, text FROM (
  SELECT id, file_id, pos, text, unnest(range(3)) AS i, unnest(stacked_start) AS st, unnest(stacked_end) AS en,
         unnest(stacked_label) AS lb FROM spans) WHERE lb = 3),
""" + _masked_sql("SELECT id, any_value(text) AS text, list(substring(text, st + 1, en - st)) AS names FROM hits GROUP BY id") + """
SELECT (row_number() OVER (ORDER BY h.file_id, h.pos, h.k))::VARCHAR AS id, h.text AS context, substring(h.text, h.st + 1, h.en - h.st) AS answer_text,
       h.st::BIGINT AS answer_start, h.k::BIGINT AS span_no, '' AS question, masked AS masked_context
FROM hits h JOIN masked USING (id)""")
def q_qa(spark, sf_dir):
    q = spans.qa_records(fx.spans(spark, sf_dir))
    return longs(q.select("id", "context", F.col("answers.text")[0].alias("answer_text"),
                          F.col("answers.answer_start")[0].alias("answer_start"), "span_no", "question", "masked_context"))


@query("union_folds", with_ctes("folds") + """
SELECT fold::BIGINT AS fold, count(*)::BIGINT AS n FROM folds WHERE split = 'train' GROUP BY fold""")
def q_union_folds(spark, sf_dir):
    f = spans.union_folds(fx.folds(spark, sf_dir))
    return longs(f.groupBy("fold").agg(F.count("*").alias("n")))


SPAN_CORPUS_SQL = with_ctes("folds") + """,
ex AS (
  SELECT f.id, f.fold, f.file_id, f.pos, f.text AS section_txt,
         CASE WHEN m.k IS NULL THEN 0 ELSE 1 END AS label,
         CASE WHEN m.k IS NULL THEN '' ELSE substring(f.text, m.st + 1, m.en - m.st) END AS dataset,
         coalesce(m.k, -1) AS span_no
  FROM folds f LEFT JOIN (
    SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS k, st, en FROM (
      SELECT id, unnest(range(3)) AS i, unnest(stacked_start) AS st, unnest(stacked_end) AS en,
             unnest(stacked_label) AS lb FROM spans) WHERE lb = 3) m USING (id)
  WHERE f.split = 'train' AND f.text IS NOT NULL),
sc AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY section_txt, label ORDER BY fold, file_id, pos, span_no) AS rn
  FROM ex) WHERE rn = 1)"""


@query("span_corpus", SPAN_CORPUS_SQL + """
SELECT id, label::BIGINT AS label, dataset, fold::BIGINT AS fold, span_no::BIGINT AS span_no FROM sc""")
def q_span_corpus(spark, sf_dir):
    c = corpus.span_corpus(fx.folds(spark, sf_dir))
    return longs(c.select("id", "label", "dataset", "fold", "span_no"))


@query("span_split_profile", SPAN_CORPUS_SQL + f""",
rk AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(42, 'id', 'span_no')}, id, span_no) AS rn,
              count(*) OVER () AS n FROM sc),
sp AS (SELECT *, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split FROM rk)
SELECT split, count(*)::BIGINT AS n, count(*) FILTER (WHERE label = 1)::BIGINT AS n_pos,
       count(DISTINCT dataset)::BIGINT AS n_names FROM sp GROUP BY split""")
def q_span_profile(spark, sf_dir):
    # the split reads its rows twice; they are worked out once, without their texts
    c = written(corpus.span_corpus(fx.folds(spark, sf_dir)).select("id", "span_no", "label", "dataset"), "spans")
    s = sampling.ordered_split(c, 0.8, 42, ["id", "span_no"])
    return s.groupBy("split").agg(F.count("*").cast("bigint").alias("n"),
                                  F.count_if(F.col("label") == 1).cast("bigint").alias("n_pos"),
                                  F.count_distinct("dataset").cast("bigint").alias("n_names"))

