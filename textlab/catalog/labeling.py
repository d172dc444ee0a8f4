"""Queries: publications, labelling, cleaning (survey 2.2-2.4 label rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.functions.hashing import digest
from textlab.catalog.common import longs, with_ctes
from textlab.operators import cleaning, labeling
from textlab.plans import corpus
from textlab.registry import query
from textlab.sources import fixtures as fx

# ---- SQL building blocks (DuckDB) -----------------------------------------

PUBS_SQL = """pubs AS (
  SELECT id AS file_id, arg_min(pub_title, row_no) AS publication_name, min(row_no) AS pub_order
  FROM annotations GROUP BY id),
ment AS (SELECT DISTINCT id AS file_id, mention FROM annotations WHERE mention IS NOT NULL)"""

LABELLED_SQL = PUBS_SQL + """,
sec AS (SELECT s.*, p.publication_name, p.pub_order FROM sections s JOIN pubs p USING (file_id)
        WHERE length(s.section_txt) >= 5),
hit AS (SELECT s.file_id, s.pos, count(*) AS n_match,
               first(m.mention ORDER BY length(m.mention) DESC, m.mention) AS best
        FROM sec s JOIN ment m ON s.file_id = m.file_id AND contains(s.section_txt, m.mention)
        GROUP BY s.file_id, s.pos),
lab AS (SELECT sec.*, coalesce(hit.best, 'None') AS dataset,
               CASE WHEN hit.best IS NULL THEN 0 ELSE 1 END AS label, coalesce(hit.n_match, 0) AS n_match
        FROM sec LEFT JOIN hit USING (file_id, pos))"""

CORPUS_SQL = LABELLED_SQL + """,
corpus AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY section_txt, label ORDER BY pub_order, pos) AS rn
    FROM lab WHERE length(section_txt) > 20) WHERE rn = 1)"""


def labelled_corpus(spark, sf_dir, keep_order=False):
    return corpus.label_corpus(fx.annotations(spark, sf_dir), fx.sections(spark, sf_dir),
                               keep_order=keep_order)


# ---- queries ----------------------------------------------------------------

@query("label_corpus", with_ctes("sections", "annotations", extra=CORPUS_SQL) + """
SELECT file_id::BIGINT AS file_id, publication_name, section_title, dataset, label::BIGINT AS label,
       section_txt FROM corpus""")
def q_label_corpus(spark, sf_dir):
    return longs(labelled_corpus(spark, sf_dir))


@query("build_publications", with_ctes("annotations", extra=PUBS_SQL) + """
SELECT p.file_id::BIGINT AS file_id, p.publication_name, p.pub_order::BIGINT AS pub_order,
       coalesce((SELECT string_agg(mention, '|' ORDER BY mention) FROM ment m WHERE m.file_id = p.file_id), '')
         AS mentions
FROM pubs p""")
def q_build_publications(spark, sf_dir):
    p = labeling.build_publications(fx.annotations(spark, sf_dir))
    return longs(p.withColumn("mentions", F.array_join("mentions", "|")))


@query("count_publications", with_ctes("annotations", extra=PUBS_SQL) + """
SELECT count(*)::BIGINT AS n_ids, count(DISTINCT publication_name)::BIGINT AS n_titles FROM pubs""")
def q_count_publications(spark, sf_dir):
    return longs(labeling.count_publications(fx.annotations(spark, sf_dir)))


@query("short_title_report", with_ctes("annotations", extra=PUBS_SQL) + """
SELECT file_id::BIGINT AS file_id, publication_name FROM pubs WHERE length(publication_name) < 5""")
def q_short_title_report(spark, sf_dir):
    p = labeling.build_publications(fx.annotations(spark, sf_dir))
    return longs(cleaning.short_title_report(p).select("file_id", "publication_name"))


@query("join_pub_sections", with_ctes("sections", "annotations", extra=PUBS_SQL) + """
SELECT s.file_id::BIGINT AS file_id, s.pos::BIGINT AS pos, p.publication_name, s.section_txt
FROM sections s JOIN pubs p USING (file_id)""")
def q_join_pub_sections(spark, sf_dir):
    p = labeling.build_publications(fx.annotations(spark, sf_dir))
    j = labeling.join_pub_sections(p, fx.sections(spark, sf_dir))
    return longs(j.select("file_id", "pos", "publication_name", "section_txt"))


@query("label_sections", with_ctes("sections", "annotations", extra=LABELLED_SQL) + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, dataset, label::BIGINT AS label,
       n_match::BIGINT AS n_match FROM lab""")
def q_label_sections(spark, sf_dir):
    p = labeling.build_publications(fx.annotations(spark, sf_dir))
    s = cleaning.skip_tiny_sections(fx.sections(spark, sf_dir))
    lab = labeling.label_sections(s, p, keep_matches=True)
    return longs(lab.select("file_id", "pos", "dataset", "label", F.size("matches").alias("n_match")))


@query("match_mentions", with_ctes("sections", "annotations", extra=PUBS_SQL) + """
SELECT s.file_id::BIGINT AS file_id, s.pos::BIGINT AS pos, m.mention
FROM sections s JOIN ment m ON s.file_id = m.file_id AND contains(s.section_txt, m.mention)""")
def q_match_mentions(spark, sf_dir):
    p = labeling.build_publications(fx.annotations(spark, sf_dir))
    return longs(labeling.match_mentions(fx.sections(spark, sf_dir), p).select("file_id", "pos", "mention"))


@query("contain_pairs", """
SELECT d.doc_id::BIGINT AS doc_id, b.item_id::BIGINT AS item_id
FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def q_contain_pairs(spark, sf_dir):
    return longs(labeling.contain_pairs(fx.table(spark, sf_dir, "documents"),
                                        fx.table(spark, sf_dir, "benchmark")))


@query("clean_funnel", with_ctes("sections", "annotations", extra=LABELLED_SQL) + """
SELECT count(*)::BIGINT AS n_labelled,
       count(*) FILTER (WHERE length(section_txt) > 20)::BIGINT AS n_long,
       (SELECT count(*) FROM (SELECT DISTINCT file_id, section_txt, dataset, label FROM lab
                              WHERE length(section_txt) > 20))::BIGINT AS n_dedup_file,
       (SELECT count(*) FROM (SELECT DISTINCT section_txt, dataset, label FROM lab
                              WHERE length(section_txt) > 20))::BIGINT AS n_dedup_mention,
       (SELECT count(*) FROM (SELECT DISTINCT section_txt, label FROM lab
                              WHERE length(section_txt) > 20))::BIGINT AS n_dedup_text
FROM lab""")
def q_clean_funnel(spark, sf_dir):
    lab = corpus.labelled_with_funnel(fx.annotations(spark, sf_dir), fx.sections(spark, sf_dir))
    return cleaning.clean_funnel(lab)


@query("skip_tiny_sections", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, section_txt FROM sections WHERE length(section_txt) >= 5""")
def q_skip_tiny(spark, sf_dir):
    return longs(cleaning.skip_tiny_sections(fx.sections(spark, sf_dir)).select("file_id", "pos", "section_txt"))


@query("tiny_section_report", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, section_txt FROM sections WHERE length(section_txt) < 5""")
def q_tiny_report(spark, sf_dir):
    return longs(cleaning.tiny_section_report(fx.sections(spark, sf_dir)).select("file_id", "pos", "section_txt"))


@query("min_length_filter", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, length(section_txt)::BIGINT AS n_chars
FROM sections WHERE length(section_txt) > 20""")
def q_min_length(spark, sf_dir):
    s = cleaning.min_length_filter(fx.sections(spark, sf_dir))
    return longs(s.select("file_id", "pos", F.length("section_txt").alias("n_chars")))


@query("drop_null_text", """
SELECT doc_id::BIGINT AS doc_id, lang, text FROM (
  SELECT doc_id, lang, CASE WHEN len(text) % 3 > 0 THEN text END AS text FROM documents) WHERE text IS NOT NULL""")
def q_drop_null_text(spark, sf_dir):
    """Documents of which a third (those with a length that 3 divides) have lost their text."""
    d = fx.table(spark, sf_dir, "documents").withColumn("text", F.when(F.length("text") % 3 > 0, F.col("text")))
    return longs(cleaning.drop_null_text(d, "text").select("doc_id", "lang", "text"))


@query("title_length_filter", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, section_title FROM sections WHERE length(section_title) < 100""")
def q_title_length(spark, sf_dir):
    s = cleaning.title_length_filter(fx.sections(spark, sf_dir))
    return longs(s.select("file_id", "pos", "section_title"))


@query("choose_text_column", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, section_title AS text, 0::BIGINT AS label
FROM sections WHERE section_title IS NOT NULL""")
def q_choose_text(spark, sf_dir):
    s = fx.sections(spark, sf_dir).withColumn("label", F.lit(0))
    return longs(cleaning.choose_text_column(s, "section_title", ["file_id", "pos"]))


@query("dedup_keep_first", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, section_txt FROM (
  SELECT *, row_number() OVER (PARTITION BY section_txt ORDER BY file_id, pos) AS rn FROM sections) WHERE rn = 1""")
def q_dedup_keep_first(spark, sf_dir):
    s = fx.sections(spark, sf_dir).select("file_id", "pos", "section_txt")
    return longs(cleaning.dedup_keep_first(s, ["section_txt"], ["file_id", "pos"]))


@query("dedup_cascade", with_ctes("sections", "annotations", extra=CORPUS_SQL) + """
SELECT count(*)::BIGINT AS n_rows, sum(label)::BIGINT AS n_pos,
       count(DISTINCT section_txt)::BIGINT AS n_texts FROM corpus""")
def q_dedup_cascade(spark, sf_dir):
    c = labelled_corpus(spark, sf_dir).select("label", digest("section_txt").alias("text_key"))
    return c.agg(F.count("*").cast("bigint").alias("n_rows"), F.sum("label").cast("bigint").alias("n_pos"),
                 F.count_distinct("text_key").cast("bigint").alias("n_texts"))
