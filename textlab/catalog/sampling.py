"""Queries: sampling, balancing, splitting, indexing (survey 2.2, 2.5, 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.catalog.common import longs, sql_hash, table, with_ctes
from textlab.functions.hashing import fraction_threshold
from textlab.operators import cleaning, indexing, sampling
from textlab.registry import query
from textlab.sources import fixtures as fx

H = sql_hash(42, "doc_id")
LABELS = "lab AS (SELECT doc_id, toxic AS label FROM labels)"


def labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))


@query("sample_fraction", f"""
SELECT doc_id::BIGINT AS doc_id, toxic::BIGINT AS label FROM labels
WHERE {H} < {fraction_threshold(0.55)}""")
def q_sample_fraction(spark, sf_dir):
    return longs(sampling.sample_fraction(labels(spark, sf_dir), 0.55, 42, "doc_id"))


EXACT20 = f"""ranked AS (SELECT doc_id, label, row_number() OVER (ORDER BY {H}, doc_id) AS rn,
                         count(*) OVER () AS n FROM lab)"""


@query("sample_fraction_exact", f"WITH {LABELS}, {EXACT20}" + """
SELECT doc_id::BIGINT AS doc_id, label::BIGINT AS label FROM ranked WHERE rn <= round_even(n * 0.2, 0)""")
def q_sample_exact(spark, sf_dir):
    return longs(sampling.sample_fraction(labels(spark, sf_dir), 0.2, 42, "doc_id", exact=True))


@query("undersample_negatives", f"""
SELECT doc_id::BIGINT AS doc_id, toxic::BIGINT AS label FROM labels
WHERE toxic <> 0 OR {H} < {fraction_threshold(0.55)}""")
def q_undersample(spark, sf_dir):
    return longs(sampling.undersample_negatives(labels(spark, sf_dir), 0.55, 42, "doc_id"))


@query("oversample_positives", """
SELECT doc_id::BIGINT AS doc_id, toxic::BIGINT AS label, c::BIGINT AS copy_no
FROM labels, LATERAL (SELECT unnest(range(1, CASE WHEN toxic = 1 THEN 4 ELSE 1 END + 1)) AS c)""")
def q_oversample(spark, sf_dir):
    return longs(sampling.oversample_positives(labels(spark, sf_dir), 4))


@query("union_frames", f"WITH {LABELS}" + """
SELECT doc_id::BIGINT AS doc_id, label::BIGINT AS label FROM (
  SELECT * FROM lab WHERE label = 1 UNION ALL SELECT * FROM lab WHERE label = 1 UNION ALL
  SELECT * FROM lab WHERE label = 0 UNION ALL SELECT * FROM lab WHERE label = 1 UNION ALL
  SELECT * FROM lab WHERE label = 1)""")
def q_union_frames(spark, sf_dir):
    lab = labels(spark, sf_dir)
    pos, neg = cleaning.label_filter(lab, 1), cleaning.label_filter(lab, 0)
    return longs(sampling.union_frames(pos, pos, neg, pos, pos))


@query("balance_classes", f"WITH {LABELS}," + f"""
neg AS (SELECT doc_id, label, row_number() OVER (ORDER BY {H}, doc_id) AS rn, count(*) OVER () AS n
        FROM lab WHERE label = 0),
thin AS (SELECT doc_id, label FROM neg WHERE rn <= round_even(n * 0.55, 0)
         UNION ALL SELECT doc_id, label FROM lab WHERE label <> 0),
rep AS (SELECT doc_id, label, c AS copy_no FROM thin,
        LATERAL (SELECT unnest(range(1, CASE WHEN label = 1 THEN 4 ELSE 1 END + 1)) AS c))
SELECT doc_id::BIGINT AS doc_id, label::BIGINT AS label, copy_no::BIGINT AS copy_no,
       (row_number() OVER (ORDER BY {sql_hash(42, 'doc_id', 'copy_no')}, doc_id, copy_no) - 1)::BIGINT
         AS shuffle_pos
FROM rep""")
def q_balance(spark, sf_dir):
    return longs(sampling.balance_classes(labels(spark, sf_dir), 0.55, 4, 42, "doc_id"))


@query("shuffle_rows", f"""
SELECT doc_id::BIGINT AS doc_id, (row_number() OVER (ORDER BY {H}, doc_id) - 1)::BIGINT AS shuffle_pos
FROM labels""")
def q_shuffle(spark, sf_dir):
    """The rows in their shuffled order; the positions are those in which they come out."""
    rows = sampling.shuffle_rows(labels(spark, sf_dir), 42, "doc_id").withColumn("_out", F.monotonically_increasing_id())
    return longs(indexing.assign_row_id(rows, ["_out"], "shuffle_pos").select("doc_id", "shuffle_pos"))


@query("train_test_split_80_20", f"WITH {LABELS}, {EXACT20}" + """
SELECT doc_id::BIGINT AS doc_id, label::BIGINT AS label,
       CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS split FROM ranked""")
def q_train_test(spark, sf_dir):
    return longs(sampling.train_test_split(labels(spark, sf_dir), 0.2, 42, "doc_id"))


@query("ordered_split", f"WITH {LABELS}, {EXACT20}" + """
SELECT doc_id::BIGINT AS doc_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS split
FROM ranked""")
def q_ordered_split(spark, sf_dir):
    return longs(sampling.ordered_split(labels(spark, sf_dir), 0.8, 42, "doc_id").select("doc_id", "split"))


@query("validation_split", f"WITH {LABELS}, {EXACT20}" + """
SELECT doc_id::BIGINT AS doc_id,
       CASE WHEN rn <= n - floor(n * 0.1) THEN 'train' ELSE 'validation' END AS split FROM ranked""")
def q_validation_split(spark, sf_dir):
    return longs(sampling.validation_split(labels(spark, sf_dir), 0.1, 42, "doc_id").select("doc_id", "split"))


@query("anti_split", f"WITH {LABELS}, {EXACT20}" + """
SELECT doc_id::BIGINT AS doc_id, label::BIGINT AS label FROM ranked WHERE rn > round_even(n * 0.2, 0)""")
def q_anti_split(spark, sf_dir):
    lab = labels(spark, sf_dir)
    test = sampling.sample_fraction(lab, 0.2, 42, "doc_id", exact=True)
    return longs(sampling.anti_split(lab, test, "doc_id"))


@query("gather_split", f"""
SELECT d.doc_id::BIGINT AS doc_id, d.lang FROM documents d
WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE {H} < {fraction_threshold(0.55)})""")
def q_gather_split(spark, sf_dir):
    ids = sampling.sample_fraction(labels(spark, sf_dir), 0.55, 42, "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return longs(sampling.gather_split(docs, ids, "doc_id"))


@query("seed_grid", """
SELECT doc_id::BIGINT AS doc_id, toxic::BIGINT AS label, s::BIGINT AS seed
FROM labels, (SELECT unnest([42, 67, 330, 2004, 945]) AS s) seeds""")
def q_seed_grid(spark, sf_dir):
    return longs(sampling.seed_grid(labels(spark, sf_dir), [42, 67, 330, 2004, 945]))


@query("label_filter", "SELECT doc_id::BIGINT AS doc_id, toxic::BIGINT AS label FROM labels WHERE toxic = 1")
def q_label_filter(spark, sf_dir):
    return longs(cleaning.label_filter(labels(spark, sf_dir), 1))


@query("assign_row_id", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos,
       (row_number() OVER (ORDER BY file_id, pos) - 1)::BIGINT AS row_id FROM sections""")
def q_assign_row_id(spark, sf_dir):
    s = fx.sections(spark, sf_dir).select("file_id", "pos")
    return longs(indexing.assign_row_id(s, ["file_id", "pos"], "row_id"))


@query("assign_batches", with_ctes("logits") + """
SELECT vec_id::BIGINT AS vec_id, ((row_number() OVER (ORDER BY vec_id) - 1) // 8)::BIGINT AS batch_id
FROM logits""")
def q_assign_batches(spark, sf_dir):
    lg = fx.logits(spark, sf_dir).select("vec_id")
    return longs(indexing.assign_batches(lg, 8, ["vec_id"]).select("vec_id", "batch_id"))


@query("project_text_label", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, section_txt, (file_id % 2)::BIGINT AS label FROM sections""")
def q_project(spark, sf_dir):
    s = fx.sections(spark, sf_dir).select("file_id", "pos", "section_txt", (F.col("file_id") % 2).alias("label"), "source")
    return longs(cleaning.project_text_label(s, ["file_id", "pos"]))


@query("preview", with_ctes("sections") + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, section_txt FROM sections ORDER BY file_id, pos LIMIT 2""")
def q_preview(spark, sf_dir):
    s = fx.sections(spark, sf_dir).select("file_id", "pos", "section_txt")
    return longs(cleaning.preview(s, ["file_id", "pos"], 2))
