"""Stand-in inputs derived from the given tables, in Spark and in DuckDB SQL.

The reference reads publications cut into sections, annotation rows and
span-annotated paragraphs.  The test tables carry none of these directly,
so each stand-in is a fixed rule over ``documents`` / ``embeddings`` /
``labels`` / ``events`` (see FIXTURES.md).  Every Spark builder has a CTE
twin below; the two must stay the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from textlab.sources.readers import read_parquet
    return read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- Spark side

def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents cut on newline: (file_id, source, pos, section_txt, section_title)."""
    d = table(spark, sf_dir, "documents")
    s = d.select(F.col("doc_id").alias("file_id"), "source",
                 F.posexplode(F.split("text", "\n", -1)).alias("pos", "section_txt"))
    return s.withColumn("section_title", F.split_part(F.col("section_txt"), F.lit("."), F.lit(1)))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three annotation rows per document: (row_no, id, pub_title, mention).

    Mentions are word 2, word 5 and the source name; titles are sentence k+1,
    so "first title seen" matters.  (``split`` with limit 6 yields the same
    first five words without cutting the whole text.)
    """
    d = table(spark, sf_dir, "documents")
    words = F.split("text", " ", 6)
    a = d.select("doc_id", "text", "source", words.alias("w"),
                 F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    return a.select(
        (F.col("doc_id") * 3 + F.col("k")).alias("row_no"),
        F.col("doc_id").alias("id"),
        F.split_part(F.col("text"), F.lit("."), F.col("k") + 1).alias("pub_title"),
        F.when(F.col("k") == 0, F.get("w", 1)).when(F.col("k") == 1, F.get("w", 4))
        .otherwise(F.col("source")).alias("mention"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label01, z0, z1, batch_id) from the first two embedding values."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id",
                    (F.col("label") >= 8).cast("int").alias("label01"),
                    F.col("embedding")[0].cast("double").alias("z0"),
                    F.col("embedding")[1].cast("double").alias("z1"),
                    (F.col("vec_id") / 8).cast("bigint").alias("batch_id"))


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, epoch, metric): run = raw label, epoch = vec_id % 4, metric = accuracy of ``z1 > z0``."""
    e = table(spark, sf_dir, "embeddings")
    pred = (F.col("embedding")[1] > F.col("embedding")[0]).cast("int")
    hit = (pred == (F.col("label") >= 8).cast("int")).cast("double")
    return (e.groupBy(F.col("label").cast("bigint").alias("run"), (F.col("vec_id") % 4).alias("epoch"))
            .agg(F.avg(hit).alias("metric")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs with stacked spans, from sections of at least 20 characters."""
    s = sections(spark, sf_dir).filter(F.length("section_txt") >= 20)
    return s.select(
        F.concat_ws(":", F.col("file_id").cast("string"), F.col("pos").cast("string")).alias("id"),
        "file_id", "pos",
        F.col("section_txt").alias("text"),
        F.array(F.lit(0), F.lit(5), F.lit(10)).alias("stacked_start"),
        F.array(F.lit(4), F.lit(9), F.lit(20)).alias("stacked_end"),
        F.array((F.col("pos") % 4).cast("int"), (F.col("file_id") % 4).cast("int"),
                ((F.col("pos") + F.col("file_id")) % 4).cast("int")).alias("stacked_label"),
    )


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """spans x fold 0-9; split by (file_id + fold) % 10: 0-7 train, 8 validation, 9 test."""
    sp = spans(spark, sf_dir).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(9))))
    r = (F.col("file_id") + F.col("fold")) % 10
    return sp.withColumn("split", F.when(r < 8, "train").when(r == 8, "validation").otherwise("test"))


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.split(F.lower("text"), " ", -1).alias("tokens"))


# ---------------------------------------------------------------- DuckDB side

SQL = {
    "sections": """sections AS (
  SELECT doc_id AS file_id, source, pos, section_txt, split_part(section_txt, '.', 1) AS section_title
  FROM (SELECT doc_id, source,
               unnest(range(len(string_split(text, chr(10))))) AS pos,
               unnest(string_split(text, chr(10))) AS section_txt
        FROM documents WHERE text IS NOT NULL))""",
    "annotations": """annotations AS (
  SELECT doc_id * 3 + k AS row_no, doc_id AS id, split_part(text, '.', k + 1) AS pub_title,
         CASE k WHEN 0 THEN string_split(text, ' ')[2] WHEN 1 THEN string_split(text, ' ')[5]
                ELSE source END AS mention
  FROM documents, (SELECT unnest([0, 1, 2]) AS k) ks)""",
    "logits": """logits AS (
  SELECT vec_id, (label >= 8)::INTEGER AS label01, embedding[1]::DOUBLE AS z0,
         embedding[2]::DOUBLE AS z1, vec_id // 8 AS batch_id
  FROM embeddings)""",
    "epochs": """epochs AS (
  SELECT label::BIGINT AS run, vec_id % 4 AS epoch,
         avg(((embedding[2] > embedding[1])::INTEGER = (label >= 8)::INTEGER)::INTEGER::DOUBLE) AS metric
  FROM embeddings GROUP BY 1, 2)""",
    "spans": """spans AS (
  SELECT file_id::VARCHAR || ':' || pos::VARCHAR AS id, file_id, pos, section_txt AS text,
         [0, 5, 10] AS stacked_start, [4, 9, 20] AS stacked_end,
         [pos % 4, file_id % 4, (pos + file_id) % 4] AS stacked_label
  FROM sections WHERE length(section_txt) >= 20)""",
    "folds": """folds AS (
  SELECT spans.*, fold,
         CASE WHEN (file_id + fold) % 10 < 8 THEN 'train'
              WHEN (file_id + fold) % 10 = 8 THEN 'validation' ELSE 'test' END AS split
  FROM spans, (SELECT unnest(range(10)) AS fold) f)""",
    "doc_tokens": """doc_tokens AS (
  SELECT doc_id, string_split(lower(text), ' ') AS tokens FROM documents)""",
}

# a CTE may use the ones before it
_DEPS = {"spans": ["sections"], "folds": ["sections", "spans"]}


def with_ctes(*names: str, extra: str = "") -> str:
    """``WITH`` clause holding the named stand-ins (and what they need), plus
    extra query-specific CTEs."""
    order: list[str] = []
    for n in names:
        for dep in _DEPS.get(n, []) + [n]:
            if dep not in order:
                order.append(dep)
    parts = [SQL[n] for n in order]
    if extra:
        parts.append(extra.strip().lstrip(",").strip().rstrip(","))
    return "WITH " + ",\n".join(parts) + "\n"
