"""Queries: label statistics, set operations, split profile (survey 2.4, 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.catalog.common import longs, sql_hash, table, with_ctes
from textlab.catalog.labeling import CORPUS_SQL, labelled_corpus
from textlab.operators import cleaning, sampling, setops, stats
from textlab.registry import query

SPLIT_SQL = CORPUS_SQL + f""",
ranked AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(42, 'file_id', 'pos')}, file_id, pos) AS rn,
                  count(*) OVER () AS n FROM corpus),
splitc AS (SELECT * EXCLUDE (rn, n), CASE WHEN rn <= round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END
           AS split FROM ranked)"""


def split_corpus(spark, sf_dir):
    """label_corpus with an exact, seeded 20 % test split keyed by (file_id, pos).

    What the profile counts, names and labels, is written once to the shared
    folder without the texts; the exact split reads it twice."""
    from textlab.session import cut_lineage
    c = cut_lineage(labelled_corpus(spark, sf_dir, keep_order=True).select("file_id", "pos", "dataset", "label"))
    return sampling.train_test_split(c, 0.2, 42, ["file_id", "pos"])


def ctes():
    return with_ctes("sections", "annotations", extra=SPLIT_SQL)


@query("label_counts", ctes() + """
SELECT count(*)::BIGINT AS n_samples, count(*) FILTER (WHERE label = 1)::BIGINT AS n_pos,
       count(*) FILTER (WHERE label = 0)::BIGINT AS n_neg FROM corpus""")
def q_label_counts(spark, sf_dir):
    return stats.label_counts(labelled_corpus(spark, sf_dir))


PCT = ("CASE WHEN 2 * (({x}) * 10000 - floor(({x}) * 10000 / n) * n) > n "
       "OR (2 * (({x}) * 10000 - floor(({x}) * 10000 / n) * n) = n AND floor(({x}) * 10000 / n) % 2 = 1) "
       "THEN floor(({x}) * 10000 / n) + 1 ELSE floor(({x}) * 10000 / n) END / 100.0")


@query("label_percent", ctes() + """
SELECT 1::BIGINT AS label, """ + PCT.format(x="hit") + """ AS percent
FROM (SELECT count(*) FILTER (WHERE label = 1) AS hit, count(*) AS n FROM corpus)""")
def q_label_percent(spark, sf_dir):
    return stats.label_percent(labelled_corpus(spark, sf_dir), 1)


@query("positive_rate", """
SELECT hit::BIGINT AS n_pos, n::BIGINT AS n, """ + PCT.format(x="hit") + """ AS pct_pos
FROM (SELECT sum(toxic) AS hit, count(*) AS n FROM labels)""")
def q_positive_rate(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(F.col("toxic").alias("label"))
    return stats.positive_rate(lab)


@query("distinct_mentions", ctes() + "SELECT DISTINCT dataset FROM corpus")
def q_distinct_mentions(spark, sf_dir):
    return stats.distinct_mentions(labelled_corpus(spark, sf_dir))


@query("nunique_mentions", ctes() + """
SELECT count(DISTINCT NULLIF(dataset, 'None'))::BIGINT AS n_unique FROM corpus""")
def q_nunique(spark, sf_dir):
    c = labelled_corpus(spark, sf_dir)
    c = c.withColumn("dataset", F.nullif(F.col("dataset"), F.lit("None")))
    return stats.nunique_mentions(c)


@query("name_length_histogram", ctes() + """
SELECT length(dataset)::BIGINT AS name_len, count(*)::BIGINT AS n FROM corpus GROUP BY 1""")
def q_name_hist(spark, sf_dir):
    return stats.name_length_histogram(labelled_corpus(spark, sf_dir))


@query("union_splits", ctes() + """
SELECT file_id::BIGINT AS file_id, pos::BIGINT AS pos, split FROM (
  SELECT * FROM splitc WHERE split = 'train' UNION ALL SELECT * FROM splitc WHERE split = 'test')""")
def q_union_splits(spark, sf_dir):
    s = split_corpus(spark, sf_dir).select("file_id", "pos", "split")
    return longs(setops.union_splits(s.filter("split = 'train'"), s.filter("split = 'test'")))


@query("shared_mentions", ctes() + """
SELECT dataset FROM splitc WHERE split = 'test' INTERSECT SELECT dataset FROM splitc WHERE split = 'train'""")
def q_shared(spark, sf_dir):
    s = split_corpus(spark, sf_dir)
    return setops.shared_mentions(s.filter("split = 'test'"), s.filter("split = 'train'"))


@query("only_in_train", ctes() + """
SELECT dataset FROM splitc WHERE split = 'train' EXCEPT SELECT dataset FROM splitc WHERE split = 'test'""")
def q_only_train(spark, sf_dir):
    s = split_corpus(spark, sf_dir)
    return setops.only_in(s.filter("split = 'train'"), s.filter("split = 'test'"))


@query("only_in_test", ctes() + """
SELECT dataset FROM splitc WHERE split = 'test' EXCEPT SELECT dataset FROM splitc WHERE split = 'train'""")
def q_only_test(spark, sf_dir):
    s = split_corpus(spark, sf_dir)
    return setops.only_in(s.filter("split = 'test'"), s.filter("split = 'train'"))


@query("first_per_mention", ctes() + """
SELECT dataset, file_id::BIGINT AS file_id, pos::BIGINT AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pub_order, pos) AS rn FROM corpus) WHERE rn = 1""")
def q_first_per_mention(spark, sf_dir):
    c = labelled_corpus(spark, sf_dir, keep_order=True).select("dataset", "pub_order", "pos", "file_id")
    return longs(cleaning.first_per_mention(c, "dataset", ["pub_order", "pos"]).drop("pub_order"))


@query("split_profile", ctes() + """,
per AS (SELECT split, count(*) AS n, count(*) FILTER (WHERE label = 1) AS hp,
               count(*) FILTER (WHERE label = 0) AS hn, count(DISTINCT dataset) AS nn
        FROM splitc GROUP BY split),
pres AS (SELECT dataset, max((split = 'train')::INT) AS a, max((split = 'test')::INT) AS b
         FROM splitc GROUP BY dataset)
SELECT split, 'n_samples' AS measure, n::DOUBLE AS value FROM per
UNION ALL SELECT split, 'n_pos', hp::DOUBLE FROM per
UNION ALL SELECT split, 'n_neg', hn::DOUBLE FROM per
UNION ALL SELECT split, 'pct_pos', """ + PCT.format(x="hp") + """ FROM per
UNION ALL SELECT split, 'pct_neg', """ + PCT.format(x="hn") + """ FROM per
UNION ALL SELECT split, 'n_names', nn::DOUBLE FROM per
UNION ALL SELECT 'both', 'shared', count(*) FILTER (WHERE a = 1 AND b = 1)::DOUBLE FROM pres
UNION ALL SELECT 'both', 'only_in_train', count(*) FILTER (WHERE a = 1 AND b = 0)::DOUBLE FROM pres
UNION ALL SELECT 'both', 'only_in_test', count(*) FILTER (WHERE a = 0 AND b = 1)::DOUBLE FROM pres
UNION ALL SELECT split, 'name_len=' || length(dataset)::VARCHAR, count(*)::DOUBLE FROM splitc
  GROUP BY split, length(dataset)""")
def q_split_profile(spark, sf_dir):
    return setops.split_profile(split_corpus(spark, sf_dir))
