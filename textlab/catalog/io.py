"""Queries: sources and sinks as round trips through a fresh folder under the
shared checkpoint folder (survey 2.1)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.catalog.common import longs, r6, table, with_ctes
from textlab.catalog.metrics import REPORT_LINES_SQL, cm_sql, _report_sql, logits, report_lines
from textlab.functions import mathfn
from textlab.operators import metrics, reports
from textlab.registry import query
from textlab.session import scratch_dir
from textlab.sources import fixtures as fx, readers, writers


@query("read_delimited", "SELECT doc_id::BIGINT AS doc_id, text, lang FROM documents")
def q_read_delimited(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = scratch_dir(spark, "delimited")
    writers.write_delimited(d, path)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           T.StructField("lang", T.StringType())])
    return readers.read_delimited(spark, path, schema)


@query("write_delimited", """
SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE contains(text, '$'))::BIGINT AS n_dollar,
       count(*) FILTER (WHERE contains(text, '"'))::BIGINT AS n_quote,
       count(*) FILTER (WHERE contains(text, chr(10)))::BIGINT AS n_newline FROM documents""")
def q_write_delimited(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_dir(spark, "delimited")
    writers.write_delimited(d, path)
    back = readers.read_delimited(spark, path, T.StructType([T.StructField("doc_id", T.LongType()),
                                                              T.StructField("text", T.StringType())]))
    return back.agg(F.count("*").cast("bigint").alias("n"),
                    F.count_if(F.contains("text", F.lit("$"))).cast("bigint").alias("n_dollar"),
                    F.count_if(F.contains("text", F.lit('"'))).cast("bigint").alias("n_quote"),
                    F.count_if(F.contains("text", F.lit("\n"))).cast("bigint").alias("n_newline"))


@query("read_annotations", with_ctes("annotations") + """
SELECT id::VARCHAR AS id, NULLIF(pub_title, '') AS pub_title, NULLIF(mention, '') AS dataset_title
FROM annotations""")
def q_read_annotations(spark, sf_dir):
    a = fx.annotations(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "pub_title",
                                             F.col("mention").alias("dataset_title"),
                                             F.lit(None).cast("string").alias("dataset_label"),
                                             F.lit(None).cast("string").alias("cleaned_label"))
    path = scratch_dir(spark, "annotations")
    (a.write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return readers.read_annotations(spark, path).select("id", "pub_title", "dataset_title")


@query("read_sections_json", with_ctes("sections") + """
SELECT file_id::VARCHAR AS file_id, pos::BIGINT AS pos, section_title, section_txt FROM sections""")
def q_read_json(spark, sf_dir):
    s = fx.sections(spark, sf_dir)
    root = scratch_dir(spark, "json")
    writers.write_sections_json(s, root)
    back = readers.read_sections_json(spark, root, id_from="partition")
    return longs(back)


@query("read_folds", with_ctes("folds") + """
SELECT fold::BIGINT AS fold, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS n_ids
FROM folds WHERE split = 'train' GROUP BY fold""")
def q_read_folds(spark, sf_dir):
    root = scratch_dir(spark, "folds")
    writers.write_folds(fx.folds(spark, sf_dir), root)
    f = readers.read_folds(spark, root, "train")
    return longs(f.groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids")))


@query("read_report_lines", with_ctes("logits", extra=cm_sql(True) + _report_sql()) +
       "SELECT run::BIGINT AS run, line_no::BIGINT AS line_no, line FROM lines")
def q_read_report(spark, sf_dir):
    path = scratch_dir(spark, "report")
    writers.write_test_report(report_lines(spark, sf_dir), path)
    back = readers.read_report_lines(spark, path, "run")
    return longs(back.select(F.col("run").cast("bigint").alias("run"), "line_no", "line"))


@query("write_test_report", with_ctes("logits", extra=cm_sql(True) + REPORT_LINES_SQL) + """,
added AS (SELECT 0 AS append, run, o, line FROM records WHERE run < 4 UNION ALL SELECT 1, run, o, line FROM records)
SELECT (row_number() OVER (ORDER BY append, run, o) - 1)::BIGINT // 12 AS record, o::BIGINT AS offset, append::BIGINT AS append, run::BIGINT AS run, line FROM added""")
def q_write_report_append(spark, sf_dir):
    """Two additions to one report, the second tried twice, read back in order and cut into records."""
    path = scratch_dir(spark, "report")
    cm = metrics.confusion_matrix(logits(spark, sf_dir, 5), ["run"])
    lines = reports.format_appended_report(cm)
    writers.append_test_report(lines.filter("run < 4"), path, "first")
    writers.append_test_report(lines.filter("run = 0"), path, "second")  # as if cut short
    writers.append_test_report(lines, path, "second")
    back = reports.frame_report_records(readers.read_appended_report(spark, path))
    return longs(back.select("record", "offset", "append", F.col("run").cast("bigint").alias("run"), "line"))


BATCH_SQL = """,
b AS (SELECT vec_id % 5 AS run, batch_id, avg((pred = label01)::INT::DOUBLE) AS accuracy, count(*) FILTER (WHERE label01 = 1 AND pred = 1) AS tp,
             count(*) FILTER (WHERE label01 = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE label01 = 0 AND pred = 1) AS fp, avg(ln(1 + exp(CASE label01 WHEN 1 THEN z0 - z1 ELSE z1 - z0 END))) AS loss
      FROM (SELECT *, (z1 > z0)::INT AS pred FROM logits) GROUP BY ALL),
m AS (SELECT run, batch_id, loss, accuracy, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
             CASE WHEN 10 * tp + 9 * fn + fp = 0 THEN 0.0 ELSE 10.0 * tp / (10.0 * tp + 9.0 * fn + fp) END AS fbeta FROM b)"""


def _batches(spark, sf_dir):
    """(run, step, loss, accuracy, recall, fbeta) of each batch of each run."""
    lg = logits(spark, sf_dir, 5)
    b = metrics.batch_metrics(lg, ["run", "batch_id"], "label", "pred")
    loss = lg.groupBy("run", "batch_id").agg(F.avg(mathfn.cross_entropy("z", "label")).alias("loss"))
    return b.join(loss, ["run", "batch_id"]).select("run", F.col("batch_id").alias("step"), "loss", "accuracy", "recall", "fbeta")


@query("write_epoch_log", with_ctes("logits", extra=BATCH_SQL) + """
SELECT run::BIGINT AS run, (batch_id % 4)::BIGINT AS epoch, round(avg(loss), 6) AS loss, round(avg(accuracy), 6) AS accuracy,
       round(avg(recall), 6) AS recall, round(avg(fbeta), 6) AS fbeta FROM m GROUP BY run, batch_id % 4""")
def q_epoch_log(spark, sf_dir):
    """Loss and metrics per run and epoch; the even runs are first written with other numbers and then replaced."""
    path = scratch_dir(spark, "epochlog")
    names = ["loss", "accuracy", "recall", "fbeta"]
    log = _batches(spark, sf_dir).groupBy("run", (F.col("step") % 4).alias("epoch")).agg(*[F.avg(c).alias(c) for c in names])
    writers.write_epoch_log(log.withColumn("loss", F.when(F.col("run") % 2 == 0, -1.0).otherwise(F.col("loss"))), path)
    writers.write_epoch_log(log.filter("run % 2 = 0"), path)
    return longs(spark.read.parquet(path).select("run", "epoch", *[r6(c).alias(c) for c in names]))


@query("log_metrics", with_ctes("logits", extra=BATCH_SQL) + """
SELECT run::BIGINT AS run, batch_id::BIGINT AS step, unnest(['loss', 'accuracy', 'recall', 'fbeta']) AS tag,
       round(unnest([loss, accuracy, recall, fbeta]), 6) AS value FROM m""")
def q_log_metrics(spark, sf_dir):
    """Every batch's numbers, logged in two parts; the second is tried twice and repeats steps of the first."""
    path = scratch_dir(spark, "metrics")
    b, names = _batches(spark, sf_dir), ["loss", "accuracy", "recall", "fbeta"]
    writers.log_metrics(b.withColumn("loss", F.when(F.col("step") % 3 == 0, 99.0).otherwise(F.col("loss"))), path, ["run"], names, name="all")
    again = b.filter("step % 3 = 0")
    writers.log_metrics(again.limit(1), path, ["run"], names, name="thirds")  # as if cut short
    writers.log_metrics(again, path, ["run"], names, name="thirds")
    back = readers.read_metrics(spark, path, ["run"])
    return longs(back.select("run", "step", "tag", r6("value").alias("value")))
