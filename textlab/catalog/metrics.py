"""Queries: logit maths, losses, batch and test metrics, curves, checkpoints, reports
(survey 2.4, 2.5, 2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.catalog.common import longs, r6, table, with_ctes
from textlab.functions import formats, mathfn
from textlab.operators import checkpoints, losses, metrics, reports
from textlab.registry import query
from textlab.sources import fixtures as fx

M = "greatest(z0, z1)"
LSE = f"({M} + ln(exp(z0 - {M}) + exp(z1 - {M})))"
CE = f"({LSE} - CASE WHEN label01 = 0 THEN z0 ELSE z1 END)"
PRED = "CASE WHEN z1 > z0 THEN 1 ELSE 0 END"


def logits(spark, sf_dir, run_mod: int | None = None):
    lg = fx.logits(spark, sf_dir).withColumn("z", F.array("z0", "z1")).withColumnRenamed("label01", "label")
    lg = metrics.with_predictions(lg, "z", "pred")
    if run_mod:
        lg = lg.withColumn("run", F.col("vec_id") % run_mod)
    return lg


@query("softmax", with_ctes("logits") + f"""
SELECT vec_id::BIGINT AS vec_id, round(exp(z0 - {M}) / (exp(z0 - {M}) + exp(z1 - {M})), 6) AS p0,
       round(exp(z1 - {M}) / (exp(z0 - {M}) + exp(z1 - {M})), 6) AS p1 FROM logits""")
def q_softmax(spark, sf_dir):
    lg = logits(spark, sf_dir).withColumn("p", mathfn.softmax("z"))
    return longs(lg.select("vec_id", r6(F.col("p")[0]).alias("p0"), r6(F.col("p")[1]).alias("p1")))


@query("argmax_class", with_ctes("logits") + f"SELECT vec_id::BIGINT AS vec_id, ({PRED})::BIGINT AS pred FROM logits")
def q_argmax(spark, sf_dir):
    return longs(logits(spark, sf_dir).select("vec_id", "pred"))


@query("cross_entropy", with_ctes("logits") + f"SELECT vec_id::BIGINT AS vec_id, round({CE}, 6) AS ce FROM logits")
def q_ce(spark, sf_dir):
    lg = losses.with_cross_entropy(logits(spark, sf_dir), "z", "label")
    return longs(lg.select("vec_id", r6("ce").alias("ce")))


BATCH_SQL = f""",
b AS (SELECT batch_id, avg((({PRED}) = label01)::INT::DOUBLE) AS accuracy,
             count(*) FILTER (WHERE label01 = 1 AND {PRED} = 1) AS tp,
             count(*) FILTER (WHERE label01 = 1 AND {PRED} = 0) AS fn,
             count(*) FILTER (WHERE label01 = 0 AND {PRED} = 1) AS fp, max(label01) AS anypos
      FROM logits GROUP BY batch_id),
bm AS (SELECT batch_id, accuracy,
              CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
              CASE WHEN 10 * tp + 9 * fn + fp = 0 THEN 0.0 ELSE 10.0 * tp / (10.0 * tp + 9.0 * fn + fp) END AS fbeta,
              anypos::DOUBLE AS fbeta_compat FROM b)"""


def batch_table(spark, sf_dir, compat=False):
    return metrics.batch_metrics(logits(spark, sf_dir), ["batch_id"], "label", "pred", 3.0, compat)


@query("batch_accuracy", with_ctes("logits", extra=BATCH_SQL) +
       "SELECT batch_id::BIGINT AS batch_id, round(accuracy, 6) AS accuracy FROM bm")
def q_batch_acc(spark, sf_dir):
    return longs(batch_table(spark, sf_dir).select("batch_id", r6("accuracy").alias("accuracy")))


@query("batch_recall", with_ctes("logits", extra=BATCH_SQL) +
       "SELECT batch_id::BIGINT AS batch_id, round(recall, 6) AS recall FROM bm")
def q_batch_recall(spark, sf_dir):
    return longs(batch_table(spark, sf_dir).select("batch_id", r6("recall").alias("recall")))


@query("batch_fbeta", with_ctes("logits", extra=BATCH_SQL) +
       "SELECT batch_id::BIGINT AS batch_id, round(fbeta, 6) AS fbeta, fbeta_compat FROM bm")
def q_batch_fbeta(spark, sf_dir):
    t = batch_table(spark, sf_dir)
    c = batch_table(spark, sf_dir, compat=True).select("batch_id", F.col("fbeta").alias("fbeta_compat"))
    return longs(t.select("batch_id", r6("fbeta").alias("fbeta")).join(c, "batch_id"))


@query("mean_over_batches", with_ctes("logits", extra=BATCH_SQL) + """
SELECT round(avg(accuracy), 6) AS accuracy, round(avg(recall), 6) AS recall, round(avg(fbeta), 6) AS fbeta,
       count(*)::BIGINT AS n_batches FROM bm""")
def q_mean_batches(spark, sf_dir):
    m = metrics.mean_over_batches(batch_table(spark, sf_dir))
    return m.select(r6("accuracy").alias("accuracy"), r6("recall").alias("recall"), r6("fbeta").alias("fbeta"),
                    "n_batches")


@query("epoch_loss", with_ctes("logits") + f"""
SELECT round(sum(loss) / count(*), 6) AS epoch_loss FROM (
  SELECT batch_id, avg({CE}) AS loss FROM logits GROUP BY batch_id)""")
def q_epoch_loss(spark, sf_dir):
    b = losses.batch_cross_entropy(logits(spark, sf_dir), "z", "label")
    return losses.epoch_loss(b).select(r6("epoch_loss").alias("epoch_loss"))


FOCAL_B = f"""
SELECT batch_id::BIGINT AS batch_id, round(ws * pow(1 - exp(-ce), 4) * ce, 6) AS loss FROM (
  SELECT batch_id, avg({CE}) AS ce, sum(CASE WHEN label01 = 0 THEN 0.12 ELSE 0.88 END) AS ws
  FROM logits GROUP BY batch_id)"""


@query("focal_loss", with_ctes("logits") + FOCAL_B)
def q_focal(spark, sf_dir):
    f = losses.focal_loss(logits(spark, sf_dir), 4.0, 0.12, "batch", "z", "label")
    return longs(f.select("batch_id", r6("loss").alias("loss")))


@query("focal_loss_row", with_ctes("logits") + f"""
SELECT batch_id::BIGINT AS batch_id,
       round(avg(CASE WHEN label01 = 0 THEN 0.12 ELSE 0.88 END * pow(1 - exp(-({CE})), 4) * ({CE})), 6) AS loss
FROM logits GROUP BY batch_id""")
def q_focal_row(spark, sf_dir):
    f = losses.focal_loss(logits(spark, sf_dir), 4.0, 0.12, "row", "z", "label")
    return longs(f.select("batch_id", r6("loss").alias("loss")))


@query("mse_loss", with_ctes("logits") + "SELECT round(avg(pow(z0 - label01, 2)), 6) AS mse FROM logits")
def q_mse(spark, sf_dir):
    return losses.mse_loss(logits(spark, sf_dir), "z0", "label").select(r6("mse").alias("mse"))


@query("bce_with_logits", with_ctes("logits") + """
SELECT round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce FROM (
  SELECT z0 AS z, (label01 = 0)::INT::DOUBLE AS y FROM logits
  UNION ALL SELECT z1, (label01 = 1)::INT::DOUBLE FROM logits)""")
def q_bce(spark, sf_dir):
    return losses.bce_with_logits(logits(spark, sf_dir), "z", "label").select(r6("bce").alias("bce"))


@query("class_weight_lookup", with_ctes("logits") + """
SELECT vec_id::BIGINT AS vec_id, CASE WHEN label01 = 0 THEN 0.12 ELSE 0.88 END::DOUBLE AS weight FROM logits""")
def q_class_weight(spark, sf_dir):
    return longs(metrics.class_weight_lookup(logits(spark, sf_dir), 0.12).select("vec_id", r6("weight").alias("weight")))


@query("confusion_matrix", with_ctes("logits") + f"""
SELECT batch_id::BIGINT AS batch_id, count(*) FILTER (WHERE label01 = 1 AND {PRED} = 1) AS tp,
       count(*) FILTER (WHERE label01 = 0 AND {PRED} = 1) AS fp, count(*) FILTER (WHERE label01 = 1 AND {PRED} = 0) AS fn,
       count(*) FILTER (WHERE label01 = 0 AND {PRED} = 0) AS tn FROM logits GROUP BY batch_id""")
def q_confusion(spark, sf_dir):
    cm = metrics.confusion_matrix(logits(spark, sf_dir), ["batch_id"])
    return longs(cm.select("batch_id", "tp", "fp", "fn", "tn"))


CM_SQL = f""",
cm AS (SELECT {{g}} count(*) FILTER (WHERE label01 = 1 AND {PRED} = 1) AS tp,
              count(*) FILTER (WHERE label01 = 0 AND {PRED} = 1) AS fp,
              count(*) FILTER (WHERE label01 = 1 AND {PRED} = 0) AS fn,
              count(*) FILTER (WHERE label01 = 0 AND {PRED} = 0) AS tn
       FROM logits {{gb}})"""


def cm_sql(by_run=False):
    if by_run:
        return CM_SQL.format(g="vec_id % 5 AS run,", gb="GROUP BY vec_id % 5")
    return CM_SQL.format(g="", gb="")


@query("test_precision_recall", with_ctes("logits", extra=cm_sql()) + """
SELECT round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall FROM cm""")
def q_test_pr(spark, sf_dir):
    t = metrics.test_metrics(metrics.confusion_matrix(logits(spark, sf_dir)))
    return t.select(r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("mcc", with_ctes("logits", extra=cm_sql(True)) + f"""
SELECT run::BIGINT AS run, round(CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tn + fp = 0 OR tn + fn = 0 THEN 0.0
  ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM cm""")
def q_mcc(spark, sf_dir):
    t = metrics.test_metrics(metrics.confusion_matrix(logits(spark, sf_dir, 5), ["run"]))
    return longs(t.select("run", r6("mcc").alias("mcc")))


REPORT_SQL = """,
cls AS (SELECT run, tp, fp, fn, tn, tn + fp AS s0, tp + fn AS s1, tp + fp + fn + tn AS n,
               CASE WHEN tn + fn = 0 THEN 0 ELSE tn::DOUBLE / (tn + fn) END AS p0,
               CASE WHEN tn + fp = 0 THEN 0 ELSE tn::DOUBLE / (tn + fp) END AS r0,
               CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2.0 * tn / (2 * tn + fn + fp) END AS f0,
               CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p1,
               CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r1,
               CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM cm),
rep AS (
  SELECT run, '0' AS row, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM cls
  UNION ALL SELECT run, '1', p1, r1, f1, s1 FROM cls
  UNION ALL SELECT run, 'accuracy', NULL, NULL, (tp + tn)::DOUBLE / n, n FROM cls
  UNION ALL SELECT run, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM cls
  UNION ALL SELECT run, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n,
                   (f0 * s0 + f1 * s1) / n, n FROM cls)"""


def report_table(spark, sf_dir):
    cm = metrics.confusion_matrix(logits(spark, sf_dir, 5), ["run"])
    return metrics.classification_report(cm, ["run"])


@query("classification_report", with_ctes("logits", extra=cm_sql(True) + REPORT_SQL) + """
SELECT run::BIGINT AS run, row, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1, 6) AS f1, support::BIGINT AS support FROM rep""")
def q_class_report(spark, sf_dir):
    r = report_table(spark, sf_dir)
    return longs(r.select("run", "row", r6("precision").alias("precision"), r6("recall").alias("recall"),
                          r6("f1").alias("f1"), "support"))


@query("average_runs", with_ctes("logits", extra=cm_sql(True) + REPORT_SQL) + """
SELECT row, metric, round(avg(value), 6) AS value, count(*)::BIGINT AS n_runs FROM (
  SELECT run, row, 'precision' AS metric, precision AS value FROM rep
  UNION ALL SELECT run, row, 'recall', recall FROM rep UNION ALL SELECT run, row, 'f1', f1 FROM rep)
WHERE value IS NOT NULL GROUP BY row, metric""")
def q_average_runs(spark, sf_dir):
    a = metrics.average_runs(report_table(spark, sf_dir))
    return a.select("row", "metric", r6("value").alias("value"), "n_runs")


@query("pr_curve", with_ctes("logits") + f""",
probs AS (SELECT label01 AS y, 0 AS cls, exp(z0 - {M}) / (exp(z0 - {M}) + exp(z1 - {M})) AS p FROM logits
          UNION ALL SELECT label01, 1, exp(z1 - {M}) / (exp(z0 - {M}) + exp(z1 - {M})) FROM logits),
hist AS (SELECT cls, least(floor(p * 126), 126)::INT AS bucket, count(*) FILTER (WHERE y = cls)::DOUBLE AS tpb,
                count(*) FILTER (WHERE y <> cls)::DOUBLE AS fpb FROM probs GROUP BY 1, 2),
grid AS (SELECT cls, unnest(range(127)) AS bucket FROM (SELECT DISTINCT cls FROM hist)),
dense AS (SELECT g.cls, g.bucket, coalesce(h.tpb, 0) AS tpb, coalesce(h.fpb, 0) AS fpb
          FROM grid g LEFT JOIN hist h USING (cls, bucket)),
cum AS (SELECT *, sum(tpb) OVER (PARTITION BY cls ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING) AS tp,
               sum(fpb) OVER (PARTITION BY cls ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING) AS fp,
               sum(tpb) OVER (PARTITION BY cls) AS tp0, sum(fpb) OVER (PARTITION BY cls) AS fp0 FROM dense)
SELECT cls::BIGINT AS cls, bucket::BIGINT AS bucket, round(bucket / 126.0, 6) AS threshold, tp, fp,
       fp0 - fp AS tn, tp0 - tp AS fn, round(tp / greatest(1e-7, tp + fp), 6) AS precision,
       round(tp / greatest(1e-7, tp0), 6) AS recall FROM cum""")
def q_pr_curve(spark, sf_dir):
    c = metrics.pr_curve(logits(spark, sf_dir), "z", "label", 2, 127)
    return longs(c.select("cls", "bucket", r6("threshold").alias("threshold"), "tp", "fp", "tn", "fn",
                          r6("precision").alias("precision"), r6("recall").alias("recall")))


@query("reverse_cumulative", with_ctes("logits") + """
SELECT run::BIGINT AS run, bucket::BIGINT AS bucket,
       sum(n) OVER (PARTITION BY run ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING)::BIGINT AS cum FROM (
  SELECT vec_id % 5 AS run, batch_id % 127 AS bucket, count(*) FILTER (WHERE label01 = 1) AS n FROM logits GROUP BY ALL)""")
def q_reverse_cum(spark, sf_dir):
    """At most 127 buckets in a window, as for the curve's thresholds."""
    b = (logits(spark, sf_dir, 5).withColumn("bucket", F.col("batch_id") % 127).groupBy("run", "bucket")
         .agg(F.count_if(F.col("label") == 1).alias("n")))
    return longs(metrics.reverse_cumulative(b, ["run"], "bucket", "n").select("run", "bucket", "cum"))


@query("align_predictions", with_ctes("logits") + f"""
SELECT vec_id::BIGINT AS vec_id, ({PRED})::BIGINT AS pred, label01::BIGINT AS label FROM logits""")
def q_align(spark, sf_dir):
    lg = logits(spark, sf_dir)
    return longs(metrics.align_predictions(lg.select("vec_id", "pred"), lg.select("vec_id", "label"), "vec_id"))


DECIDE_SQL = """,
dec AS (SELECT run, epoch, metric, CASE WHEN prev IS NULL THEN 'save' WHEN metric > prev THEN 'save'
                                       WHEN metric < prev THEN 'reload' ELSE 'keep' END AS action
        FROM (SELECT *, lag(metric) OVER (PARTITION BY run ORDER BY epoch) AS prev FROM epochs))"""


@query("checkpoint_decisions", with_ctes("epochs", extra=DECIDE_SQL) +
       "SELECT run::BIGINT AS run, epoch::BIGINT AS epoch, action FROM dec")
def q_decisions(spark, sf_dir):
    d = checkpoints.checkpoint_decisions(fx.epochs(spark, sf_dir))
    return longs(d.select("run", "epoch", "action"))


@query("selected_checkpoint", with_ctes("epochs", extra=DECIDE_SQL) + """
SELECT run::BIGINT AS run, epoch::BIGINT AS epoch,
       last(CASE WHEN action = 'save' THEN epoch END IGNORE NULLS) OVER (PARTITION BY run ORDER BY epoch
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS loaded_epoch FROM dec""")
def q_selected(spark, sf_dir):
    d = checkpoints.selected_checkpoint(checkpoints.checkpoint_decisions(fx.epochs(spark, sf_dir)))
    return longs(d.select("run", "epoch", "loaded_epoch"))


def report_lines(spark, sf_dir):
    return reports.format_report(metrics.confusion_matrix(logits(spark, sf_dir, 5), ["run"]))


#: the report's layout and rounding written out for DuckDB, apart from the engine's own text: ``cells`` holds the two-decimal numbers
#: of each run (ties to even, on whole numbers), ``lines`` the lines of its report, ``records`` those of the appended layout
REPORT_LINES_SQL = """,
ratios AS (
  SELECT run, unnest(['p0', 'r0', 'f0', 'p1', 'r1', 'f1', 'acc']) AS k,
         unnest([tn, tn, 2 * tn, tp, tp, 2 * tp, tp + tn])::HUGEINT AS a,
         unnest([tn + fn, tn + fp, 2 * tn + fn + fp, tp + fp, tp + fn, 2 * tp + fn + fp, tp + fp + fn + tn])::HUGEINT AS b FROM cm),
pairs AS (
  SELECT x.run, x.k[1] AS m, CASE WHEN x.b = 0 THEN 0 ELSE x.a END AS a0, CASE WHEN x.b = 0 THEN 1 ELSE x.b END AS b0,
         CASE WHEN y.b = 0 THEN 0 ELSE y.a END AS a1, CASE WHEN y.b = 0 THEN 1 ELSE y.b END AS b1, tn + fp AS n0, tp + fn AS n1, tp + fp + fn + tn AS n
  FROM ratios x JOIN ratios y ON x.run = y.run AND x.k[1] = y.k[1] AND x.k[2] = '0' AND y.k[2] = '1' JOIN cm ON cm.run = x.run),
every AS (
  SELECT run, k, a, b FROM ratios
  UNION ALL SELECT run, 'm' || m, a0 * b1 + a1 * b0, 2 * b0 * b1 FROM pairs
  UNION ALL SELECT run, 'w' || m, a0 * b1 * n0 + a1 * b0 * n1, b0 * b1 * n FROM pairs),
cells AS (
  SELECT run, k, printf('%d.%02d', (c // 100)::BIGINT, (c % 100)::BIGINT) AS t FROM (
    SELECT run, k, CASE WHEN b = 0 THEN 0 WHEN (200 * a + b) % (2 * b) = 0 AND (200 * a + b) // (2 * b) % 2 = 1 THEN (200 * a + b) // (2 * b) - 1
                        ELSE (200 * a + b) // (2 * b) END AS c FROM every)),
wide AS (
  SELECT run, max(t) FILTER (WHERE k = 'p0') AS p0, max(t) FILTER (WHERE k = 'r0') AS r0, max(t) FILTER (WHERE k = 'f0') AS f0,
         max(t) FILTER (WHERE k = 'p1') AS p1, max(t) FILTER (WHERE k = 'r1') AS r1, max(t) FILTER (WHERE k = 'f1') AS f1,
         max(t) FILTER (WHERE k = 'mp') AS mp, max(t) FILTER (WHERE k = 'mr') AS mr, max(t) FILTER (WHERE k = 'mf') AS mf,
         max(t) FILTER (WHERE k = 'wp') AS wp, max(t) FILTER (WHERE k = 'wr') AS wr, max(t) FILTER (WHERE k = 'wf') AS wf,
         max(t) FILTER (WHERE k = 'acc') AS acc FROM cells GROUP BY run),
numbers AS (
  SELECT wide.*, (tn + fp)::VARCHAR AS n0, (tp + fn)::VARCHAR AS n1, (tp + fp + fn + tn)::VARCHAR AS n,
         CASE WHEN tp + fp = 0 OR tp + fn = 0 OR tn + fp = 0 OR tn + fn = 0 THEN 0.0::DOUBLE
              ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc
  FROM wide JOIN cm USING (run)),
body AS (
  SELECT run, 0 AS i, '              precision    recall  f1-score   support' AS line FROM numbers
  UNION ALL SELECT run, 1, '' FROM numbers
  UNION ALL SELECT run, 2, printf('           0  %9s %9s %9s %9s', p0, r0, f0, n0) FROM numbers
  UNION ALL SELECT run, 3, printf('           1  %9s %9s %9s %9s', p1, r1, f1, n1) FROM numbers
  UNION ALL SELECT run, 4, '' FROM numbers
  UNION ALL SELECT run, 5, printf('    accuracy                      %9s %9s', acc, n) FROM numbers
  UNION ALL SELECT run, 6, printf('   macro avg  %9s %9s %9s %9s', mp, mr, mf, n) FROM numbers
  UNION ALL SELECT run, 7, printf('weighted avg  %9s %9s %9s %9s', wp, wr, wf, n) FROM numbers),
lines AS (
  SELECT run, i AS line_no, line FROM body
  UNION ALL SELECT run, 8, '============================' FROM numbers
  UNION ALL SELECT run, 9, 'MCC: ' || mcc::VARCHAR FROM numbers),
records AS (
  SELECT run, 0 AS o, 'MCC: ' || printf('%.3f', mcc) AS line FROM numbers
  UNION ALL SELECT run, i + 1, line FROM body
  UNION ALL SELECT run, 9, '' FROM numbers
  UNION ALL SELECT run, 10, '********************************' FROM numbers
  UNION ALL SELECT run, 11, '' FROM numbers)"""


def _report_sql():
    return REPORT_LINES_SQL


@query("format_report", with_ctes("logits", extra=cm_sql(True) + _report_sql()) +
       "SELECT run::BIGINT AS run, line_no::BIGINT AS line_no, line FROM lines")
def q_format_report(spark, sf_dir):
    return longs(report_lines(spark, sf_dir))


@query("parse_report_line", with_ctes("logits", extra=cm_sql(True) + _report_sql()) + """
SELECT run::BIGINT AS run,
       max(CASE WHEN line_no = 2 THEN trim(line[20:23])::DOUBLE END) AS precision_0,
       max(CASE WHEN line_no = 2 THEN trim(line[30:33])::DOUBLE END) AS recall_0,
       max(CASE WHEN line_no = 2 THEN trim(line[40:43])::DOUBLE END) AS f1_0,
       max(CASE WHEN line_no = 3 THEN trim(line[20:23])::DOUBLE END) AS precision_1,
       max(CASE WHEN line_no = 3 THEN trim(line[30:33])::DOUBLE END) AS recall_1,
       max(CASE WHEN line_no = 3 THEN trim(line[40:43])::DOUBLE END) AS f1_1,
       max(CASE WHEN line_no = 5 THEN trim(line[40:44])::DOUBLE END) AS accuracy,
       max(CASE WHEN line_no = 9 THEN trim(line[6:])::DOUBLE END) AS mcc
FROM lines GROUP BY run""")
def q_parse_report(spark, sf_dir):
    return longs(reports.parse_report(report_lines(spark, sf_dir)))


@query("average_parsed_reports", with_ctes("logits", extra=cm_sql(True) + _report_sql()) + """
SELECT round(avg(p0), 6) AS precision_0, round(avg(p1), 6) AS precision_1, round(avg(acc), 6) AS accuracy,
       round(avg(mcc), 6) AS mcc, count(*)::BIGINT AS n_runs FROM (
  SELECT run, max(CASE WHEN line_no = 2 THEN trim(line[20:23])::DOUBLE END) AS p0,
              max(CASE WHEN line_no = 3 THEN trim(line[20:23])::DOUBLE END) AS p1,
              max(CASE WHEN line_no = 5 THEN trim(line[40:44])::DOUBLE END) AS acc,
              max(CASE WHEN line_no = 9 THEN trim(line[6:])::DOUBLE END) AS mcc FROM lines GROUP BY run)""")
def q_average_parsed(spark, sf_dir):
    a = reports.average_parsed(reports.parse_report(report_lines(spark, sf_dir)),
                               ["precision_0", "precision_1", "accuracy", "mcc"])
    return a.select(*[r6(c).alias(c) for c in ["precision_0", "precision_1", "accuracy", "mcc"]], "n_runs")


@query("frame_report_records", with_ctes("logits", extra=cm_sql(True) + REPORT_LINES_SQL) + """
SELECT (dense_rank() OVER (ORDER BY run) - 1)::BIGINT AS record, o::BIGINT AS offset, run::BIGINT AS run, line FROM records""")
def q_frame(spark, sf_dir):
    cm = metrics.confusion_matrix(logits(spark, sf_dir, 5), ["run"])
    f = reports.frame_report_records(reports.format_appended_report(cm))
    return longs(f.select("record", "offset", "run", "line"))


#: means of the numbers in report lines, added up in the order of the runs, as a loop would
def _means_sql() -> str:
    names = [("precision_0", 2, 20, 23), ("recall_0", 2, 30, 33), ("f1_0", 2, 40, 43), ("precision_1", 3, 20, 23), ("recall_1", 3, 30, 33),
             ("f1_1", 3, 40, 43), ("accuracy", 5, 40, 44), ("mcc", 9, 6, 40)]
    cols = ", ".join(f"list_reduce(list_prepend(0.0::DOUBLE, list(TRY_CAST(trim(line[{a}:{b}]) AS DOUBLE) ORDER BY run) FILTER (WHERE line_no = {n})), lambda x, y: x + y)"
                     f" / count(*) FILTER (WHERE line_no = {n}) AS {name}" for name, n, a, b in names)
    return f"means AS (SELECT {cols} FROM lines)"


@query("concat_reports", with_ctes("logits", "epochs", extra=cm_sql(True) + REPORT_LINES_SQL + ",\n" + _means_sql()) + """,
doc AS (
  SELECT 0 AS e, min(run)::VARCHAR AS run, 0 AS section, 0 AS line_no, 'Results on test set' AS line FROM cm
  UNION ALL SELECT DISTINCT 0, run::VARCHAR, 1, 0, 'EXP ' || run || ' ' FROM cm
  UNION ALL SELECT 0, run::VARCHAR, 2, line_no, line FROM lines
  UNION ALL SELECT 0, run::VARCHAR, 3, epoch, 'epoch ' || epoch FROM epochs WHERE run < 5
  UNION ALL SELECT DISTINCT 0, run::VARCHAR, 4, 0, repeat('-', 64) FROM cm
  UNION ALL SELECT 1, NULL, 5, unnest(range(7)), unnest([
    'The average results to be reported', 'negative class:',
    'precesion: ' || precision_0::VARCHAR || ', recall: ' || recall_0::VARCHAR || ', f1_score: ' || f1_0::VARCHAR, 'positive class:',
    'precesion: ' || precision_1::VARCHAR || ', recall: ' || recall_1::VARCHAR || ', f1_score: ' || f1_1::VARCHAR,
    'Accuracy: ' || accuracy::VARCHAR, 'MCC : ' || mcc::VARCHAR]) FROM means)
SELECT (row_number() OVER (ORDER BY e, run, section, line_no) - 1)::BIGINT AS doc_line, line FROM doc""")
def q_concat(spark, sf_dir):
    epochs = fx.epochs(spark, sf_dir).filter("run < 5").select("run", F.col("epoch").alias("line_no"),
                                                               F.concat(F.lit("epoch "), F.col("epoch").cast("string")).alias("line"))
    return longs(reports.concat_reports(report_lines(spark, sf_dir), epochs, averages=True).select("doc_line", "line"))


@query("format_elapsed", """
SELECT event_id::BIGINT AS event_id,
       CASE WHEN d = 0 THEN printf('%d:%02d:%02d', r // 3600, (r % 3600) // 60, r % 60)
            ELSE d::VARCHAR || ' day' || CASE WHEN abs(d) = 1 THEN '' ELSE 's' END || ', ' ||
                 printf('%d:%02d:%02d', r // 3600, (r % 3600) // 60, r % 60) END AS elapsed
FROM (SELECT event_id, floor(s / 86400)::BIGINT AS d, (s - floor(s / 86400)::BIGINT * 86400) AS r
      FROM (SELECT event_id, round_even(value * 1000, 0)::BIGINT AS s FROM events))""")
def q_elapsed(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return longs(e.select("event_id", formats.format_elapsed(F.col("value") * 1000).alias("elapsed")))


@query("average_appended_reports", with_ctes("logits", extra=cm_sql(True) + REPORT_LINES_SQL) + """,
nums AS (SELECT run, max(line[6:]) FILTER (WHERE o = 0) AS mcc, max(line[20:23]) FILTER (WHERE o = 3) AS p0, max(line[30:33]) FILTER (WHERE o = 3) AS r0,
                max(line[40:43]) FILTER (WHERE o = 3) AS f0, max(line[20:23]) FILTER (WHERE o = 4) AS p1, max(line[30:33]) FILTER (WHERE o = 4) AS r1,
                max(line[40:43]) FILTER (WHERE o = 4) AS f1, max(line[40:43]) FILTER (WHERE o = 6) AS acc FROM records GROUP BY run),
long AS (SELECT run, unnest(['mcc', 'p0', 'r0', 'f0', 'p1', 'r1', 'f1', 'acc']) AS k, unnest([mcc, p0, r0, f0, p1, r1, f1, acc]) AS v FROM nums),
m AS (SELECT k, (list_reduce(list_prepend(0.0::DOUBLE, list(trim(v)::DOUBLE ORDER BY run)), lambda x, y: x + y) / count(*))::VARCHAR AS t FROM long GROUP BY k),
w AS (SELECT max(t) FILTER (WHERE k = 'mcc') AS mcc, max(t) FILTER (WHERE k = 'p0') AS p0, max(t) FILTER (WHERE k = 'r0') AS r0, max(t) FILTER (WHERE k = 'f0') AS f0,
             max(t) FILTER (WHERE k = 'p1') AS p1, max(t) FILTER (WHERE k = 'r1') AS r1, max(t) FILTER (WHERE k = 'f1') AS f1, max(t) FILTER (WHERE k = 'acc') AS acc FROM m)
SELECT unnest(range(5))::BIGINT AS line_no, unnest(['******************Final Results**********************', 'N: ' || p0 || ',' || r0 || ',' || f0,
  'P: ' || p1 || ',' || r1 || ',' || f1, 'Acc:' || acc, 'MCC: ' || mcc]) AS line FROM w""")
def q_average_appended(spark, sf_dir):
    """Append-mode reports: framed into 12-line records, parsed, averaged, and the averages written out."""
    cm = metrics.confusion_matrix(logits(spark, sf_dir, 5), ["run"])
    framed = reports.frame_report_records(reports.format_appended_report(cm))
    return longs(reports.format_averages(reports.parse_appended_report(framed), "record", reports.FINAL_RESULTS))
