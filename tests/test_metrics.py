"""Losses, metrics, curves and checkpoint decisions on hand-made rows."""

import math

from pyspark.sql import functions as F

from textlab.functions import mathfn
from textlab.operators import checkpoints, losses, metrics, reports


def _logits(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, label int, z0 double, z1 double") \
        .withColumn("z", F.array("z0", "z1"))


def test_softmax_sums_to_one_and_argmax_first_on_ties(spark):
    df = _logits(spark, [(0, 0, 1.0, 1.0), (0, 1, -3.0, 2.0)])
    r = df.select(mathfn.softmax("z").alias("p"), mathfn.argmax_class("z").alias("a")).collect()
    assert all(abs(sum(x.p) - 1) < 1e-12 for x in r)
    assert [x.a for x in r] == [0, 1]


def test_focal_gamma_zero_no_alpha_is_cross_entropy(spark):
    df = _logits(spark, [(0, 0, 0.3, -0.2), (0, 1, 0.1, 0.4), (1, 1, 2.0, -1.0)])
    ce = {r.batch_id: r.loss for r in losses.batch_cross_entropy(df).collect()}
    for mode in ("batch", "row"):
        fl = {r.batch_id: r.loss for r in losses.focal_loss(df, 0.0, None, mode).collect()}
        assert all(abs(fl[b] - ce[b]) < 1e-12 for b in ce)


def test_mcc_zero_denominator_and_report(spark):
    df = _logits(spark, [(0, 0, 1.0, 0.0), (0, 1, 1.0, 0.0), (0, 0, 2.0, 0.0)])  # all predicted 0
    cm = metrics.confusion_matrix(metrics.with_predictions(df), [], "label", "pred")
    t = metrics.test_metrics(cm).first()
    assert t.mcc == 0.0 and t.precision == 0.0 and t.recall == 0.0
    rep = {r.row: r for r in metrics.classification_report(cm).collect()}
    assert math.isclose(rep["accuracy"].f1, 2 / 3) and rep["1"].support == 1


def test_batch_recall_without_positives_is_zero(spark):
    df = metrics.with_predictions(_logits(spark, [(0, 0, 1.0, 0.0), (1, 1, 0.0, 1.0)]))
    b = {r.batch_id: r for r in metrics.batch_metrics(df, ["batch_id"]).collect()}
    assert b[0].recall == 0.0 and b[1].recall == 1.0 and b[1].fbeta == 1.0


def test_pr_curve_counts(spark):
    df = _logits(spark, [(0, 1, 0.0, 5.0), (0, 0, 5.0, 0.0), (0, 1, 0.0, 0.1)])
    c = {(r.cls, r.bucket): r for r in metrics.pr_curve(df, "z", "label").collect()}
    assert c[(1, 0)].tp == 2 and c[(1, 0)].fp == 1 and c[(1, 126)].tp == 0
    assert len(c) == 2 * 127


def test_checkpoint_decisions_previous_epoch_rule(spark):
    rows = [(0, 0, 0.9), (0, 1, 0.7), (0, 2, 0.8), (1, 0, 0.5), (1, 1, 0.5)]
    m = spark.createDataFrame(rows, "run long, epoch long, metric double")
    d = checkpoints.selected_checkpoint(checkpoints.checkpoint_decisions(m))
    got = {(r.run, r.epoch): (r.action, r.loaded_epoch) for r in d.collect()}
    assert got == {(0, 0): ("save", 0), (0, 1): ("reload", 0), (0, 2): ("save", 2),
                   (1, 0): ("save", 0), (1, 1): ("keep", 0)}
    best = {(r.run, r.epoch): r.action for r in checkpoints.checkpoint_decisions(m, policy="best").collect()}
    assert best[(0, 2)] == "reload"


def test_report_round_trip_and_half_even(spark):
    cm = spark.createDataFrame([(0, 1, 7, 1, 9)], "run long, tp long, fp long, fn long, tn long")
    lines = {r.line_no: r.line for r in reports.format_report(cm).collect()}
    assert lines[0] == "              precision    recall  f1-score   support"
    assert lines[3][19:23] == "0.12"  # 1/8 = 0.125 rounds half to even
    parsed = reports.parse_report(reports.format_report(cm)).first()
    assert parsed.precision_1 == 0.12 and parsed.recall_1 == 0.5
    assert lines[9].startswith("MCC: ")


def test_format_elapsed(spark):
    df = spark.createDataFrame([(0.4,), (59.5,), (3661.0,), (86400.0,), (2 * 86400 + 5.0,)], "s double")
    got = [r[0] for r in df.select(__import__("textlab.functions.formats", fromlist=["x"]).format_elapsed("s")).collect()]
    assert got == ["0:00:00", "0:01:00", "1:01:01", "1 day, 0:00:00", "2 days, 0:00:05"]


def test_float_text_is_what_python_writes(spark):
    import math
    import random
    import struct
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, 0.5, 0.1, 1 / 3, 2 / 3, 1e-4, 9.999e-5, 1.25e-7, 123456789.0, 1e15, 1e16, 1.5e16, 1e22, 1e23, 2.0e-3, 2 ** -44, 1.7976931348623157e308,
              -0.07, math.inf, -math.inf, math.nan, 0.57 / 5, (0.12 + 0.27 + 0.3) / 3]
    values += [rng.uniform(-1, 1) for _ in range(500)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 20) for _ in range(500)]
    values += [struct.unpack("d", rng.randbytes(8))[0] for _ in range(500)]
    values = [v for v in values if v == 0 or not abs(v) < 2.2250738585072014e-308]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    from textlab.functions.formats import float_text
    got = {r.i: r.t for r in df.select("i", float_text("v").alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [repr(v) for v in values]


def test_averages_add_up_in_order(spark):
    rows = [(r, 0.1 * r, 0.7, 0.33, 0.2, 0.5, 1.0, 0.9, 0.123456789 / (r + 1)) for r in range(5)]
    names = ["precision_0", "recall_0", "f1_0", "precision_1", "recall_1", "f1_1", "accuracy", "mcc"]
    df = spark.createDataFrame(rows, "run long, " + ", ".join(f"{n} double" for n in names)).repartition(4)
    mean = {}
    for i, n in enumerate(names):
        total = 0.0
        for r in rows:
            total += r[i + 1]
        mean[n] = total / 5
    got = [r.line for r in reports.format_averages(df).orderBy("line_no").collect()]
    assert got[2] == f"precesion: {mean['precision_0']}, recall: {mean['recall_0']}, f1_score: {mean['f1_0']}" and got[6] == f"MCC : {mean['mcc']}"
    final = [r.line for r in reports.format_averages(df, layout=reports.FINAL_RESULTS).orderBy("line_no").collect()]
    assert final[1] == f"N: {mean['precision_0']},{mean['recall_0']},{mean['f1_0']}" and len(final) == 5
    assert reports.format_averages(df.limit(0)).count() == 0
