"""Batch metrics, confusion-based test metrics, curves and run averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from textlab.functions.mathfn import argmax_class, softmax


def with_predictions(df: DataFrame, z: str = "z", out: str = "pred") -> DataFrame:
    return df.withColumn(out, argmax_class(F.col(z)))


def _tp(label, pred):
    return F.count_if((F.col(label) == 1) & (F.col(pred) == 1))


def _fp(label, pred):
    return F.count_if((F.col(label) == 0) & (F.col(pred) == 1))


def _fn(label, pred):
    return F.count_if((F.col(label) == 1) & (F.col(pred) == 0))


def _tn(label, pred):
    return F.count_if((F.col(label) == 0) & (F.col(pred) == 0))


def _safe_ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def batch_metrics(df: DataFrame, group: Sequence[str] = ("batch_id",), label: str = "label",
                  pred: str = "pred", beta: float = 3.0, compat: bool = False) -> DataFrame:
    """Per batch accuracy, recall of class 1 and F-beta (0 where undefined).

    ``compat=True`` reproduces the reference's F-beta, which scores labels
    against labels: 1 for a batch with a positive, else 0.
    """
    tp, fp, fn = _tp(label, pred), _fp(label, pred), _fn(label, pred)
    b2 = float(beta) ** 2
    fbeta = F.max(F.col(label)).cast("double") if compat else \
        _safe_ratio(F.lit(1 + b2) * tp, F.lit(1 + b2) * tp + F.lit(b2) * fn + fp)
    return df.groupBy(*group).agg(
        F.avg((F.col(pred) == F.col(label)).cast("double")).alias("accuracy"),
        _safe_ratio(tp, tp + fn).alias("recall"),
        fbeta.alias("fbeta"),
        F.count("*").cast("bigint").alias("n"))


def mean_over_batches(batch: DataFrame, group: Sequence[str] = (),
                      metrics: Sequence[str] = ("accuracy", "recall", "fbeta")) -> DataFrame:
    """Unweighted mean of batch metrics (second-level aggregation)."""
    return batch.groupBy(*group).agg(*[F.avg(m).alias(m) for m in metrics],
                                     F.count("*").cast("bigint").alias("n_batches"))


def confusion_matrix(df: DataFrame, group: Sequence[str] = (), label: str = "label",
                     pred: str = "pred") -> DataFrame:
    """One row per group with tp, fp, fn, tn (the four cells every test metric needs)."""
    return df.groupBy(*group).agg(_tp(label, pred).cast("bigint").alias("tp"),
                                  _fp(label, pred).cast("bigint").alias("fp"),
                                  _fn(label, pred).cast("bigint").alias("fn"),
                                  _tn(label, pred).cast("bigint").alias("tn"))


def _d(c):
    return F.col(c).cast("double")


def test_metrics(cm: DataFrame) -> DataFrame:
    """precision / recall of class 1, accuracy, MCC from confusion counts.

    MCC multiplies counts as doubles (the product overflows BIGINT) and is 0
    when any margin is empty."""
    tp, fp, fn, tn = _d("tp"), _d("fp"), _d("fn"), _d("tn")
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den == 0, F.lit(0.0)).otherwise((tp * tn - fp * fn) / den)
    return cm.select("*",
                     _safe_ratio(tp, tp + fp).alias("precision"),
                     _safe_ratio(tp, tp + fn).alias("recall"),
                     _safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
                     mcc.alias("mcc"))


def classification_report(cm: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, F1, support; accuracy; macro and weighted
    averages, as rows ``(row, precision, recall, f1, support)`` (0 where undefined)."""
    g = list(group)
    tp, fp, fn, tn = _d("tp"), _d("fp"), _d("fn"), _d("tn")
    p1, r1 = _safe_ratio(tp, tp + fp), _safe_ratio(tp, tp + fn)
    p0, r0 = _safe_ratio(tn, tn + fn), _safe_ratio(tn, tn + fp)
    f1 = _safe_ratio(2 * tp, 2 * tp + fp + fn)
    f0 = _safe_ratio(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    n = tp + fp + fn + tn
    acc = _safe_ratio(tp + tn, n)
    base = cm.select(*g, p0.alias("p0"), r0.alias("r0"), f0.alias("f0"), s0.alias("s0"),
                     p1.alias("p1"), r1.alias("r1"), f1.alias("f1"), s1.alias("s1"), acc.alias("acc"),
                     n.alias("n"))
    w = lambda a, b: _safe_ratio(F.col(a) * F.col("s0") + F.col(b) * F.col("s1"), F.col("n"))
    rows = F.array(
        F.struct(F.lit("0").alias("row"), F.col("p0").alias("precision"), F.col("r0").alias("recall"),
                 F.col("f0").alias("f1"), F.col("s0").alias("support")),
        F.struct(F.lit("1").alias("row"), F.col("p1").alias("precision"), F.col("r1").alias("recall"),
                 F.col("f1").alias("f1"), F.col("s1").alias("support")),
        F.struct(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"),
                 F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("row"), ((F.col("p0") + F.col("p1")) / 2).alias("precision"),
                 ((F.col("r0") + F.col("r1")) / 2).alias("recall"), ((F.col("f0") + F.col("f1")) / 2).alias("f1"),
                 F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("row"), w("p0", "p1").alias("precision"),
                 w("r0", "r1").alias("recall"), w("f0", "f1").alias("f1"), F.col("n").alias("support")))
    out = base.select(*g, F.inline(rows))
    return out.withColumn("support", F.col("support").cast("bigint"))


def average_runs(per_run: DataFrame, run: str = "run", keys: Sequence[str] = ("row",),
                 metrics: Sequence[str] = ("precision", "recall", "f1"), digits: int | None = None) -> DataFrame:
    """Mean over runs (seeds) of each metric, from exact values (not rounded text); the mean itself is
    rounded to ``digits`` where asked for."""
    tall = per_run.select(run, *keys, F.explode(F.map_from_arrays(
        F.array(*[F.lit(m) for m in metrics]), F.array(*[F.col(m).cast("double") for m in metrics])))
        .alias("metric", "value"))
    return (tall.filter(F.col("value").isNotNull()).groupBy(*keys, "metric")
            .agg((F.avg("value") if digits is None else F.round(F.avg("value"), digits)).alias("value"),
                 F.count("*").cast("bigint").alias("n_runs")))


def pr_curve(df: DataFrame, z: str = "z", label: str = "label", n_classes: int = 2,
             num_thresholds: int = 127, group: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest precision/recall curve per class over softmax scores.

    Each row lands in bucket ``floor(p * (T - 1))`` of its class; true and
    false positives are counted per (class, bucket) with map-side combining
    (at most T rows per class leave each task), the dense threshold grid is
    generated per class, and a reverse cumulative window gives counts at or
    above each threshold.  Precision and recall use a floor of 1e-7 on the
    denominator.
    """
    g = list(group)
    t1 = num_thresholds - 1
    probs = df.select(*g, F.col(label).alias("_y"), F.posexplode(softmax(F.col(z))).alias("cls", "_p"))
    probs = probs.filter(F.col("cls") < n_classes)
    bucket = F.least(F.floor(F.col("_p") * t1), F.lit(t1)).cast("int")
    hist = (probs.groupBy(*g, "cls", bucket.alias("bucket"))
            .agg(F.count_if(F.col("_y") == F.col("cls")).cast("double").alias("tp_b"),
                 F.count_if(F.col("_y") != F.col("cls")).cast("double").alias("fp_b")))
    grid = (hist.select(*g, "cls").distinct()
            .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(t1)))))
    dense = grid.join(hist, [*g, "cls", "bucket"], "left").fillna(0.0, ["tp_b", "fp_b"])
    w = Window.partitionBy(*g, "cls").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    wall = Window.partitionBy(*g, "cls")
    cur = (dense.withColumn("tp", F.sum("tp_b").over(w)).withColumn("fp", F.sum("fp_b").over(w))
           .withColumn("_tp0", F.sum("tp_b").over(wall)).withColumn("_fp0", F.sum("fp_b").over(wall)))
    eps = F.lit(1e-7)
    return cur.select(*g, "cls", "bucket", (F.col("bucket") / F.lit(float(t1))).alias("threshold"),
                      "tp", "fp", (F.col("_fp0") - F.col("fp")).alias("tn"), (F.col("_tp0") - F.col("tp")).alias("fn"),
                      (F.col("tp") / F.greatest(eps, F.col("tp") + F.col("fp"))).alias("precision"),
                      (F.col("tp") / F.greatest(eps, F.col("_tp0"))).alias("recall"))


def reverse_cumulative(df: DataFrame, partition: Sequence[str], order: str, value: str,
                       out: str = "cum") -> DataFrame:
    """Sum of ``value`` at or above each ``order`` value, per partition."""
    w = Window.partitionBy(*partition).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(value).over(w))


def class_weight_lookup(df: DataFrame, alpha: float = 0.12, label: str = "label", out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == 0, F.lit(alpha)).otherwise(F.lit(1.0 - alpha)))


def align_predictions(pred: DataFrame, truth: DataFrame, key: str = "row_id") -> DataFrame:
    """Predictions and true labels matched by an explicit id, not by position."""
    return pred.join(truth, key, "inner")
