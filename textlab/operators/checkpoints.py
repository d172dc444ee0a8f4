"""Per-run epoch windows: save / reload / keep decisions and the selected checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def checkpoint_decisions(metrics: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "metric",
                         policy: str = "previous") -> DataFrame:
    """First epoch saves; afterwards ``metric`` above the reference saves, below
    reloads, equal keeps.  ``policy="previous"`` compares with the previous
    epoch even when that one was rolled back (the reference); ``"best"``
    compares with the best earlier epoch."""
    w = Window.partitionBy(run).orderBy(epoch)
    if policy == "previous":
        ref = F.lag(metric).over(w)
    elif policy == "best":
        ref = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    else:
        raise ValueError("policy is 'previous' or 'best'")
    d = metrics.withColumn("_ref", ref)
    action = (F.when(F.col("_ref").isNull(), "save").when(F.col(metric) > F.col("_ref"), "save")
              .when(F.col(metric) < F.col("_ref"), "reload").otherwise("keep"))
    return d.withColumn("action", action).drop("_ref")


def selected_checkpoint(decisions: DataFrame, run: str = "run", epoch: str = "epoch") -> DataFrame:
    """Per epoch, the checkpoint on disk after it (last saved epoch so far);
    the row of the last epoch is what the test step loads."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return decisions.withColumn("loaded_epoch",
                                F.last(F.when(F.col("action") == "save", F.col(epoch)), ignorenulls=True).over(w))


def final_checkpoint(decisions: DataFrame, run: str = "run", epoch: str = "epoch",
                     metric: str = "metric") -> DataFrame:
    """One row per run: the checkpoint the test loads (last save) and the best epoch."""
    return decisions.groupBy(run).agg(
        F.max(F.when(F.col("action") == "save", F.col(epoch))).alias("selected_epoch"),
        F.max_by(F.col(epoch), F.struct(F.col(metric), -F.col(epoch))).alias("best_epoch"))
