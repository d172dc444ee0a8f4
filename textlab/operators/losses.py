"""Losses over logits: cross entropy, focal (batch or row form), MSE, BCE."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from textlab.functions.mathfn import class_weight, cross_entropy, focal_term, sigmoid_bce


def with_cross_entropy(df: DataFrame, z: str = "z", label: str = "label", out: str = "ce") -> DataFrame:
    return df.withColumn(out, cross_entropy(F.col(z), F.col(label)))


def batch_cross_entropy(df: DataFrame, z: str = "z", label: str = "label", batch: str = "batch_id") -> DataFrame:
    """Mean CE per batch (``CrossEntropyLoss()`` reduction)."""
    return (with_cross_entropy(df, z, label).groupBy(batch)
            .agg(F.avg("ce").alias("loss"), F.count("*").cast("bigint").alias("n")))


def focal_loss(df: DataFrame, gamma: float = 4.0, alpha: float | None = 0.12, mode: str = "batch",
               z: str = "z", label: str = "label", batch: str = "batch_id") -> DataFrame:
    """Focal loss per batch.

    ``mode="batch"`` follows the reference: CE is the batch mean, so ``pt`` is
    one number per batch and, with alpha, the per-row weights multiply that
    one term and are summed.  ``mode="row"`` is the per-example formula
    ``w * (1 - pt)^gamma * CE`` averaged over the batch.
    """
    d = with_cross_entropy(df, z, label).withColumn("_w", class_weight(F.col(label), alpha))
    if mode == "row":
        return (d.groupBy(batch).agg(F.avg(focal_term(F.col("ce"), gamma, F.col("_w"))).alias("loss"),
                                     F.count("*").cast("bigint").alias("n")))
    if mode != "batch":
        raise ValueError("mode is 'batch' or 'row'")
    g = d.groupBy(batch).agg(F.avg("ce").alias("_ce"), F.sum("_w").alias("_ws"),
                             F.count("*").cast("bigint").alias("n"))
    weight = F.col("_ws") if alpha is not None else F.lit(1.0)
    return g.select(batch, (weight * focal_term(F.col("_ce"), gamma)).alias("loss"), "n")


def epoch_loss(batch_losses: DataFrame, group: list[str] | None = None, batch: str = "batch_id",
               loss: str = "loss") -> DataFrame:
    """Sum of batch losses / number of batches (a short batch weighs as a full one)."""
    g = group or []
    return batch_losses.groupBy(*g).agg((F.sum(loss) / F.count_distinct(batch)).alias("epoch_loss"))


def mse_loss(df: DataFrame, z: str = "z0", y: str = "label") -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(z) - F.col(y).cast("double"), 2)).alias("mse"))


def bce_with_logits(df: DataFrame, z: str = "z", label: str = "label", n_classes: int = 2) -> DataFrame:
    """Multi-label BCE over one-hot targets, mean over all cells."""
    cells = df.select(F.posexplode(z).alias("_c", "_z"), F.col(label).alias("_y"))
    return cells.agg(F.avg(sigmoid_bce(F.col("_z"), (F.col("_c") == F.col("_y")).cast("double")))
                     .alias("bce"))
