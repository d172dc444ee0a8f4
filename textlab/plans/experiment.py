"""The experiment stage as Spark jobs: features, cost-sensitive training,
scoring, validation with checkpoint decisions, test reports, seed averages.

The reference fine-tunes a transformer on one machine; what carries over to
a cluster is the data-parallel cost-sensitive classifier around it.  Here a
linear model over hashed token counts (``linear``) is trained by full-batch gradient
descent under plain or focal loss, with every seed trained in the same passes over one
table of features: a row's weight for each seed says whether it trains there and how many copies count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from textlab.functions.hashing import hash_u32
from textlab.functions.mathfn import class_weight
from textlab.operators import checkpoints, metrics, reports, sampling
from textlab.operators.indexing import assign_hash_batches, cut_rows
from textlab.operators.joins import broadcast_if_small
from textlab.plans.linear import (BIAS_FEATURE, Model, document_frequencies, gradient, score_vectors, tall_features,
                                  text_features, token_counts, windowed_tokens, with_idf)
from textlab.session import cut_lineage, written

__all__ = ["BIAS_FEATURE", "ExperimentConfig", "PRESETS", "SEEDS", "decide", "document_frequencies", "evaluate_test", "reference_metric",
           "run_experiment", "score_rows", "tall_features", "text_features", "train_focal", "train_weighted", "validate_epoch", "with_idf"]


# fixed values: the experiment grid (window, balancing, validation share, loss,
# checkpoint metric per setting) and the five seeds
SEEDS = [42, 67, 330, 2004, 945]


@dataclass(frozen=True)
class ExperimentConfig:
    neg_frac: float | None = None      # undersample class 0 to this share (None = off)
    pos_copies: int = 1                # copies of class 1
    head: int = 382
    tail: int = 128
    test_head: int = 328
    test_tail: int = 128
    val_frac: float = 0.1
    gamma: float = 0.0
    alpha: float | None = None
    checkpoint_metric: str = "accuracy"  # accuracy | recall | fbeta
    epochs: int = 4
    batch_size: int = 8
    lr: float = 0.5  # step of the full-batch descent of a linear model (fine-tuning rates do not carry over)
    seeds: tuple = tuple(SEEDS)
    text_col: str = "text"
    policy: str = "previous"  # compare an epoch with the one before, or "best": with the best so far
    fbeta_compat: bool = False  # True: the reference's labels-against-labels F-beta
    cut_copies: bool = False  # True: the reference's validation cut by row and copy, which may part copies of a row
    hashing: str = "xxhash64"
    optimizer: str = "gd"  # or "adagrad"
    n_features: int = 1 << 18


PRESETS = {
    "ce_head128": ExperimentConfig(head=128, tail=382, test_head=128, test_tail=382, val_frac=0.1),
    "ce_balanced": ExperimentConfig(neg_frac=0.55, pos_copies=4, test_head=382, val_frac=0.1),
    "focal": ExperimentConfig(val_frac=0.1, gamma=4.0, alpha=0.12),
    "focal_balanced": ExperimentConfig(neg_frac=0.55, pos_copies=4, val_frac=0.1, gamma=4.0, alpha=0.12),
    "focal_recall": ExperimentConfig(val_frac=0.2, gamma=4.0, alpha=0.12, checkpoint_metric="recall"),
    "focal_balanced_fbeta": ExperimentConfig(neg_frac=0.55, pos_copies=4, val_frac=0.2, gamma=4.0,
                              alpha=0.12, checkpoint_metric="fbeta"),
    "span_focal_balanced_fbeta": ExperimentConfig(neg_frac=0.55, pos_copies=2, val_frac=0.2, gamma=4.0,
                             alpha=0.12, checkpoint_metric="fbeta"),
}


def _is_bias():
    return F.col("feature") == BIAS_FEATURE


def _row_scores(f: DataFrame, weights: DataFrame, keys: list[str], g: list[str]) -> DataFrame:
    """Per-row logits of the L2-normalised counts (bias unscaled), one aggregate:
    ``z_c = b_c + sum(v * w_c) / sqrt(sum(v^2))``.  The weights join is a
    left join (broadcast where the weights' measured size allows), so features without a weight still count in the norm."""
    side, _ = broadcast_if_small(weights, materialize=False)
    j = f.join(side, [*g, "feature"], "left").fillna(0.0, ["w0", "w1"])
    nb = ~_is_bias()
    a = j.groupBy(*keys).agg(
        F.sum(F.when(_is_bias(), F.col("w0"))).alias("_b0"), F.sum(F.when(_is_bias(), F.col("w1"))).alias("_b1"),
        F.sum(F.when(nb, F.col("value") * F.col("w0"))).alias("_s0"),
        F.sum(F.when(nb, F.col("value") * F.col("w1"))).alias("_s1"),
        F.sum(F.when(nb, F.col("value") * F.col("value"))).alias("_nn"))
    inv = F.when(F.col("_nn") > 0, 1.0 / F.sqrt("_nn")).otherwise(F.lit(0.0))
    return a.select(*keys, (F.coalesce("_b0", F.lit(0.0)) + F.coalesce("_s0", F.lit(0.0)) * inv).alias("z0"),
                    (F.coalesce("_b1", F.lit(0.0)) + F.coalesce("_s1", F.lit(0.0)) * inv).alias("z1"),
                    inv.alias("_inv"))


def score_rows(feats: DataFrame, weights: DataFrame, key: str = "row_id", group: tuple = ()) -> DataFrame:
    """M4: logits ``z = [z0, z1]`` per row; features missing from the weights count 0."""
    s = _row_scores(feats, weights, [*group, key], list(group))
    return s.drop("_inv").withColumn("z", F.array("z0", "z1"))


def _weights_by_row(rows: DataFrame, key: str, g: list[str], groups: list[tuple]) -> DataFrame:
    """(key, label, mult): how often each row counts for each of ``groups``, in their order."""
    if not g:
        return rows.select(key, "label", F.array(F.lit(1.0)).alias("mult"))
    here = [F.count_if(F.struct(*g) == F.struct(*[F.lit(v) for v in values])).cast("double") for values in groups]
    return rows.groupBy(key).agg(F.max("label").alias("label"), F.array(*here).alias("mult"))


def train_focal(feats: DataFrame, rows: DataFrame | None = None, gamma: float = 4.0, alpha: float | None = 0.12,
                epochs: int = 4, lr: float = 0.5, l2: float = 1e-4, key: str = "row_id",
                group: tuple = ("seed",), optimizer: str = "gd", n_features: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """M3: full-batch gradient descent on focal loss (``gamma=0``, ``alpha=None``
    is plain cross entropy).  ``feats`` is (key, indices, values), ``rows`` holds ``(*group, key, label)``, a line for each time a
    row counts for a group; without ``rows``, ``feats`` has the label and each row counts once.

    The vectors are written once. Each epoch sends the weights to the tasks and is one pass over the vectors, in which each task
    adds up one gradient vector for all groups; these are summed feature by feature, and the sums, no more than
    ``n_features`` times the groups, make the next weights. Returns the weights and the
    epoch log ``(*group, epoch, loss)``.
    """
    spark, g = feats.sparkSession, list(group)
    if rows is None:
        groups, table = [()], feats.withColumn("mult", F.array(F.lit(1.0)))
        g = []
    else:
        groups = sorted(tuple(r) for r in rows.select(*g).distinct().collect()) if g else [()]
        table = feats.join(_weights_by_row(rows, key, g, groups), key)
    table = written(table.select("indices", "values", "label", "mult"), "vectors")
    model, log = Model(groups, n_features), []
    for epoch in range(epochs):
        slope, loss = gradient(table, model, gamma, alpha)
        model.step(slope, lr, l2, optimizer)
        log += [(*line, epoch, float(x)) for line, x in zip(groups, loss)]
    kinds = {f.name: f.dataType.simpleString() for f in (feats if rows is None else rows).schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in g), "epoch int", "loss double"])
    return model.table(spark, g), spark.createDataFrame(log, schema)


def train_weighted(df: DataFrame, alpha: float | None = 0.12, text: str = "text", label: str = "label",
                   n_features: int = 1 << 18, max_iter: int = 20):
    """M2: logistic regression on hashed term counts with class weights
    (alpha for class 0, 1 - alpha for class 1); L-BFGS over tree aggregation."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF

    d = df.withColumn("_tokens", F.split(F.lower(F.col(text)), " ", -1)) \
        .withColumn("_w", class_weight(F.col(label), alpha))
    tf = HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=n_features)
    lr = LogisticRegression(featuresCol="_features", labelCol=label, weightCol="_w", maxIter=max_iter)
    feats = tf.transform(d).withColumn(label, F.col(label).cast("double"))
    model = lr.fit(feats)
    return model, tf


def validate_epoch(scored: DataFrame, seed_col: str = "seed", key: str | list[str] = "row_id", batch_size: int = 8,
                   beta: float = 3.0, compat: bool = False, checkpoint_metric: str = "accuracy", reference: DataFrame | None = None,
                   num_thresholds: int = 127) -> DataFrame:
    """M5, one row per seed: validation rows in a seeded random order cut into batches; batch
    accuracy / recall / F-beta, unweighted mean over batches; the precision-recall ``curve`` of both classes as an array of
    (cls, bucket, threshold, tp, fp, tn, fn, precision, recall); and the ``action`` that ``checkpoint_metric`` leads to
    against ``reference`` (seed, metric), the first epoch's being to save.

    The curve's counts are a histogram of at most ``num_thresholds`` buckets a class, added up across tasks."""
    keys = [key] if isinstance(key, str) else list(key)
    s = metrics.with_predictions(scored, "z", "pred")
    s = s.withColumn("_h", hash_u32(F.col(seed_col), *keys))
    b = assign_hash_batches(s, batch_size, "_h", keys, group=[seed_col])
    bm = metrics.batch_metrics(b, [seed_col, "batch_id"], "label", "pred", beta, compat)
    out = metrics.mean_over_batches(bm, [seed_col])
    point = F.struct("cls", "bucket", "threshold", "tp", "fp", "tn", "fn", "precision", "recall")
    curve = metrics.pr_curve(scored, "z", "label", 2, num_thresholds, group=[seed_col]).groupBy(F.col(seed_col).alias("_seed")).agg(
        F.array_sort(F.collect_list(point)).alias("curve"))
    out = out.join(curve, F.col(seed_col).eqNullSafe(F.col("_seed")), "left").drop("_seed")
    out = out.withColumn("metric", F.col(checkpoint_metric))
    return decide(out, reference, seed_col).drop("metric")


def evaluate_test(scored: DataFrame, seed_col: str = "seed") -> dict[str, DataFrame]:
    """M6: confusion counts per seed -> test metrics, classification report, report text."""
    s = metrics.with_predictions(scored, "z", "pred")
    cm = metrics.confusion_matrix(s, [seed_col], "label", "pred")
    return {
        "confusion": cm,
        "metrics": metrics.test_metrics(cm),
        "report": metrics.classification_report(cm, [seed_col]),
        "report_lines": reports.format_report(cm, seed_col),
        "positive_rate": s.groupBy(seed_col).agg(F.sum("label").cast("bigint").alias("n_pos"),
                                                 F.count("*").cast("bigint").alias("n")),
    }


def decide(metric: DataFrame, reference: DataFrame | None, seed: str = "seed") -> DataFrame:
    """``metric`` (seed, metric, ...) with the action: save above the reference metric, reload below, keep when equal."""
    if reference is None:
        return metric.withColumn("action", F.lit("save"))
    j = metric.join(reference.select(seed, F.col("metric").alias("_ref")), seed, "left")
    return j.withColumn("action", F.when(F.col("_ref").isNull() | (F.col("metric") > F.col("_ref")), "save")
                        .when(F.col("metric") < F.col("_ref"), "reload").otherwise("keep")).drop("_ref")


def reference_metric(metric: DataFrame, reference: DataFrame | None, policy: str = "previous") -> DataFrame:
    """What the next epoch is compared with: this epoch's metric, or the best so far."""
    if policy not in ("previous", "best"):
        raise ValueError("policy is 'previous' or 'best'")
    if policy == "previous" or reference is None:
        return metric
    both = metric.select("seed", "metric").unionByName(reference.select("seed", "metric"))
    return cut_lineage(both.groupBy("seed").agg(F.max("metric").alias("metric")))


def _cuts(rows: DataFrame, key: list[str], k: Column, seeds) -> dict[int, tuple]:
    """For each seed the (hash, *key) of the ``k``-th smallest row of ``rows`` (seed, *key) by hash; seeds without one are left out."""
    cut = cut_rows(rows, hash_u32(F.col("seed"), *key), key, k, ["seed"])
    return {r["_g_seed"]: (r["_cut_rank"], *r["_cut_tie"]) for r in cut.collect()}


def _up_to(seed: int, key: list, cut: tuple | None, kinds: list[str]) -> Column:
    """Whether a row's (hash, *key) for ``seed`` is not after ``cut``; ``key`` holds columns."""
    if cut is None:
        return F.lit(False)
    at = F.struct(hash_u32(seed, *key).alias("h"), *[k.alias(f"t{i}") for i, k in enumerate(key)])
    end = F.struct(F.lit(cut[0]).cast("bigint").alias("h"), *[F.lit(v).cast(t).alias(f"t{i}") for i, (v, t) in enumerate(zip(cut[1:], kinds))])
    return at <= end


def _sides(df: DataFrame, cfg: ExperimentConfig, key: str, label: str) -> tuple[Column, Column]:
    """Two array columns with an entry for each seed, from a row's key and label alone: how many of its copies train, and the copies that
    validate. Samples and cuts are exact for each seed: the cuts' values are found over all rows' keys, and rows compare with them."""
    keys = written(df.select(key, label), "keys")
    kind = dict(keys.dtypes)[key]
    grid = sampling.seed_grid(keys, cfg.seeds, "seed")
    thin, thinned = {}, F.coalesce(F.col(label) == 0, F.lit(False)) if cfg.neg_frac is not None else F.lit(False)
    if cfg.neg_frac is not None:  # round(neg_frac * n) negatives with the smallest hashes
        thin = _cuts(grid.filter(thinned), [key], F.bround(F.col("n") * F.lit(cfg.neg_frac), 0), cfg.seeds)
    stays = {s: ~thinned | _up_to(s, [F.col(key)], thin.get(s), [kind]) for s in cfg.seeds}
    copies = F.when(F.col(label) == 1, F.lit(cfg.pos_copies)).otherwise(F.lit(1))
    of_seed = F.lit(False)
    for s in cfg.seeds:
        of_seed = F.when(F.col("seed") == s, stays[s]).otherwise(of_seed)
    kept = grid.filter(of_seed)
    # the last int(n * val_frac) rows of a seed's shuffled order validate
    k = F.col("n") - F.floor(F.col("n") * F.lit(cfg.val_frac))
    one = F.array(F.lit(1))
    train, val = [], []
    if cfg.cut_copies:
        cut = _cuts(kept.withColumn("copy_no", F.explode(F.sequence(F.lit(1), copies))).select("seed", key, "copy_no"), [key, "copy_no"], k, cfg.seeds)
        def late(s):
            return F.filter(F.sequence(F.lit(1), copies), lambda c: ~_up_to(s, [F.col(key), c], cut.get(s), [kind, "int"]))

        for s in cfg.seeds:
            later = late(s)
            val.append(F.when(stays[s], later).otherwise(F.array().cast("array<int>")))
            train.append(F.when(stays[s], copies - F.size(later)).otherwise(F.lit(0)).cast("double"))
    else:  # copies follow their row
        cut = _cuts(kept.select("seed", key), [key], k, cfg.seeds)
        for s in cfg.seeds:
            early = _up_to(s, [F.col(key)], cut.get(s), [kind])
            val.append(F.when(stays[s] & ~early, one).otherwise(F.array().cast("array<int>")))
            train.append(F.when(stays[s] & early, copies).otherwise(F.lit(0)).cast("double"))
    return F.array(*train), F.array(*val)


def run_experiment(df: DataFrame, cfg: ExperimentConfig, key: str = "row_id", label: str = "label",
                   test: DataFrame | None = None, l2: float = 1e-4) -> dict[str, DataFrame]:
    """M7: all seeds at once -> balance -> validation cut -> per epoch: train
    step, validation pass, save / reload / keep -> test on the saved weights
    -> report and averages over seeds.

    ``df`` is ``(key, text, label)`` with distinct keys; ``test`` the held-out rows (default: an
    exact 20 % hash split of ``df``).  Each text is turned into one vector, whatever the seeds and copies: a row holds its
    weight in each seed's training set and its copies in each seed's validation set. An epoch is one pass over the training rows
    and one over the validation rows for all seeds. The decision compares with the previous
    epoch's validation metric or the best so far (``policy``); a reload puts the last saved weights back
    before the next epoch, as the reference does. ``averages`` are over seeds.
    """
    if test is None:
        sp = written(sampling.train_test_split(df.select(key, label, cfg.text_col), 0.2, 42, key), "rows")
        test = sp.filter(F.col("split") == "test").drop("split")
        df = sp.filter(F.col("split") == "train").drop("split")
    spark, seeds = df.sparkSession, list(cfg.seeds)
    mult, val = _sides(df, cfg, key, label)
    rows = df.withColumn("mult", mult).withColumn("val", val)

    def vectors(d: DataFrame, head: int, tail: int, keep: list[str]) -> DataFrame:
        return written(text_features(d.withColumnRenamed(label, "label"), key, cfg.text_col, cfg.n_features, head=head, tail=tail,
                                     hashing=cfg.hashing, keep=["label", *keep]), "vectors")

    feats = vectors(rows, cfg.head, cfg.tail, ["mult", "val"])
    trains = feats.filter(F.exists("mult", lambda m: m > 0))
    validates = feats.filter(F.exists("val", lambda c: F.size(c) > 0))
    model = Model([(s,) for s in seeds], cfg.n_features)
    saved, prev = model.copy(), None
    losses, vals, decs = [], [], []
    for epoch in range(cfg.epochs):
        slope, loss = gradient(trains, model, cfg.gamma, cfg.alpha)
        model.step(slope, cfg.lr, l2, cfg.optimizer)
        scored = written(score_vectors(validates, model, key, "seed", "val"), "scored")
        v = written(validate_epoch(scored, "seed", [key, "copy_no"] if cfg.cut_copies else key, cfg.batch_size, compat=cfg.fbeta_compat,
                                       checkpoint_metric=cfg.checkpoint_metric, reference=prev).withColumn("epoch", F.lit(epoch)), "epoch")
        dec = v.select("seed", "epoch", F.col(cfg.checkpoint_metric).alias("metric"), "action")
        action = {r["seed"]: r["action"] for r in dec.collect()}
        which = np.array([action.get(s) for s in seeds], dtype=object)
        saved.take(model, which == "save")
        model.take(saved, which == "reload")  # the next epoch starts from the saved weights
        prev = reference_metric(dec.select("seed", "epoch", "metric"), prev, cfg.policy)
        losses += [(s, float(x), epoch) for s, x in zip(seeds, loss)]
        vals.append(v)
        decs.append(dec)

    def union(xs):
        out = xs[0]
        for x in xs[1:]:
            out = out.unionByName(x)
        return out

    scored_test = written(score_vectors(vectors(test, cfg.test_head, cfg.test_tail, []), saved, key, "seed"), "scored")
    out = evaluate_test(scored_test, "seed")
    decisions = union(decs).withColumnRenamed("seed", "run")
    out["epoch_log"] = spark.createDataFrame(losses, "seed bigint, loss double, epoch int")
    out["validation"] = union(vals)
    out["decisions"] = checkpoints.selected_checkpoint(decisions, "run", "epoch")
    out["averages"] = metrics.average_runs(out["report"], "seed")
    out["weights"] = saved.table(spark, ["seed"])
    return out
