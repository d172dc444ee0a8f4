"""Trainer: the loss falls, runs repeat, the experiment composes."""

from pyspark.sql import functions as F

from textlab.catalog.experiment import labelled_docs
from textlab.plans import experiment as X
from tests.conftest import SF_SMALL


def test_focal_training_loss_falls_and_repeats(spark):
    d = labelled_docs(spark, SF_SMALL)
    feats = X.text_features(d, "row_id", "text", 1 << 12)
    rows = d.select("row_id", "label")
    _, log = X.train_focal(feats, rows, 2.0, 0.25, 4, 0.5, group=(), n_features=1 << 12)
    losses = [r.loss for r in log.orderBy("epoch").collect()]
    assert losses[-1] < losses[0]
    w1, _ = X.train_focal(feats, rows, 2.0, 0.25, 2, 0.5, group=(), n_features=1 << 12)
    w2, _ = X.train_focal(feats, rows, 2.0, 0.25, 2, 0.5, group=(), n_features=1 << 12)
    a = sorted((r.feature, round(r.w1, 12)) for r in w1.collect())
    b = sorted((r.feature, round(r.w1, 12)) for r in w2.collect())
    assert a == b


def test_run_experiment_produces_reports(spark):
    cfg = X.ExperimentConfig(neg_frac=0.55, pos_copies=2, epochs=2, gamma=4.0, alpha=0.12, seeds=(42, 67),
                             val_frac=0.2, n_features=1 << 12, checkpoint_metric="fbeta")
    out = X.run_experiment(labelled_docs(spark, SF_SMALL), cfg)
    assert out["metrics"].count() == 2
    assert out["decisions"].count() == 4
    lines = out["report_lines"].filter(F.col("line_no") == 9).collect()
    assert all(r.line.startswith("MCC: ") for r in lines)
    assert {r.row for r in out["averages"].collect()} >= {"0", "1", "macro avg", "weighted avg"}


def test_validate_epoch_compat_fbeta(spark):
    rows = [(42, i, i % 3 == 0, 0.0, 1.0 if i % 2 else -1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "seed long, row_id long, label boolean, z0 double, z1 double") \
        .withColumn("label", F.col("label").cast("int")).withColumn("z", F.array("z0", "z1"))
    compat = X.validate_epoch(df, "seed", "row_id", 8, compat=True).first()
    assert compat.fbeta == 1.0  # every batch of 8 holds a positive, so labels-vs-labels scores 1
    true = X.validate_epoch(df, "seed", "row_id", 8).first()
    assert 0.0 <= true.fbeta < 1.0


def test_adagrad_moves_focal_loss_further(spark):
    d = labelled_docs(spark, SF_SMALL)
    feats = X.text_features(d, "row_id", "text", 1 << 12, hashing="xxhash64")
    rows = d.select("row_id", "label")
    _, gd = X.train_focal(feats, rows, 4.0, 0.12, 3, 0.5, group=(), n_features=1 << 12)
    _, ada = X.train_focal(feats, rows, 4.0, 0.12, 3, 0.05, group=(), optimizer="adagrad", n_features=1 << 12)
    g = [r.loss for r in gd.orderBy("epoch").collect()]
    a = [r.loss for r in ada.orderBy("epoch").collect()]
    assert a[-1] < a[0] and (a[0] - a[-1]) > (g[0] - g[-1])


def test_policy_best_compares_with_the_best_so_far(spark):
    from pyspark.sql import functions as F

    from textlab.plans import experiment as X
    for policy, want in (("previous", ["save", "reload", "save"]), ("best", ["save", "reload", "reload"])):
        ref, got = None, []
        for epoch, value in enumerate((0.9, 0.7, 0.8)):
            m = spark.range(1).select(F.lit(1).alias("seed"), F.lit(epoch).alias("epoch"), F.lit(value).alias("metric"))
            got.append(X.decide(m, ref).first().action)
            ref = X.reference_metric(m, ref, policy)
        assert got == want


def test_gradient_steps_equal_a_separate_computation(spark):
    import numpy as np

    from textlab.plans import experiment as X
    rng = np.random.default_rng(3)
    made = [(i, " ".join(rng.choice(list("abcdefg"), 6)), int(i % 3 == 0)) for i in range(30)]
    df = spark.createDataFrame(made, "row_id long, text string, label int")
    feats = X.text_features(df, n_features=32)
    before = spark.catalog.listTables()
    for gamma, alpha in ((0.0, None), (2.0, 0.3)):
        _, log = X.train_focal(feats, df.select("row_id", "label"), gamma, alpha, 4, 0.5, 1e-4, group=(), n_features=32)
        got = [r.loss for r in log.orderBy("epoch").collect()]
        rows = {}
        for r in X.tall_features(feats).collect():
            rows.setdefault(r.row_id, {})[r.feature] = r.value
        names = sorted({f for r in rows.values() for f in r})
        x = np.array([[rows[i].get(f, 0.0) for f in names] for i, _, _ in made])
        bias = names.index(X.BIAS_FEATURE)
        norm = np.sqrt((x ** 2).sum(1) - x[:, bias] ** 2)
        x[:, [j for j in range(len(names)) if j != bias]] /= norm[:, None]
        y = np.array([lab for _, _, lab in made])
        cw = np.ones(len(y)) if alpha is None else np.where(y == 0, alpha, 1 - alpha)

        def loss(w):
            z = x @ w.reshape(2, -1).T
            logp = z - np.log(np.exp(z).sum(1, keepdims=True))
            lp = logp[np.arange(len(y)), y]
            return (cw * (1 - np.exp(lp)) ** gamma * -lp).mean()

        w, want = np.zeros(2 * len(names)), []
        for _ in range(4):
            want.append(loss(w))
            step = np.array([(loss(w + e) - loss(w - e)) / 2e-6 for e in np.eye(len(w)) * 1e-6])
            w = w - 0.5 * (step + 1e-4 * w)
        assert np.allclose(got, want, atol=1e-6)
    assert spark.catalog.listTables() == before


def test_score_rows_weighs_every_component(spark, tmp_path):
    from textlab.catalog.experiment import q_score_rows

    wide = [(1, [0.0] * 68 + [3.0, 4.0])]
    spark.createDataFrame(wide, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = q_score_rows(spark, str(tmp_path)).first()
    w0, w1 = ([(i % m - c) / 10 for i in (68, 69)] for m, c in ((7, 3), (5, 2)))
    assert abs(got.z0 - (3 * w0[0] + 4 * w0[1]) / 5) < 1e-6 and abs(got.z1 - (3 * w1[0] + 4 * w1[1]) / 5) < 1e-6


def test_focal_loss_without_weights_agrees_with_the_library_classifier(spark):
    """gamma 0 and no alpha is plain cross entropy: both classifiers tell the same rows apart, with close probabilities."""
    import random
    rng = random.Random(4)
    made = []
    for i in range(200):
        y = i % 2
        made.append((i, " ".join(rng.choice("abcdef" if y else "efghij") for _ in range(12)), y))
    df = spark.createDataFrame(made, "row_id long, text string, label int")
    model, tf = X.train_weighted(df, None, "text", "label", 1 << 10, 100)
    pred = {r.row_id: r.prediction for r in model.transform(tf.transform(df.withColumn("_tokens", F.split(F.lower("text"), " ", -1)))).collect()}
    feats = X.text_features(df, n_features=1 << 10, keep=["label"])
    w, log = X.train_focal(feats, None, 0.0, None, 200, 2.0, 0.0, n_features=1 << 10)
    losses = [r.loss for r in log.orderBy("epoch").collect()]
    assert losses[0] > 0.69 and losses[-1] < 0.1
    got = {r.row_id: float(r.z1 > r.z0) for r in X.score_rows(X.tall_features(feats), w).collect()}
    assert sum(got[i] == pred[i] for i in got) >= 198


def test_copies_and_seeds_are_row_weights(spark):
    """What each seed trains and validates on equals the rows that copying them out gives, with cuts by row and by copy."""
    from dataclasses import replace

    from textlab.operators import sampling
    df = spark.range(300).select(F.col("id").alias("row_id"), (F.col("id") % 7 == 0).cast("int").alias("label"), F.lit("a").alias("text"))
    base = X.ExperimentConfig(neg_frac=0.55, pos_copies=3, val_frac=0.2, seeds=(42, 67))
    for cfg in (base, replace(base, cut_copies=True), replace(base, neg_frac=None, pos_copies=1)):
        grid = sampling.seed_grid(df.select("row_id", "label"), cfg.seeds, "seed")
        if cfg.neg_frac:
            grid = sampling.undersample(grid, {0: cfg.neg_frac}, F.col("seed"), "row_id", exact=True, group=["seed"])
        every = sampling.oversample(grid, {1: cfg.pos_copies})
        if cfg.cut_copies:
            side = sampling.validation_split(every, 0.2, F.col("seed"), ["row_id", "copy_no"], group=["seed"])
        else:
            orig = sampling.validation_split(grid.select("seed", "row_id"), 0.2, F.col("seed"), "row_id", group=["seed"])
            side = every.join(orig, ["seed", "row_id"])
        train, val = {}, set()
        for r in side.collect():
            if r.split == "train":
                train[r.seed, r.row_id] = train.get((r.seed, r.row_id), 0) + 1
            elif cfg.cut_copies or r.copy_no == 1:
                val.add((r.seed, r.row_id, r.copy_no))
        mult, chosen = X._sides(df, cfg, "row_id", "label")
        got_train, got_val = {}, set()
        for r in df.select("row_id", mult.alias("m"), chosen.alias("v")).collect():
            for s, m, v in zip(cfg.seeds, r.m, r.v):
                if m:
                    got_train[s, r.row_id] = m
                got_val |= {(s, r.row_id, c) for c in v}
        assert got_train == train and got_val == val


def test_experiment_with_cut_copies(spark):
    cfg = X.ExperimentConfig(neg_frac=0.55, pos_copies=3, epochs=2, seeds=(42, 67), val_frac=0.3, n_features=1 << 10, cut_copies=True)
    out = X.run_experiment(labelled_docs(spark, SF_SMALL), cfg)
    assert out["validation"].count() == 4 and out["metrics"].count() == 2


def test_features_are_counted_in_slices(spark):
    """A slice's tokens are hashed once each; rows of no tokens and null rows have no features."""
    import numpy as np
    import pyarrow as pa

    from textlab.plans import linear
    lists = pa.array([["b", "a", "b"], None, [], ["c", None, "a"], ["a"] * 5])
    want = [([1, 2], [1.0, 2.0]), ([], []), ([], []), ([1, 3], [1.0, 1.0]), ([1], [5.0])]
    for size in (1, 2, 4, 100):
        count = linear._counter(lambda flat: np.array([ord(t) % 32 for t in flat.to_pylist()], np.int64), 32, size)
        assert [(r["indices"], r["values"]) for r in count(lists).to_pylist()] == want
        assert len(count(lists.slice(0, 0))) == 0
    for hashing in ("md5", "xxhash64"):
        df = spark.createDataFrame([(1, "a b  a"), (2, None), (3, "")], "row_id long, text string")
        feats = linear.text_features(df, n_features=64, hashing=hashing)
        assert "md5(" not in feats._jdf.queryExecution().optimizedPlan().toString()
        assert {r.row_id: sum(r.values) for r in feats.collect()} == {1: 4.0, 2: 0, 3: 1.0}
