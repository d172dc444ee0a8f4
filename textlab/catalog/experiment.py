"""Queries: model operators re-aimed as Spark jobs (survey 2.11, M1-M7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlab.catalog.common import longs, r6, table
from textlab.plans import experiment as X
from textlab.operators.joins import broadcast_if_small
from textlab.registry import query
from textlab.session import cut_lineage, written

NF = 1 << 18


def labelled_docs(spark, sf_dir):
    """(row_id, text, label): documents with a toxicity label."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "text")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("toxic").alias("label"))
    side, _ = broadcast_if_small(lab)
    return d.join(side, "row_id", "inner")


FEATURES_SQL = f"""
SELECT doc_id, (('0x' || substr(md5(t), 1, 8))::BIGINT) % {NF} AS feature, count(*)::DOUBLE AS value
FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS t FROM documents) GROUP BY 1, 2"""


@query("text_features", f"SELECT doc_id::BIGINT AS doc_id, feature::BIGINT AS feature, value FROM ({FEATURES_SQL})")
def q_text_features(spark, sf_dir):
    """Every entry of every document's vector."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return X.tall_features(X.text_features(d, "doc_id", "text", NF), "doc_id", bias=False)


@query("text_features_idf", f"""WITH f AS MATERIALIZED ({FEATURES_SQL}),
n AS (SELECT count(*) AS n FROM documents), d AS (SELECT feature, count(*) AS df FROM f GROUP BY feature)
SELECT doc_id::BIGINT AS doc_id, feature::BIGINT AS feature, round(value * ln((n + 1)::DOUBLE / (df + 1)), 6) AS value FROM f JOIN d USING (feature), n""")
def q_text_features_idf(spark, sf_dir):
    """The same with weights learned from how many documents hold a feature."""
    feats = written(X.text_features(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", NF), "vectors")
    scaled = X.tall_features(X.with_idf(feats, X.document_frequencies(feats), NF), "doc_id", bias=False)
    return scaled.select("doc_id", "feature", r6("value").alias("value"))


def fixed_weights(spark, dim):
    """Model parameters: w0[i] = (i % 7 - 3) / 10, w1[i] = (i % 5 - 2) / 10."""
    r = spark.range(dim).withColumnRenamed("id", "feature")
    return r.select("feature", ((F.col("feature") % 7 - 3) / 10.0).alias("w0"),
                    ((F.col("feature") % 5 - 2) / 10.0).alias("w1"))


@query("score_rows", """
SELECT vec_id::BIGINT AS vec_id,
       round(CASE WHEN sum(v * v) > 0 THEN sum(v * ((i % 7) - 3) / 10.0) / sqrt(sum(v * v)) ELSE 0 END, 6) AS z0,
       round(CASE WHEN sum(v * v) > 0 THEN sum(v * ((i % 5) - 2) / 10.0) / sqrt(sum(v * v)) ELSE 0 END, 6) AS z1
FROM (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)
GROUP BY vec_id""")
def q_score_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    feats = e.select("vec_id", F.posexplode("embedding").alias("feature", "value")) \
        .withColumn("feature", F.col("feature").cast("bigint")).withColumn("value", F.col("value").cast("double"))
    longest = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    s = X.score_rows(feats, fixed_weights(spark, longest), "vec_id")
    return longs(s.select("vec_id", r6("z0").alias("z0"), r6("z1").alias("z1")))


def _focal_sql(epochs: int = 4, gamma: int = 4, alpha: float = 0.12, lr: float = 0.5, l2: float = 1e-4) -> str:
    """Full-batch gradient steps as one chain of tables. Class 0's weights stay the negatives of class 1's,
    so one weight a feature is enough."""
    out = [f"""WITH t AS MATERIALIZED (
  SELECT d.doc_id AS r, l.toxic AS y, unnest(string_split(lower(d.text), ' ')) AS tok
  FROM documents d JOIN labels l USING (doc_id)),
c AS (SELECT r, y, (('0x' || substr(md5(tok), 1, 8))::BIGINT) % {NF} AS f, count(*)::DOUBLE AS v FROM t GROUP BY ALL),
x AS MATERIALIZED (
  SELECT r, y, f, v / sqrt(sum(v * v) OVER (PARTITION BY r)) AS x FROM c
  UNION ALL SELECT doc_id, toxic, -1, 1.0 FROM documents JOIN labels USING (doc_id)),
n AS (SELECT count(*)::DOUBLE AS n FROM x WHERE f = -1),
w0 AS (SELECT f, 0.0::DOUBLE AS w FROM x GROUP BY f)"""]
    for e in range(epochs):
        out.append(f"""z{e} AS MATERIALIZED (
  SELECT r, y, greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12) AS pt, p, CASE WHEN y = 0 THEN {alpha} ELSE {1 - alpha} END AS cw
  FROM (SELECT r, y, 1 / (1 + exp(-2 * sum(x * w))) AS p FROM x JOIN w{e} USING (f) GROUP BY r, y)),
g{e} AS MATERIALIZED (
  SELECT r, -cw * pow(1 - pt, {gamma}) * ln(pt) AS loss,
         cw * ({gamma} * pow(1 - pt, {gamma - 1}) * ln(pt) - pow(1 - pt, {gamma}) / pt) * pt * (y - p) AS g FROM z{e}),
w{e + 1} AS MATERIALIZED (
  SELECT f, any_value(w) - {lr} * (sum(x * g) / any_value(n.n) + {l2} * any_value(w)) AS w
  FROM x JOIN g{e} USING (r) JOIN w{e} USING (f), n GROUP BY f)""")
    return ",\n".join(out) + "\n" + "\nUNION ALL ".join(
        f"SELECT {e}::INTEGER AS epoch, round((SELECT sum(loss) FROM g{e}) / n, 6) AS loss FROM n" for e in range(epochs))


@query("train_focal", _focal_sql())
def q_train_focal(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    feats = X.text_features(d, "row_id", "text", NF, hashing="md5", keep=["label"])
    _, log = X.train_focal(feats, None, 4.0, 0.12, 4, 0.5, n_features=NF)
    return log.select("epoch", r6("loss").alias("loss"))


@query("train_weighted")
def q_train_weighted(spark, sf_dir):
    d = labelled_docs(spark, sf_dir)
    model, tf = X.train_weighted(d, 0.12, "text", "label", NF, 10)
    pred = model.transform(tf.transform(d.withColumn("_tokens", F.split(F.lower("text"), " ", -1))))
    return longs(pred.select("row_id", "label", F.col("prediction").cast("int").alias("pred")))


SEEDS = (1, 2, 3)

#: embeddings scored with fixed weights that differ by seed: w0 = (i * seed % 7 - 3) / 10, w1 = (i * seed % 5 - 2) / 10
SCORED_SQL = f"""WITH e AS (SELECT vec_id, label % 2 AS y, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
z AS (SELECT seed, vec_id, any_value(y) AS y,
             sum(v * ((i * seed % 7) - 3) / 10.0) AS z0, sum(v * ((i * seed % 5) - 2) / 10.0) AS z1
      FROM e, (SELECT unnest({list(SEEDS)}) AS seed) GROUP BY seed, vec_id),
p AS (SELECT seed, y, (z1 > z0)::INT AS pred, (row_number() OVER (
             PARTITION BY seed ORDER BY ('0x' || substr(md5(seed || ':' || vec_id), 1, 8))::BIGINT, vec_id) - 1) // 8 AS batch FROM z)"""


def scored(spark, sf_dir, factor=1):
    """(seed, row_id, label, z): every embedding scored once for each seed."""
    e = table(spark, sf_dir, "embeddings")
    feats = e.select(F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"), F.col("vec_id").alias("row_id"),
                     F.posexplode("embedding").alias("feature", "value"))
    feats = feats.withColumn("feature", F.col("feature").cast("bigint")).withColumn("value", F.col("value").cast("double"))
    longest = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    i = F.col("feature") * F.col("seed") * factor
    w = spark.range(longest).select(F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"), F.col("id").alias("feature"))
    w = w.select("seed", "feature", ((i % 7 - 3) / 10.0).alias("w0"), ((i % 5 - 2) / 10.0).alias("w1"))
    labels = e.select(F.col("vec_id").alias("row_id"), (F.col("label") % 2).alias("label"))
    return X.score_rows(feats, w, "row_id", ("seed",)).join(labels, "row_id")


@query("validate_epoch", f"""WITH e AS (
  SELECT vec_id, label % 2 AS y, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
z AS (SELECT epoch, seed, vec_id, any_value(y) AS y, sum(v * ((i * seed * (epoch + 1) % 7) - 3) / 10.0) / sqrt(sum(v * v)) AS z0,
             sum(v * ((i * seed * (epoch + 1) % 5) - 2) / 10.0) / sqrt(sum(v * v)) AS z1
      FROM e, (SELECT unnest({list(SEEDS)}) AS seed), (SELECT unnest([0, 1, 2]) AS epoch) GROUP BY ALL),
p AS (SELECT epoch, seed, y, (z1 > z0)::INT AS pred, (row_number() OVER (PARTITION BY epoch, seed
             ORDER BY ('0x' || substr(md5(seed || ':' || vec_id), 1, 8))::BIGINT, vec_id) - 1) // 8 AS batch FROM z),
b AS (SELECT epoch, seed, batch, avg((pred = y)::INT::DOUBLE) AS accuracy, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp,
             count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp FROM p GROUP BY ALL),
m AS (SELECT epoch, seed, avg(accuracy) AS accuracy, avg(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp::DOUBLE / (tp + fn) END) AS recall,
             avg(CASE WHEN 10 * tp + 9 * fn + fp = 0 THEN 0.0 ELSE 10.0 * tp / (10.0 * tp + 9.0 * fn + fp) END) AS fbeta, count(*) AS n_batches
      FROM b GROUP BY ALL),
s AS (SELECT epoch, seed, y, c AS cls, CASE c WHEN 1 THEN 1 / (1 + exp(z0 - z1)) ELSE 1 / (1 + exp(z1 - z0)) END AS p
      FROM z, (SELECT unnest([0, 1]) AS c)),
h AS (SELECT epoch, seed, cls, t AS bucket, count(*) FILTER (WHERE y = cls AND floor(p * 126) >= t) AS tp, count(*) FILTER (WHERE y <> cls AND floor(p * 126) >= t) AS fp,
             count(*) FILTER (WHERE y = cls AND floor(p * 126) < t) AS fn, count(*) FILTER (WHERE y <> cls AND floor(p * 126) < t) AS tn
      FROM s, (SELECT unnest(range(127)) AS t) GROUP BY ALL),
c AS (SELECT epoch, seed, string_agg(cls || ':' || bucket || ':' || tp || ':' || fp || ':' || tn || ':' || fn, ' ' ORDER BY cls, bucket) AS curve,
             round(sum(tp / greatest(1e-7, tp + fp)), 5) AS precisions, round(sum(tp / greatest(1e-7, tp + fn)), 5) AS recalls, round(sum(bucket / 126.0), 5) AS thresholds
      FROM h GROUP BY ALL),
d AS (SELECT *, lag(round(recall, 9)) OVER (PARTITION BY seed ORDER BY epoch) AS prev FROM m)
SELECT seed::BIGINT AS seed, epoch::BIGINT AS epoch, round(accuracy, 6) AS accuracy, round(recall, 6) AS recall, round(fbeta, 6) AS fbeta,
       n_batches::BIGINT AS n_batches, curve, precisions, recalls, thresholds,
       CASE WHEN prev IS NULL OR round(recall, 9) > prev THEN 'save' WHEN round(recall, 9) < prev THEN 'reload' ELSE 'keep' END AS action
FROM d JOIN c USING (epoch, seed)""")
def q_validate_epoch(spark, sf_dir):
    """Three epochs (weights of other strides), each compared with the one before by recall."""
    out, before = None, None
    for epoch in range(3):
        v = X.validate_epoch(scored(spark, sf_dir, epoch + 1), checkpoint_metric="recall", reference=before)
        v = cut_lineage(v.withColumn("epoch", F.lit(epoch)))
        before = v.select("seed", F.col("recall").alias("metric"))
        out = v if out is None else out.unionByName(v)
    counts = F.transform("curve", lambda c: F.concat_ws(":", c["cls"], c["bucket"], *[c[n].cast("bigint") for n in ("tp", "fp", "tn", "fn")]))

    def total(name):
        return F.round(F.aggregate("curve", F.lit(0.0), lambda s, c: s + c[name]), 5)
    return longs(out.select("seed", "epoch", r6("accuracy").alias("accuracy"), r6("recall").alias("recall"), r6("fbeta").alias("fbeta"), "n_batches",
                            F.array_join(counts, " ").alias("curve"), total("precision").alias("precisions"), total("recall").alias("recalls"),
                            total("threshold").alias("thresholds"), "action"))


@query("evaluate_test", SCORED_SQL + """,
m AS (SELECT seed, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
             count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn FROM p GROUP BY seed)
SELECT seed::BIGINT AS seed, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
       round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn)
             / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 6) AS mcc FROM m""")
def q_evaluate_test(spark, sf_dir):
    t = X.evaluate_test(scored(spark, sf_dir))["metrics"]
    return longs(t.select("seed", "tp", "fp", "fn", "tn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("mcc").alias("mcc")))


RUN_SEEDS, RUN_NF, RUN_EPOCHS = X.SEEDS, 1 << 16, 4


def _run_sql(gamma=4, alpha=0.12, lr=0.5, l2=1e-4) -> str:
    """The whole experiment as one chain of tables: splits, features, epochs with validation, decisions and reloads, test, averages."""
    h = "('0x' || substr(md5(seed || ':' || r), 1, 8))::BIGINT"

    def vectors(rows: str, head: int, tail: int) -> str:
        return f"""(SELECT r, f, v / sqrt(sum(v * v) OVER (PARTITION BY r)) AS x FROM (
    SELECT r, ('0x' || substr(md5(tok), 1, 8))::BIGINT % {RUN_NF} AS f, count(*)::DOUBLE AS v FROM (
      SELECT r, unnest(list_concat(t[1:{head}], t[greatest(len(t) - {tail - 1}, 1):len(t)])) AS tok
      FROM (SELECT r, string_split(lower(text), ' ') AS t FROM {rows})) GROUP BY 1, 2)
  UNION ALL SELECT r, -1, 1.0 FROM {rows})"""

    out = [f"""WITH d AS MATERIALIZED (SELECT d.doc_id AS r, l.toxic AS y, d.text FROM documents d JOIN labels l USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY {h.replace("seed", "42")}, r) AS rn, count(*) OVER () AS n FROM d),
tr AS MATERIALIZED (SELECT r, y, text FROM ranked WHERE rn > round_even(n * 0.2, 0)),
te AS MATERIALIZED (SELECT r, y, text FROM ranked WHERE rn <= round_even(n * 0.2, 0)),
seeds AS (SELECT unnest({RUN_SEEDS}) AS seed),
grid AS (SELECT seed, r, y, {h} AS h FROM tr, seeds),
thin AS (SELECT seed, r, y, h FROM grid WHERE y <> 0
         UNION ALL SELECT seed, r, y, h FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY h, r) AS k, count(*) OVER (PARTITION BY seed) AS n
                                              FROM grid WHERE y = 0) WHERE k <= round_even(n * 0.55, 0)),
side AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY h, r) > count(*) OVER (PARTITION BY seed)
                             - floor(count(*) OVER (PARTITION BY seed) * 0.2) AS val FROM thin),
m AS MATERIALIZED (SELECT seed, r, y, CASE WHEN y = 1 THEN 4 ELSE 1 END AS c FROM side WHERE NOT val),
n AS (SELECT seed, sum(c)::DOUBLE AS n FROM m GROUP BY seed),
v AS MATERIALIZED (SELECT seed, r, y, (row_number() OVER (PARTITION BY seed ORDER BY h, r) - 1) // 8 AS batch FROM side WHERE val),
x AS MATERIALIZED {vectors("tr", 382, 128)},
xt AS MATERIALIZED {vectors("te", 328, 128)},
w0 AS (SELECT seed, f, 0.0::DOUBLE AS w FROM (SELECT DISTINCT f FROM x), seeds),
s0 AS (SELECT * FROM w0 WHERE false),
a0 AS (SELECT seed, NULL::DOUBLE AS metric FROM seeds)"""]
    for e in range(RUN_EPOCHS):
        out.append(f"""g{e} AS MATERIALIZED (
  SELECT seed, r, c * cw * ({gamma} * pow(1 - pt, {gamma - 1}) * ln(pt) - pow(1 - pt, {gamma}) / pt) * pt * (y - p) AS g FROM (
    SELECT seed, r, y, c, p, greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 1e-12) AS pt, CASE WHEN y = 0 THEN {alpha} ELSE {1 - alpha} END AS cw FROM (
      SELECT m.seed, m.r, m.y, m.c, 1 / (1 + exp(-2 * sum(x * w))) AS p FROM m JOIN x USING (r) JOIN w{e} USING (seed, f) GROUP BY ALL))),
k{e} AS MATERIALIZED (
  SELECT seed, f, w - {lr} * (coalesce(s, 0) / n + {l2} * w) AS w
  FROM w{e} JOIN n USING (seed) LEFT JOIN (SELECT g.seed, x.f, sum(x * g) AS s FROM g{e} g JOIN x USING (r) GROUP BY ALL) USING (seed, f)),
b{e} AS (SELECT seed, batch, count(*) FILTER (WHERE y = 1 AND z > 0) AS tp, count(*) FILTER (WHERE y = 1 AND z <= 0) AS fn, count(*) FILTER (WHERE y = 0 AND z > 0) AS fp
         FROM (SELECT v.seed, v.r, v.y, v.batch, sum(x * w) AS z FROM v JOIN x USING (r) JOIN k{e} USING (seed, f) GROUP BY ALL) GROUP BY ALL),
a{e + 1} AS MATERIALIZED (
  SELECT seed, b.metric, CASE WHEN p.metric IS NULL OR b.metric > p.metric THEN 'save' WHEN b.metric < p.metric THEN 'reload' ELSE 'keep' END AS action
  FROM (SELECT seed, avg(CASE WHEN 10 * tp + 9 * fn + fp = 0 THEN 0.0 ELSE 10.0 * tp / (10.0 * tp + 9.0 * fn + fp) END) AS metric FROM b{e} GROUP BY seed) b
  JOIN a{e} p USING (seed)),
s{e + 1} AS MATERIALIZED (SELECT k.* FROM k{e} k JOIN a{e + 1} USING (seed) WHERE action = 'save'
                          UNION ALL SELECT s.* FROM s{e} s JOIN a{e + 1} USING (seed) WHERE action <> 'save'),
w{e + 1} AS MATERIALIZED (SELECT k.* FROM k{e} k JOIN a{e + 1} USING (seed) WHERE action <> 'reload'
                          UNION ALL SELECT s.* FROM s{e + 1} s JOIN a{e + 1} USING (seed) WHERE action = 'reload')""")
    out.append(f"""t AS (SELECT seed, sum((y = 1 AND z > 0)::INT)::DOUBLE AS tp, sum((y = 0 AND z > 0)::INT)::DOUBLE AS fp,
             sum((y = 1 AND z <= 0)::INT)::DOUBLE AS fn, sum((y = 0 AND z <= 0)::INT)::DOUBLE AS tn FROM (
  SELECT seed, te.r, te.y, sum(x * w) AS z FROM te JOIN xt USING (r) JOIN s{RUN_EPOCHS} USING (f) GROUP BY ALL) GROUP BY seed),
q AS (SELECT *, CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS r0,
             CASE WHEN 2 * tn + fn + fp > 0 THEN 2 * tn / (2 * tn + fn + fp) ELSE 0 END AS f0,
             CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r1,
             CASE WHEN 2 * tp + fn + fp > 0 THEN 2 * tp / (2 * tp + fn + fp) ELSE 0 END AS f1, tn + fp AS n0, tp + fn AS n1, tp + fp + fn + tn AS n FROM t)
SELECT row, metric, round(avg(value), 6) AS value, count(*)::BIGINT AS n_runs FROM (
  SELECT '0' AS row, unnest(['precision', 'recall', 'f1']) AS metric, unnest([p0, r0, f0]) AS value FROM q
  UNION ALL SELECT '1', unnest(['precision', 'recall', 'f1']), unnest([p1, r1, f1]) FROM q
  UNION ALL SELECT 'accuracy', 'f1', (tp + tn) / n FROM q
  UNION ALL SELECT 'macro avg', unnest(['precision', 'recall', 'f1']), unnest([(p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2]) FROM q
  UNION ALL SELECT 'weighted avg', unnest(['precision', 'recall', 'f1']), unnest([(p0 * n0 + p1 * n1) / n, (r0 * n0 + r1 * n1) / n, (f0 * n0 + f1 * n1) / n]) FROM q)
GROUP BY row, metric""")
    return ",\n".join(out)


@query("run_experiment", _run_sql())
def q_run_experiment(spark, sf_dir):
    """All five seeds, four epochs; md5 buckets, so that SQL can follow every step."""
    cfg = X.PRESETS["focal_balanced_fbeta"]
    cfg = X.ExperimentConfig(**{**cfg.__dict__, "n_features": RUN_NF, "epochs": RUN_EPOCHS, "seeds": tuple(RUN_SEEDS), "hashing": "md5"})
    out = X.run_experiment(labelled_docs(spark, sf_dir), cfg)
    return longs(out["averages"].select("row", "metric", r6("value").alias("value"), "n_runs"))
