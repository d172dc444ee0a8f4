"""Session construction and shared settings."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings of local sessions.  AQE re-plans joins at run time
# (broadcast when the measured side is small, skew splits otherwise);
# ANSI stays on, so operators use try_divide / get instead of raising forms.
# Static broadcast from file-size estimates is off: a side is broadcast only
# after textlab measured it, or when AQE measured its shuffle output.
DEFAULT_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpoint files are removed once their DataFrame is garbage collected
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "textlab", extra: dict | None = None) -> SparkSession:
    """A session.  Without a master (a cluster, spark-submit) every submitted setting is kept and
    only what is passed here is set; with one (tests, the bench) DEFAULT_CONF applies too."""
    b = SparkSession.builder.appName(app)
    conf = {}
    if master:
        b = b.master(master)
        conf = dict(DEFAULT_CONF)
        conf["spark.sql.shuffle.partitions"] = "8"
        conf["spark.driver.memory"] = os.environ.get("TEXTLAB_DRIVER_MEMORY", "16g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins.  Only a local-mode session with no
    setting (tests, the bench) gets a fresh scratch folder; on a cluster an
    unset value is an error, because a machine-local folder would not survive
    the loss of the executor that wrote it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    path = tempfile.mkdtemp(prefix="textlab-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Materialise ``df`` in the shared checkpoint folder (reliable, not local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_dir(spark: SparkSession, name: str = "io") -> str:
    """A fresh folder under the shared checkpoint folder (for interchange files)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/textlab-{name}-{uuid.uuid4().hex}"


def written(df, name: str = "table"):
    """``df`` as Parquet under the shared checkpoint folder, read again: computed once, cut from its lineage, and columns
    can be left unread (a checkpoint is read whole)."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
