"""Interchange formats written the way plain Python writes them, read back by textlab."""

import csv
import json
import os
import tempfile

from textlab.sources import readers


def test_sections_json_one_file_per_publication(spark):
    d = tempfile.mkdtemp(prefix="textlab-json-", dir="/tmp")
    pubs = {"abc-1": [{"section_title": "Intro", "text": "We use the X data."}, {"section_title": "", "text": "tail"}],
            "def-2": [{"section_title": "Only", "text": "line one\nline two"}]}
    for pid, secs in pubs.items():
        with open(os.path.join(d, f"{pid}.json"), "w") as f:
            json.dump(secs, f)
    got = sorted(tuple(r) for r in readers.read_sections_json(spark, d).collect())
    assert got == [("abc-1", 0, "Intro", "We use the X data."), ("abc-1", 1, "", "tail"),
                   ("def-2", 0, "Only", "line one\nline two")]


def test_dollar_csv_written_by_python_csv_module(spark):
    d = tempfile.mkdtemp(prefix="textlab-csv-", dir="/tmp")
    rows = [("file_id", "publication_name", "section_title", "dataset", "label", "section_txt"),
            ("a", "P", "T", "None", "0", 'costs $5 and "quoted"'),
            ("b", "Q", "U", "ds", "1", "two\nlines $ here")]
    with open(os.path.join(d, "train.csv"), "w", newline="") as f:
        csv.writer(f, delimiter="$").writerows(rows)
    df = readers.read_delimited(spark, d, readers.SECTION_TABLE)
    got = sorted((r.file_id, r.dataset, r.label, r.section_txt) for r in df.collect())
    assert got == [("a", "None", 0, 'costs $5 and "quoted"'), ("b", "ds", 1, "two\nlines $ here")]


def test_epoch_log_overwrites_only_its_run(spark):
    from textlab.session import scratch_dir
    from textlab.sources import writers
    path = scratch_dir(spark, "epochs")
    a = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.6), (2, 0, 0.7)], "run long, epoch long, loss double")
    writers.write_epoch_log(a, path)
    b = spark.createDataFrame([(1, 0, 0.9)], "run long, epoch long, loss double")
    writers.write_epoch_log(b, path)  # run 1 is replaced, run 2 stays
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("run", "epoch", "loss").collect())
    assert got == [(1, 0, 0.9), (2, 0, 0.7)]


def test_appends_keep_their_order_and_replace_on_retry(spark):
    from pyspark.sql import functions as F

    from textlab.session import scratch_dir
    from textlab.sources import appends, readers, writers
    path = scratch_dir(spark, "report")

    def report(*runs):
        return spark.createDataFrame([(r, i, f"{r}-{i}") for r in runs for i in range(3)], "run long, line_no long, line string").repartition(3)

    assert writers.append_test_report(report(7), path, "a") == 0
    assert writers.append_test_report(report(1, 2), path, "b") == 1
    assert writers.append_test_report(report(0), path, "c") == 2
    assert writers.append_test_report(report(2, 3), path, "b") == 1  # a retry
    # data without its line in the log is not there
    report(9).groupBy("run").agg(F.max("line").alias("value")).write.partitionBy("run").text(f"{path}/data/append=3")
    got = [tuple(r) for r in readers.read_appended_report(spark, path).orderBy("line_no").collect()]
    assert [g[2] for g in got] == list(range(12))
    assert [g[3] for g in got] == [f"{r}-{i}" for r in (7, 2, 3, 0) for i in range(3)]
    assert sorted(tuple(r) for r in appends.commits(spark, path).collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_metrics_are_logged_once(spark):
    from textlab.session import scratch_dir
    from textlab.sources import readers, writers
    path = scratch_dir(spark, "metrics")
    m = spark.createDataFrame([(1, 0, 0.5, 0.1), (1, 1, 0.6, 0.2), (2, 0, 0.7, 0.3)], "run long, step long, loss double, acc double")
    writers.log_metrics(m, path, ["run"], ["loss", "acc"], name="x")
    writers.log_metrics(m, path, ["run"], ["loss", "acc"], name="x")
    writers.log_metrics(m.filter("step = 1").withColumn("loss", m["loss"] + 1), path, ["run"], ["loss"])
    got = sorted(tuple(r) for r in readers.read_metrics(spark, path, ["run"]).collect())
    assert got == [(1, 0, "acc", 0.1), (1, 0, "loss", 0.5), (1, 1, "acc", 0.2), (1, 1, "loss", 1.6), (2, 0, "acc", 0.3), (2, 0, "loss", 0.7)]
