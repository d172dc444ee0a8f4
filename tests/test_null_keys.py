"""Rows with null keys or labels are dealt with like any other; sessions and reports keep what they are given."""

import pytest
from pyspark.sql import functions as F

from textlab.functions.hashing import digest
from textlab.operators import cleaning, reports, sampling
from textlab.session import build_session
from textlab.sources import readers


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i if i else None, None if i == 3 else i % 2, "t") for i in range(11)],
                                 "row_id long, label int, text string")


def test_splits_keep_null_keys(rows):
    for out in (sampling.train_test_split(rows), sampling.ordered_split(rows), sampling.validation_split(rows),
                sampling.shuffle_order(rows, 1, "row_id"), sampling.shuffle_rows(rows, 1, "row_id"),
                sampling.sample_fraction(rows, 1.0, 1, "row_id", exact=True), sampling.sample_fraction(rows, 1.0, 1, "row_id")):
        assert out.count() == 11 and out.filter("row_id is null").count() == 1


def test_undersample_passes_null_labels(rows):
    for exact in (False, True):
        out = sampling.undersample(rows, {0: 0.0}, 1, "row_id", exact=exact)
        assert out.filter("label is null").count() == 1 and out.filter("label = 1").count() == rows.filter("label = 1").count()


def test_digest_tells_columns_and_nulls_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("abc", ""), ("abc", None), (None, "abc"), ("", "abc")], "x string, y string")
    assert df.select(digest("x", "y")).distinct().count() == 6
    same = spark.createDataFrame([(None, 1), (None, 2), ("", 3)], "x string, o int")
    assert sorted(r.o for r in cleaning.dedup_keep_first(same, ["x"], ["o"]).collect()) == [1, 3]


def test_texts_are_no_shuffle_keys(spark):
    import re

    from textlab.registry import QUERIES, load_catalog
    load_catalog()
    for key in ("label_corpus", "dedup_keep_first", "clean_funnel", "dedup_cascade", "span_corpus"):
        plan = QUERIES[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan):
            assert not re.search(r"\b(section_txt|text)#", keys), (key, keys)


def test_eight_reports_are_eight_records(spark):
    cm = spark.createDataFrame([(r, 5 + r, 2, 3, 9) for r in range(8)], "run int, tp long, fp long, fn long, tn long")
    framed = reports.frame_report_records(reports.format_appended_report(cm))
    assert framed.select("record").distinct().count() == 8
    assert reports.parse_appended_report(framed).count() == 8


def test_a_session_without_a_master_keeps_what_was_submitted(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert build_session().conf.get("spark.sql.shuffle.partitions") == "13"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_leading_zeros_and_the_order_of_files(spark, tmp_path):
    for i, text in (("007", "a"), ("012", "b")):
        d = tmp_path / "json" / f"file_id={i}" / "chunk=0"
        d.mkdir(parents=True)
        (d / "p.txt").write_text('[{"section_title": "t", "text": "%s"}]' % text)
    back = readers.read_sections_json(spark, str(tmp_path / "json"), id_from="partition")
    assert sorted(r.file_id for r in back.collect()) == ["007", "012"]
    (tmp_path / "csv").mkdir()
    head = "id,pub_title,dataset_title,dataset_label,cleaned_label\n"
    (tmp_path / "csv" / "a.csv").write_text(head + "x,first,d,l,c\n")
    (tmp_path / "csv" / "b.csv").write_text(head + "".join(f"x,later {i},d,l,c\n" for i in range(500)))
    ann = readers.read_annotations(spark, str(tmp_path / "csv"))
    assert ann.orderBy("row_no").first().pub_title == "first"
    from textlab.operators.labeling import build_publications
    assert build_publications(ann, "id", "pub_title", ("dataset_title",)).first().publication_name == "first"
    assert [r.pub_title for r in ann.filter(F.col("row_no.file").endswith("b.csv")).orderBy("row_no").collect()] == [f"later {i}" for i in range(500)]
