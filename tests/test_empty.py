"""Operators accept empty inputs and return empty (or zero) results."""

from pyspark.sql import functions as F

from textlab.operators import indexing, labeling, sampling, tokens


def test_empty_inputs(spark):
    secs = spark.createDataFrame([], "file_id long, pos int, section_title string, section_txt string")
    ann = spark.createDataFrame([], "row_no long, id long, pub_title string, mention string")
    assert labeling.label_sections(secs, labeling.build_publications(ann)).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert labeling.contain_pairs(docs, items).count() == 0
    ids = spark.createDataFrame([], "row_id long, label int")
    assert sampling.sample_fraction(ids, 0.2, 42, "row_id", exact=True).count() == 0
    assert sampling.validation_split(ids, 0.1, 42, "row_id").count() == 0
    assert indexing.assign_row_id(ids, ["row_id"]).count() == 0
    t = spark.createDataFrame([], "row_id long, tokens array<string>")
    assert tokens.build_vocab(t, max_size=5).count() == 0


def test_documents_without_short_or_keyed_passages(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta")], "doc_id long, text string")
    only_long = spark.createDataFrame([(5, "alpha beta gamma")], "item_id long, text string")
    assert [tuple(r) for r in labeling.contain_pairs(docs, only_long).collect()] == [(1, 5)]
    only_short = spark.createDataFrame([(6, "ma del"), (7, "ta del")], "item_id long, text string")
    assert [tuple(r) for r in labeling.contain_pairs(docs, only_short).collect()] == [(1, 6)]
