"""Physical plan checks: pushed filters, no cartesian products, broadcast where intended."""

from textlab.registry import QUERIES, load_catalog
from tests.conftest import SF_SMALL

load_catalog()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_label_corpus_broadcasts_publications_and_prunes_columns(spark):
    df = QUERIES["label_corpus"](spark, SF_SMALL)
    plan = _plan(df)
    assert "BroadcastHashJoin" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # only the columns the query needs are read from documents
    assert "n_chars" not in plan


def test_contain_pairs_has_no_nested_loop(spark):
    plan = _plan(QUERIES["contain_pairs"](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_label_filter_pushes_down(spark):
    plan = _plan(QUERIES["label_filter"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(toxic), EqualTo(toxic,1)]" in plan


def test_no_registered_query_uses_a_cartesian_product(spark):
    bad = []
    for key in ["split_profile", "balance_classes", "train_test_split_80_20", "pr_curve", "encode_tokens",
                "classification_report", "span_corpus", "seed_grid"]:
        p = _plan(QUERIES[key](spark, SF_SMALL))
        if "CartesianProduct" in p or "BroadcastNestedLoopJoin" in p:
            bad.append(key)
    assert not bad


def test_read_folds_prunes_partitions(spark):
    from textlab.session import scratch_dir
    from textlab.sources import fixtures as fx, readers, writers
    root = scratch_dir(spark, "folds")
    writers.write_folds(fx.folds(spark, SF_SMALL), root)
    df = readers.read_folds(spark, root, "train")
    plan = _plan(df)
    import re
    assert re.search(r"PartitionFilters: \[isnotnull\(split#\d+\), \(split#\d+ = train\)\]", plan)
    assert df.select("split").distinct().collect()[0][0] == "train"


def test_label_corpus_filters_below_the_join(spark):
    df = QUERIES["label_corpus"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    join_at = plan.index("BroadcastHashJoin")
    # the length filters sit under the join, on the section side
    import re
    assert re.search(r"length\(section_txt#\d+\)", plan[join_at:])


def test_folds_are_written_without_a_sort_by_folder(spark, tmp_path):
    """The many copies of a paragraph go to their folders as they come; no setting stays changed."""
    from textlab.sources import readers, writers
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    df = spark.range(2000, numPartitions=1).selectExpr("cast(id as string) AS id", "cast(id % 10 as int) AS fold", "if(id % 3 = 0, 'test', 'train') AS split")
    writers.write_folds(df, str(tmp_path / "folds"))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    back = readers.read_folds(spark, str(tmp_path / "folds"), None)
    assert sorted(map(tuple, back.select("id", "fold", "split").collect())) == sorted(map(tuple, df.collect()))
    assert all(f.endswith(".zstd.parquet") for f in back.inputFiles()) and len(back.inputFiles()) == 20


def test_dedup_leaves_unused_texts_behind(spark):
    """What follows the digest carries no text that the caller does not use."""
    from textlab.operators import cleaning
    df = spark.createDataFrame([(1, "t", "a"), (2, "t", "b"), (3, None, "c")], "pos long, section_txt string, dataset string")
    kept = cleaning.dedup_keep_first(df, ["section_txt"], ["pos"])
    assert sorted(map(str, kept.collect())) == sorted(map(str, df.filter("pos <> 2").collect())) and kept.columns == df.columns
    plan = _plan(kept.select("pos", "dataset"))
    import re
    for step in re.findall(r"(?:Sort |Exchange ).*", plan):
        assert "section_txt" not in step
    assert not re.search(r"first\(section_txt", plan) and not re.search(r"struct\([^)]*section_txt", plan)


def test_the_span_split_works_its_rows_out_once(spark):
    """Both readings of the split take written rows, no dedup of the folds."""
    plan = _plan(QUERIES["span_split_profile"](spark, SF_SMALL))
    assert "documents.parquet" not in plan and "Generate" not in plan
