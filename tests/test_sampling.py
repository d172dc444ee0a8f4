"""Splits are disjoint and complete, exact sizes hold, results do not depend on partitioning."""

from pyspark.sql import functions as F

from textlab.operators import indexing, sampling


def _df(spark, n=397, parts=4):
    return spark.range(n).repartition(parts).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("label"))


def test_exact_split_sizes_and_disjoint(spark):
    df = _df(spark)
    s = sampling.train_test_split(df, 0.2, 42, "row_id")
    rows = s.collect()
    assert len(rows) == 397 and len({r.row_id for r in rows}) == 397
    assert sum(r.split == "test" for r in rows) == round(0.2 * 397)
    v = sampling.validation_split(df, 0.1, 7, "row_id").collect()
    assert sum(r.split == "validation" for r in v) == int(397 * 0.1)


def test_validation_cut_of_zero_is_empty(spark):
    df = _df(spark, 9)
    v = sampling.validation_split(df, 0.1, 1, "row_id").collect()
    assert all(r.split == "train" for r in v)


def test_repeatable_across_partitionings(spark):
    outs = []
    for parts in (1, 4, 17):
        df = _df(spark, 300, parts)
        outs.append(sorted((r.row_id, r.shuffle_pos) for r in sampling.shuffle_order(df, 42, "row_id").collect()))
    assert outs[0] == outs[1] == outs[2]
    assert sorted(p for _, p in outs[0]) == list(range(300))


def test_oversample_equals_union(spark):
    df = _df(spark, 50)
    pos, neg = df.filter("label = 1"), df.filter("label = 0")
    a = sorted(tuple(r) for r in sampling.oversample_positives(df, 4).drop("copy_no").collect())
    b = sorted(tuple(r) for r in sampling.union_frames(pos, pos, neg, pos, pos).collect())
    assert a == b


def test_copies_stay_on_one_side(spark):
    df = sampling.oversample_positives(_df(spark, 200), 4)
    v = sampling.validation_split(df, 0.2, 3, "row_id").collect()
    sides = {}
    for r in v:
        sides.setdefault(r.row_id, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())


def test_dense_index_and_batches(spark):
    df = _df(spark, 101, 7)
    idx = indexing.assign_row_id(df, ["row_id"], "pos").collect()
    assert sorted(r.pos for r in idx) == list(range(101))
    assert all(r.pos == r.row_id for r in idx)
    b = indexing.assign_batches(df, 8, ["row_id"]).collect()
    sizes = {}
    for r in b:
        sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
    assert max(sizes) == 12 and sizes[12] == 5 and all(v == 8 for k, v in sizes.items() if k < 12)


def test_seed_grid_has_every_seed(spark):
    g = sampling.seed_grid(_df(spark, 10), [42, 67, 330, 2004, 945]).collect()
    assert len(g) == 50 and {r.seed for r in g} == {42, 67, 330, 2004, 945}


def test_exact_cut_per_group(spark):
    df = spark.range(600).select((F.col("id") % 3).alias("seed"), F.col("id").alias("row_id"))
    s = sampling.sample_fraction(df, 0.3, F.col("seed"), "row_id", exact=True, group=["seed"]).collect()
    per = {}
    for r in s:
        per[r.seed] = per.get(r.seed, 0) + 1
    assert per == {0: 60, 1: 60, 2: 60}
    v = sampling.validation_split(df, 0.2, F.col("seed"), "row_id", group=["seed"]).collect()
    assert sum(r.split == "validation" for r in v) == 3 * 40


def test_hash_batches_per_group(spark):
    from textlab.functions.hashing import hash_u32
    df = spark.range(60).select((F.col("id") % 2).alias("seed"), F.col("id").alias("row_id"))
    df = df.withColumn("_h", hash_u32(F.col("seed"), "row_id"))
    b = indexing.assign_hash_batches(df, 8, "_h", ["row_id"], group=["seed"]).collect()
    for seed in (0, 1):
        rows = [r for r in b if r.seed == seed]
        assert sorted(r.row_pos for r in rows) == list(range(30))
        sizes = {}
        for r in rows:
            sizes[r.batch_id] = sizes.get(r.batch_id, 0) + 1
        assert sizes == {0: 8, 1: 8, 2: 8, 3: 6}


def test_cut_among_equal_rows(spark):
    """Rows that repeat key and all, null keys, several histogram levels and a cut in the middle of equal rows."""
    rows = [(None, "a")] * 7 + [(1, "a")] * 30 + [(2, "b")] * 5 + [(None, None)] * 4 + [(3, "a")]
    df = spark.createDataFrame(rows, "row_id long, side string").repartition(3).withColumn("_h", F.col("row_id") * 1000)
    df = df.withColumn("_h", F.coalesce("_h", F.lit(4294967295)))
    for n in range(0, len(rows) + 2, 5):
        got = indexing.take_smallest(df, "_h", ["row_id"], F.lit(n), flag="small").collect()
        assert len(got) == len(rows) and sum(r.small for r in got) == min(n, len(rows))
        small = max((r._h for r in got if r.small), default=-1)
        assert all(r._h >= small for r in got if not r.small)
    per = indexing.take_smallest(df, "_h", ["row_id"], F.col("n") - 1, group=["side"]).groupBy("side").count().collect()
    assert {r.side: r["count"] for r in per} == {"a": 37, "b": 4, None: 3}


def test_cut_over_many_rows_in_levels(spark, monkeypatch):
    from textlab.functions.hashing import hash_u32
    df = spark.range(5000).select(F.col("id").alias("row_id"), (F.col("id") % 3).alias("side")).withColumn("_h", hash_u32(1, "row_id"))
    want = {(r.side, r.row_id) for r in df.orderBy("_h").limit(777).collect()}
    for rows, level in ((1024, 16), (8, 4), (1, 16), (1, 5)):
        monkeypatch.setattr(indexing, "BUCKET_ROWS", rows)
        monkeypatch.setattr(indexing, "LEVEL_BITS", level)
        assert {(r.side, r.row_id) for r in indexing.take_smallest(df, "_h", ["row_id"], F.lit(777)).collect()} == want
        per = indexing.take_smallest(df, "_h", ["row_id"], F.floor(F.col("n") * 0.25), flag="small", group=["side"])
        assert per.filter("small").count() == 416 + 416 + 416
        assert per.filter("small").agg(F.max("_h")).first()[0] < per.filter("not small").agg(F.max("_h")).first()[0]


def test_exact_split_reads_its_input_twice(spark):
    """The input's files are in two scans: one for keys, one for the rows, and no row is shuffled."""
    import contextlib
    import io
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("row_id"), "text")
    out = sampling.train_test_split(df, 0.2, 42)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        out.explain("simple")
    assert text.getvalue().count("FileScan") == 1 and "Exchange" not in text.getvalue()
    assert sorted(out.groupBy("split").count().collect()) == [("test", 40), ("train", 160)]
