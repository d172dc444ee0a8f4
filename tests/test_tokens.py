"""Token windows, special tokens, padding and masks."""

import pytest
from pyspark.sql import functions as F

from textlab.functions import arrays as A
from textlab.operators import tokens


def _window(spark, n, h, k):
    df = spark.createDataFrame([([str(i) for i in range(n)],)], "t array<string>")
    return df.select(A.head_tail_window(F.col("t"), h, k).alias("w")).first().w


@pytest.mark.parametrize("n", [0, 3, 5, 7, 12, 13])
def test_head_tail_window_matches_python_slices(spark, n):
    h, k = 5, 7
    t = [str(i) for i in range(n)]
    expected = t[:h] + t[-k:] if n else []
    assert _window(spark, n, h, k) == expected


def test_tail_zero_keeps_no_tail(spark):
    assert _window(spark, 10, 3, 0) == ["0", "1", "2"]


def test_pad_and_mask(spark):
    df = spark.createDataFrame([([2, 7, 3],)], "ids array<int>")
    r = df.select(A.pad_to_length(F.col("ids"), 6).alias("p")).withColumn("m", A.attention_mask("p")).first()
    assert r.p == [2, 7, 3, 0, 0, 0] and r.m == [1, 1, 1, 0, 0, 0]
    with pytest.raises(Exception):
        df.select(A.pad_to_length(F.col("ids"), 2)).collect()


def test_vocab_reserves_ids_and_encodes_unknown(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, "a z")], "row_id long, text string")
    t = tokens.tokenize(df, "text")
    v = tokens.build_vocab(t, max_size=2)
    ids = {r.token: r.id for r in v.collect()}
    assert ids == {"a": 4, "b": 5}
    enc = {r.row_id: r.ids for r in tokens.encode_tokens(t, v).collect()}
    assert enc == {1: [4, 5, 4, 1], 2: [4, 1]}
    full = tokens.encode_text(df, v, "text", 1, 1, pad_to="max").collect()
    assert {r.row_id: r.input_ids for r in full} == {1: [2, 4, 1, 3], 2: [2, 4, 1, 3]}


def test_encode_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, ["a", "b", None]), (1, ["a", "b", None]), (None, ["b"]), (2, None), (3, [])],
                               "row_id long, tokens array<string>")
    v = spark.createDataFrame([("a", 4), ("b", 5)], "token string, id int")
    e = tokens.encode_tokens(df, v)
    assert sorted(map(str, (r.ids for r in e.collect()))) == sorted(map(str, ([4, 5, 1], [4, 5, 1], [5], [], [])))
    assert "Exchange" not in e._jdf.queryExecution().executedPlan().toString()
    j = tokens.encode_tokens(df, v, max_broadcast_bytes=0)  # by a join
    assert sorted(str((r.row_id, r.ids)) for r in j.collect()) == sorted(str((r.row_id, r.ids)) for r in e.collect())
    assert j.columns == e.columns


def test_vocab_ties_at_the_cut(spark):
    text = " ".join(["common"] * 5 + [f"w{i}" for i in range(30)] + [f"v{i}" for i in range(10)] * 2)
    df = tokens.tokenize(spark.createDataFrame([(1, text)], "row_id long, text string"), "text")
    small = sorted(tuple(r) for r in tokens.build_vocab(df, max_size=15).collect())
    assert len(small) == 15
    got = {r[0] for r in small}
    assert "common" in got and all(f"v{i}" in got for i in range(10))  # counts 5 and 2 beat the ties at 1


def test_encode_in_slices(spark):
    """A batch is worked off in slices; nulls, empty and long rows come out as from one go."""
    import pyarrow as pa
    lists = pa.array([["a", "b", None], None, [], ["z"] * 9, ["b"], None])
    want = [[4, 5, 1], [], [], [1] * 9, [5], []]
    for size in (1, 2, 3, 100):
        assert tokens._encoder(size)(lists, {"a": 4, "b": 5}).to_pylist() == want
        assert tokens._encoder(size)(lists.slice(2, 3), {"a": 4, "b": 5}).to_pylist() == want[2:5]
    assert tokens._encoder()(lists.slice(0, 0), {}).to_pylist() == []


def test_join_encoding_looks_up_no_map(spark):
    """A row's dictionary is no map, which each token would search from its beginning: a long row of distinct tokens."""
    n = 3000
    df = spark.createDataFrame([(1, [f"t{i}" for i in range(n)] + ["t7", "new"]), (2, ["t5"]), (3, ["none"])], "row_id long, tokens array<string>")
    v = spark.createDataFrame([(f"t{i}", 4 + i) for i in range(n)], "token string, id int")
    e = tokens.encode_tokens(df, v, max_broadcast_bytes=0)
    assert "map_from_entries" not in e._jdf.queryExecution().optimizedPlan().toString()
    got = {r.row_id: r.ids for r in e.collect()}
    assert got == {1: [*range(4, n + 4), 11, 1], 2: [9], 3: [1]}
