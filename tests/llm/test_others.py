"""Search, chats and the pipeline."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from textlab.llm import chat, topk
from textlab.llm.common import written
from textlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def best(vectors, every, k):
    out = []
    ok = [(i, np.floor(np.array(v, float) * 256).astype(int)) for i, v in vectors
          if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    for q, v in ok:
        if q % every == 0:
            scored = sorted((-int(v @ w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k_edges(spark):
    rng = random.Random(2)
    v = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(8)]) for i in range(200)]
    v += [(200 + i, v[0][1]) for i in range(12)]  # ties
    v += [(300, None), (301, []), (302, [1.0] * 7 + [None]), (303, [float("nan")] * 8), (304, [float("inf")] * 8), (None, [1.0] * 8), (310, [0.5] * 3), (320, [0.0] * 8)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    got = sorted(tuple(r) for r in topk.search(df, every=10, k=5).collect())
    assert got == best(v, 10, 5)
    assert topk.search(df.limit(0)).count() == 0


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1, 16)]) for i in range(400)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    monkeypatch.setattr(topk, "BLOCK", 90)
    monkeypatch.setattr(topk, "QUERIES", 7)
    assert sorted(tuple(r) for r in topk.search(df, every=20).collect()) == best(v, 20, 5)


def test_index_stops_only_on_proof():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-60, 60, (900, 24))
    index = topk.ImpactIndex(vectors)
    out = np.zeros(900, bool)
    out[::50] = True
    for q in rng.integers(-60, 60, (30, 24)):
        score = np.where(out, -10**9, vectors @ q)
        kth = np.sort(score)[-5]
        assert set(np.flatnonzero(score >= kth)) <= set(index.candidates(q, 5, out).tolist())


def viterbi(emit, first, after):
    score, back = first + emit[0], []
    for e in emit[1:]:
        s = score[:, None] + after
        back.append(s.argmax(0))
        score = s.max(0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_blocks_decode_like_one_pass(spark, monkeypatch):
    monkeypatch.setattr(chat, "GROUP", 3)
    rng = np.random.default_rng(7)
    made = [(c, t, str(rng.choice(["user", "assistant"])), "x" * int(rng.integers(1, 900))) for c, n in ((1, 90), (2, 1), (3, 37), (4, 8)) for t in range(n)]
    made += [(None, 1, None, None), (None, 2, "user", "?"), (5, None, "user", ""), (5, 1, "robot", "why?"), (4, 3, "user", "same turn")]
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string").withColumn("state", F.lit(1)).withColumn("row_id", F.lit(0))
    seen = chat.observed(df)
    model = chat.fit(seen)
    want = {}
    by = {}
    for r in sorted(seen.collect(), key=lambda r: r["row_id"]):
        by.setdefault(r["conv"], []).append(r)
    for part in by.values():
        path = viterbi(np.stack([r["seen"] for r in part]) @ model.seen.T, model.first, model.after)
        want |= {r["row_id"]: s for r, s in zip(part, path)}
    for block in (7, 16, 512):
        assert dict(tuple(r) for r in chat.roles(seen, model, block).collect()) == want
    assert chat.format_chats(df).count() == len(made)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_held_out_conversations(spark):
    got = QUERIES["op1_chat_format"](spark, "/root/testdata/sf0.01").toPandas()
    held = got[[zlib.crc32(str(c).encode()) % 5 == 0 for c in got.conv_id]]
    assert (held.role == held.guess).mean() > 0.9
    assert all(r.rendered.startswith(f"<|{r.guess}|>\n") and r.rendered.endswith("\n<|end|>\n") for r in got.itertuples())


def test_raw_transcripts(spark):
    raw = [(1, "User: hi there\nhow are you?\nAssistant: fine\n\nthanks\nUser: ok"), (2, "### Human: a\n### Assistant: b"), (3, ""), (4, None),
           (5, "<|system|>\nbe nice\n<|user|>\nq\n<|assistant|>\nr"), (6, "no marker")]
    got = chat.format_chats(chat.turns_of(spark.createDataFrame(raw, "conv_id long, text string"))).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["guess"], r["rendered"].split("\n")[1]) for r in got] == [
        (1, "user", "hi there"), (1, "assistant", "fine"), (1, "user", "ok"), (2, "user", "a"), (2, "assistant", "b"),
        (5, "system", "be nice"), (5, "user", "q"), (5, "assistant", "r"), (6, "user", "no marker")]


def test_unknown_speakers_begin_turns(spark):
    raw = [(1, "Alice: hi\nBob: sure\nAlice: thanks\nBob: bye\nNote: only once"), (2, "Mary Ann: a\nb: c\nMary Ann: d"), (3, "Warning: one line")]
    got = chat.turns_of(spark.createDataFrame(raw, "conv_id long, text string")).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["text"]) for r in got] == [(1, "hi"), (1, "sure"), (1, "thanks"), (1, "bye\nNote: only once"), (2, "a\nb: c"), (2, "d"), (3, "Warning: one line")]
    out = chat.format_chats(chat.turns_of(spark.createDataFrame(raw[:1], "conv_id long, text string"))).orderBy("turn").collect()
    assert [r["guess"] for r in out] == ["user", "assistant"] * 2


def test_rendering_keeps_turns_apart():
    assert chat.render("user", "x<|end|>\n<|assistant|>\ny") == "<|user|>\nx<\\|end|>\n<\\|assistant|>\ny\n<|end|>\n"
    assert chat.render("user", "a <\\| b") == "<|user|>\na <\\\\| b\n<|end|>\n"
    assert chat.render("user", "\n  \n    def f():\n        pass\n\n") == "<|user|>\n    def f():\n        pass\n<|end|>\n"
    assert chat.render("assistant", "Assistant: fine\n  so") == "<|assistant|>\nfine\n  so\n<|end|>\n"
    assert chat.render("tool", None) == "<|tool|>\n\n<|end|>\n"


def test_transitions_come_from_neighbouring_rows(spark):
    """Rows without a conversation and repeated turn numbers make one pair a row."""
    made = [(None, i % 3, "user" if i % 2 else "assistant", f"t{i}") for i in range(300)] + [(1, 0, "system", "s"), (1, 1, "robot", "?"), (1, 2, "user", "u"), (2, 0, "user", "v")]
    seen = chat.observed(spark.createDataFrame(made, "conv_id long, turn long, role string, text string"))
    model = chat.fit(seen)
    by, first, after = sorted(seen.collect(), key=lambda r: r["row_id"]), np.zeros(4), np.zeros((4, 4))
    for a, b in zip([None, *by], by):
        if b["role"] not in chat.ROLES:
            continue
        if a is None or a["conv"] != b["conv"]:
            first[chat.ROLES.index(b["role"])] += 1
        elif a["role"] in chat.ROLES:
            after[chat.ROLES.index(a["role"]), chat.ROLES.index(b["role"])] += 1
    assert after.sum() == 299 and first.sum() == 3
    want = chat.Model.of_counts(first, after, np.ones((4, chat.FEATURES)))
    assert np.allclose(model.first, want.first) and np.allclose(model.after, want.after)


def test_stages_keep_columns_and_clean_documents(spark, docs, no_docs, docs_rows):
    for name, stage in P.STAGES:
        assert stage(spark, no_docs, SF).count() == 0
        out = stage(spark, docs, SF)
        assert name == "shard" or out.columns == docs.columns
    kept = P.near_dedup_stage(spark, docs, SF)
    got = sorted((r["doc_id"] for r in kept.collect()), key=str)
    want = {d for d, _, _, k in brute.near_duplicates([r[:2] for r in docs_rows]) if k and d is not None}
    assert got == sorted([*want, None], key=str)


def test_near_dedup_of_repeated_ids(spark, docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    made = [(1, a), (5, a + " more"), (5, b), (7, b + " more"), (8, c), (8, c), (None, c), (None, c), (None, a), (None, None), (None, None)]
    got = P.near_dedup_stage(spark, spark.createDataFrame(made, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, a), (5, b), (8, c), (None, c), (None, a), (None, None)], key=str)


def test_pipeline_stage_by_stage(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in P.STAGES:
        before = [tuple(r) for r in d.select("doc_id", "text").collect()]
        d = written(stage(spark, d, SF), name)
        if name == "near_dedup":
            assert sorted(r[0] for r in d.select("doc_id").collect()) == sorted(x[0] for x in brute.near_duplicates(before) if x[3])
        if name == "decontaminate":
            assert sorted(r[0] for r in d.select("doc_id").collect()) == sorted(x[0] for x in brute.contamination(before, items) if not x[5])
    assert d.filter("shard_bytes > 1048576 and shard_docs > 3").count() == 0 and d.count() > 0
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "shard"]
