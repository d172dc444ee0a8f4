"""Operators on documents against plain Python, on awkward rows and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import decontaminate, line_dedup, mixing, near_dedup, pii, quality, sharding, suffix_dedup
from textlab.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def texts(spark):
    return rows(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert got.equals(want.astype(got.dtypes.to_dict()))


# ---- near duplicates ----

def test_near_duplicates_table(spark):
    assert rows(QUERIES["op2_near_dedup"](spark, SF)) == brute.near_duplicates(texts(spark))


def test_near_duplicates_edges(docs, docs_rows, no_docs):
    assert rows(near_dedup.near_duplicates(docs)) == brute.near_duplicates([r[:2] for r in docs_rows])
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_near_duplicates_past_the_hub(spark):
    """A group larger than SMALL whose links do not all run through its smallest member."""
    rng = random.Random(3)
    base = [f"t{i}" for i in range(160)]
    made, last = [], base
    for d in range(120):
        w = list(last if d % 3 else base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        made.append((d, " ".join(w)))
        last = w
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(near_dedup.near_duplicates(df)) == brute.near_duplicates(made)


def test_components_of_a_path_and_a_star(spark):
    from textlab.llm.components import components
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (None, 3)]
    got = dict(rows(components(spark.createDataFrame(edges, "u long, v long"))))
    assert got == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 60)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---- repeated bytes ----

def test_repeated_bytes_table(spark):
    assert rows(QUERIES["op9_suffix_dedup"](spark, SF)) == sorted(brute.repeated_bytes(texts(spark)), key=str)


def test_repeated_bytes_edges(docs, docs_rows, no_docs):
    seen, unique = set(), []
    for d, t, *_ in docs_rows:
        if d is not None and d not in (11, 12):
            unique.append((d, t))
    got = rows(suffix_dedup.removed(docs.filter("doc_id not in (11, 12)")), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.repeated_bytes(unique), key=str)
    assert suffix_dedup.removed(no_docs).count() == 0
    every = suffix_dedup.removed(docs)  # repeated ids and a null one
    assert every.count() == len(docs_rows)
    assert len({tuple(r)[1:] for r in every.filter("doc_id = 11").collect()}) == 1


@pytest.mark.parametrize("seed", range(3))
def test_repeated_bytes_random(spark, seed):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randint(40, 260))) for _ in range(12)] + ["a" * 300, "ab" * 120, "é" * 90]
    made = [(d, "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for d in range(40)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    assert rows(suffix_dedup.removed(df).drop("kept")) == sorted(brute.repeated_bytes(made), key=str)


def test_repeated_bytes_of_texts_that_share_an_id(spark):
    """A thousand different texts without a doc_id or with the same few: nothing unique goes, nothing crashes, and what repeats goes."""
    rng = random.Random(11)
    made = [(d, "".join(rng.choice("abcdefgh") for _ in range(rng.randint(90, 330)))) for d in [None] * 600 + [7] * 300 + [8, 9] * 50]
    shared = "".join(rng.choice("xyz") for _ in range(150))
    df = spark.createDataFrame(made + [(3, shared), (10, "q" * 50 + shared + "r" * 20)], "doc_id long, text string").repartition(3)
    out = suffix_dedup.removed(df).collect()
    assert len(out) == len(made) + 2
    gone = sorted((r["doc_id"], r["n_removed"]) for r in out if r["n_removed"])
    assert gone == [(10, 150)]
    want = Counter((d, hashlib.sha256(t.encode()).hexdigest()) for d, t in made)
    assert Counter((r["doc_id"], r["kept_sha256"]) for r in out if r["doc_id"] not in (3, 10)) == want


def test_kept_bytes_have_the_digest(docs):
    for r in suffix_dedup.removed(docs).collect():
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"]


# ---- decontamination ----

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "one two"), (3, "the"), (4, ""), (5, None), (2, "same id"), (None, "line three")]


def test_contamination_table(spark):
    want = brute.contamination(texts(spark), rows(spark.read.parquet(f"{SF}/benchmark.parquet"), "item_id", "text"))
    assert rows(QUERIES["op6_decontaminate"](spark, SF)) == sorted(want, key=str)


@pytest.mark.parametrize("words", [1 << 20, 7])
def test_contamination_edges(spark, docs, docs_rows, no_docs, words):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("spans", F.lit(1))
    want = brute.contamination([r[:2] for r in docs_rows], [("null" if i is None else i, t) for i, t in ITEMS])
    assert rows(decontaminate.digests(decontaminate.contamination(docs, bench, item_words=words))) == sorted(want, key=str)
    assert decontaminate.contamination(no_docs, bench, item_words=words).count() == 0
    clean = decontaminate.digests(decontaminate.contamination(docs, bench.limit(0)))
    assert clean.count() == len(docs_rows) and not clean.filter("contaminated").count()


def test_spans_are_the_bytes_of_the_hits(spark):
    d = spark.createDataFrame([(1, "Ü one, TWO three")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    (s,) = decontaminate.contamination(d, b).first()["spans"]
    assert "Ü one, TWO three".encode()[s["b"]:s["f"]] == b"one, TWO" and (s["w"], s["e"]) == (1, 3)


def test_fm_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(5)
    seq = np.append(rng.integers(1, 5, 400), 0)
    index = decontaminate.FMIndex(seq)
    for n in (1, 2, 3, 6):
        p = np.stack([seq[i:i + n] for i in range(0, 380, 7)])
        low, high = index.search(p, np.full(len(p), n))
        for q, a, b in zip(p, low, high):
            want = [i for i in range(len(seq) - n + 1) if (seq[i:i + n] == q).all()]
            assert sorted(index.locate(np.arange(a, b))) == want


# ---- lines ----

def brute_lines(made):
    """Chunks as the operator cuts them; which of them repeat, and what remains, by plain Python."""
    seen, out = {}, {}
    for d, t in sorted(made, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        data, off = np.frombuffer(b, np.uint8), np.array([0, len(b)])
        s, e, n, _, _ = line_dedup.chunk_lines(data, off)
        kept, lines, chunks = b"", 0, 0
        for x, y, k in zip(s, e, n):
            c = b[x:y]
            if k >= 2 and c in seen and seen[c] != (d, x):
                lines, chunks = lines + int(k), chunks + 1
            else:
                if k >= 2:
                    seen[c] = (d, x)
                kept += c
        total = len(re.findall(rb"[^\n]*\n|[^\n]+$", b))
        out.setdefault(d, []).append((d, total, lines, chunks, hashlib.sha256(kept).hexdigest()))
    return sorted((x for v in out.values() for x in v), key=str)


def test_lines(spark, docs, docs_rows, no_docs):
    assert rows(QUERIES["op5_line_dedup"](spark, SF)) == brute_lines(texts(spark))
    assert rows(line_dedup.dedup_lines(docs).drop("kept")) == brute_lines([r[:2] for r in docs_rows])
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_chunks_survive_insertions(spark):
    rng = random.Random(1)
    passage = [f"line {rng.random()}" for _ in range(60)]
    made = [(i, "\n".join([f"own {i} {j}" for j in range(i)] + passage + [f"end {i}"])) for i in range(5)]
    got = line_dedup.dedup_lines(spark.createDataFrame(made, "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["n_removed_lines"] == 0 and all(r["n_removed_lines"] > 40 for r in got[1:])


def test_recall_of_short_passages():
    """Passages of two documents, with four own lines before and after: how many of their lines are found."""
    rng = random.Random(4)

    def own(n):
        return [f"{rng.random()}" for _ in range(n)]

    found = {}
    for size in (2, 4, 6, 10, 20):
        for _ in range(300):
            passage = own(size)
            b = ["\n".join(own(4) + passage + own(4)).encode() for _ in range(2)]
            off = np.array([0, len(b[0]), len(b[0]) + len(b[1])])
            _, _, n, d, row = line_dedup.chunk_lines(np.frombuffer(b"".join(b), np.uint8), off)
            assert set(n) <= {2, 3}
            found[size] = found.get(size, 0) + n[(row == 1) & np.isin(d, d[row == 0])].sum() / size / 300
    assert all(found[n] > share for n, share in {2: 0.07, 4: 0.3, 6: 0.5, 10: 0.68, 20: 0.83}.items())


def test_boundaries_are_those_of_one_by_one():
    rng = np.random.default_rng(5)
    for _ in range(300):
        group = np.sort(rng.integers(0, 3, rng.integers(0, 40)))
        rank = rng.integers(0, rng.choice([2, 5, 1000]), len(group))
        taken = set()
        for i in sorted(range(len(rank)), key=lambda i: (rank[i], i)):
            if not any(j in taken and group[j] == group[i] for j in (i - 1, i + 1)):
                taken.add(i)
        assert set(np.flatnonzero(line_dedup.boundaries(rank, group))) == taken


# ---- personal data ----

HARD = ["a@b.c_x@d.e 1.2.3.4.5.6.7.8 999.1.1.1 +1 (988) 555-2485 4111 1111 1111 1111x4111111111111111", "😀 é a@b.co +123456789012 ",
        "1" * 3000, "1 " * 3000, "a.b@" + "c." * 3000 + "d", "+" + "1" * 3000, "@@@ a@b a@b. a@b..c a@-.-", "12-34 56-78 9012 3456 78",
        "1.2.3.4@5.6 7.8.9.10-11", None, "", "001.002.003.0004 256.1.1.1", "4111-1111-1111-1111 411111111111111", "1.2.3.4 " * 700]


def test_base_spans(spark, docs, docs_rows, no_docs):
    got = {r[0]: r for r in QUERIES["op10_personal_data"](spark, SF).collect()}
    for d, t in texts(spark):
        assert got[d]["base_sha256"] == brute.digest(brute.personal(t))
    made = list(enumerate(HARD)) + [(100 + i, r[1]) for i, r in enumerate(docs_rows)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    for r in pii.digests(pii.find_personal_data(df)).collect():
        want = brute.personal(dict(made)[r[0]])
        assert r["base_sha256"] == brute.digest(want)
        kinds = Counter(k for k, _, _ in want)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [kinds[k] for k in pii.KINDS]
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(r["spans"].split(","))
    assert pii.find_personal_data(docs).count() == len(docs_rows) and pii.find_personal_data(no_docs).count() == 0


def test_contexts_discover_unseen_identifiers(spark):
    made = [(i, f"please call me on +1 (555) 555-{i:04d} today") for i in range(12)]
    made += [(20 + i, f"please call me on 555-{i:04d}, today") for i in range(3)] + [(40, "in the 1999 year"), (41, "call me on")]
    got = {r[0]: r for r in pii.digests(pii.find_personal_data(spark.createDataFrame(made, "doc_id long, text string"))).collect()}
    assert all(got[i]["spans"] == "phone:18:35" for i in range(12))
    assert all(got[20 + i]["spans"] == "phone:18:26" and got[20 + i]["n_phone"] == 0 for i in range(3))
    assert got[40]["spans"] == got[41]["spans"] == ""


def test_contexts_reach_over_other_identifiers(spark):
    made = [(i, f"ref {i} phone +1 (555) 555-{i:04d} fax +1 (555) 556-{i:04d}") for i in range(12)]
    made += [(20 + i, f"Phone: +1 (555) 557-{i:04d}") for i in range(12)]
    made += [(40, "ref 17 phone 555-0001 fax 555-0002"), (41, "Phone: 5550001"), (42, "ref 3 phone 555 123 4567, fax (555) 123 4568."),
             (43, "ref 5 phone 555 1234 1.2.3.4 fax 5559"), (44, "room 17 5550001 here")]
    got = {r[0]: r["spans"] for r in pii.digests(pii.find_personal_data(spark.createDataFrame(made, "doc_id long, text string"))).collect()}
    assert got[40] == "phone:13:21,phone:26:34"
    assert got[41] == "phone:7:14"
    assert got[42] == "phone:12:24,phone:30:44"
    assert got[43] == "phone:12:20,ip:21:28,phone:33:37"
    assert got[44] == ""


def test_contexts_are_whole_words_however_long(spark):
    long = "w" * 100
    made = [(i, f"{long}{i % 2} {long} +1 (555) 555-{i:04d}") for i in range(12)] + [(20, f"{long}1 {long} 555-0001"), (21, f"other {long} 555-0001")]
    made += [(30, f'kindly call me ("+1 (555) 555-{i:04d}")') for i in range(12)] + [(50, 'kindly call me ("555-0001")')]
    got = {r[0]: r["spans"] for r in pii.digests(pii.find_personal_data(spark.createDataFrame(made, "doc_id long, text string"))).collect()}
    assert got[20] == "phone:203:211" and got[21] == "" and got[50] == "phone:17:25"


# ---- quality ----

def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(d).encode()) % 5 == 0) for d, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 > held.quality.mean()


def test_quality_edges(spark, docs, docs_rows, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int").withColumn("text", F.lit("x"))
    for y in (labels, labels.limit(0)):
        got = quality.quality(docs, y).collect()
        assert len(got) == len(docs_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.quality(no_docs, labels).count() == 0


def test_rules_in_columns_and_in_arrays_agree(spark):
    sf = "/root/testdata/sf0.01"
    d, y = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(d, y)
    assert 0 < len(model.rules) < 300
    for r in quality.with_stats(d, ("doc_id",)).withColumn("s", model.score()).limit(50).collect():
        z = model.intercept + sum(w for rule, w in model.rules if all((r["_stats"][i] > t) == up for i, up, t in rule.terms))
        assert abs(r["s"] - 1 / (1 + np.exp(-z))) < 1e-9


# ---- mixing and shards ----

def test_mix_edges(docs, docs_rows, no_docs):
    mixed = mixing.mix(docs)
    got = rows(mixed, "doc_id", "size", "source_size", "target", "taken", "source")
    assert len(got) == len(docs_rows)
    size = Counter()
    for _, t, _, s in docs_rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    taken, target = Counter(), {}
    for d, n, total, want, took, s in got:
        assert total == size[s] and 0 <= took <= 3 * n and want <= 3 * total + 1e-6
        taken[s] += took
        target[s] = want
    assert all(taken[s] == int(target[s] + 1e-9) for s in size) and abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert got == rows(mixing.mix(docs.repartition(7)), "doc_id", "size", "source_size", "target", "taken", "source")
    assert mixing.mix(no_docs).count() == 0


def test_the_mix_itself(docs):
    d = docs.filter("doc_id is not null and doc_id not in (11, 12)")
    mixed = mixing.mix(d)
    out = mixing.mixture(d)
    assert out.columns == d.columns
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert got == Counter({r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]})


@pytest.mark.parametrize("limit", [200, 3000, 10**9])
def test_shards(docs, docs_rows, no_docs, limit):
    got = sharding.assign_shards(docs, limit).collect()
    assert len(got) == len(docs_rows)
    size, ids = Counter(), {}
    for r in got:
        size[r["shard"]] += r["bytes"]
        ids.setdefault(r["shard"], set()).add(r["doc_id"])
    assert all(r["shard_bytes"] == size[r["shard"]] and len(r["shard"]) == r["depth"] for r in got)
    assert all(n <= limit or len(ids[s]) == 1 for s, n in size.items())
    assert not any(a != b and b.startswith(a) for a in size for b in size)  # a directory of prefixes
    for s in size:  # no bucket was split that fitted
        parent = [n for t, n in size.items() if s and t.startswith(s[:-1])]
        assert not s or sum(parent) > limit
    assert sharding.assign_shards(no_docs, limit).count() == 0


def test_shards_of_texts_that_share_an_id(spark):
    """A thousand texts without a doc_id, and as many with the same one, are dealt out like others."""
    made = [(d, f"{i} " * (20 + i % 9)) for i in range(1000) for d in (None, 7)] + [(1, "copy " * 300)] * 5
    got = sharding.assign_shards(spark.createDataFrame(made, "doc_id long, text string"), 4000).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["bytes"]
    over = [s for s, n in size.items() if n > 4000]
    assert len(got) == len(made) and len(over) == 1 and all(r["doc_id"] == 1 for r in got if r["shard"] == over[0])


def test_shard_files(spark, docs, docs_rows, tmp_path):
    a = sharding.assign_shards(docs, 100_000)
    sharding.write_shards(docs, a, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(docs_rows) and {r[0] for r in back.select("shard").distinct().collect()} == {"b" + r[0] for r in a.select("shard").distinct().collect()}
