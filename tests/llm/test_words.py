"""Runs, licence notices and spelling variants against plain Python, on awkward rows and on the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.llm import licenses, runs, spelling
from textlab.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def texts(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# ---- runs ----

def brute_runs(w, least=12):
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if i > s and n >= max(least, 2 * q) and (s, n) not in seen:
                seen.add((s, n))
                out.append((s, n, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_row(doc_id, text, loop):
    w = words(text)
    h = zlib.crc32(str(doc_id).encode())
    if loop and doc_id is not None and h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = brute_runs(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def made_sequences():
    rng = random.Random(1)
    fib, turn = ([0], [1]), [0]
    for _ in range(11):
        fib, turn = (fib[0] + fib[1], fib[0]), turn + [1 - x for x in turn]
    yield from ([], [3], [7] * 11, [7] * 12, [7] * 300, fib[0], turn, turn * 2, [1, 2] * 6, [1, 2] * 6 + [1], list(range(6)) * 2, list(range(7)) * 2)
    for _ in range(300):
        k = rng.randint(1, 5)
        yield [rng.randrange(k) for _ in range(rng.randint(0, 200))]
        block = [rng.randrange(50) for _ in range(rng.randint(1, 30))]
        yield [x for _ in range(rng.randint(1, 4)) for x in [rng.randrange(3)] * rng.randint(0, 5) + block * rng.randint(1, 5) + block[:rng.randint(0, 30)]]


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_of_sequences(least):
    for w in made_sequences():
        s, e, q = runs.runs_of(np.array(w, np.int64), np.zeros(len(w), bool), least)
        assert list(zip(s.tolist(), (e - s).tolist(), q.tolist())) == brute_runs(w, least), w


def test_grammar_expands_to_its_sequence():
    """Every rule's places hold the same symbols as its first one, and its two parts are shorter."""
    for w in made_sequences():
        seq = np.array(w, np.int64)
        if not len(seq):
            continue
        g = runs.Grammar(seq, np.zeros(len(seq), bool), 2)
        assert (g.start < g.middle).all() and (g.middle < g.end).all()
        for r in range(len(g.start)):
            n = g.end[r] - g.start[r]
            for p in g.place[g.first[r]:g.first[r + 1]]:
                assert (seq[p:p + n] == seq[g.start[r]:g.end[r]]).all()
        # one rule holds the whole sequence
        assert len(seq) == 1 or (g.end - g.start).max() == len(seq)


def test_runs_in_texts(docs, docs_rows, no_docs):
    got = rows(runs.digests(runs.find_runs(docs)))
    assert got == sorted((brute_row(r[0], r[1], False) for r in docs_rows), key=str)
    assert runs.digests(runs.find_runs(no_docs)).count() == 0
    looped = rows(runs.digests(runs.find_runs(runs.looped(docs))))
    assert looped == sorted((brute_row(r[0], r[1], True) for r in docs_rows), key=str)


def test_runs_past_stretches(spark):
    """Texts in which runs stand between words that occur once, at both ends, next to each other, and in copies of other texts."""
    rng = random.Random(5)
    made = []
    for d in range(200):
        w = []
        for _ in range(rng.randint(0, 5)):
            w += [f"u{rng.randrange(10**9)}" for _ in range(rng.randint(0, 9))]
            block = [rng.choice(["a", "b", "Ab", "ü", "x-y", f"r{rng.randrange(9)}"]) for _ in range(rng.randint(1, 12))]
            w += block * rng.randint(0, 4) + block[:rng.randint(0, 11)]
        made.append((d, rng.choice([" ", "\n", " \t"]).join(w)))
    made += [(500 + d, t) for d, t in made[:20]]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(2)
    assert rows(runs.digests(runs.find_runs(df))) == sorted((brute_row(d, t, False) for d, t in made), key=str)


def test_collapsed_text(spark):
    df = spark.createDataFrame([(1, "so  " + "la di da " * 6 + "end"), (2, " as\tis ")], "doc_id long, text string")
    assert rows(runs.find_runs(df), "doc_id", "n_words", "collapsed") == [(1, 20, "so la di da end"), (2, 2, "as is")]


def test_runs_query(spark):
    assert rows(QUERIES["op11_word_runs"](spark, SF)) == sorted((brute_row(d, t, True) for d, t in texts(spark)), key=str)


# ---- licences (the query is also compared with SQL) ----

def brute_phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for label, phrase in licenses.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))


def test_phrases(docs, docs_rows, no_docs, spark):
    rng = random.Random(2)
    parts = ["GNU", "General", "public", "license", "Apache", "CC", "BY", "mit", "MIT", "x", "ü", "CC-BY", "cc,by", "mit\nlicense", "apache license license"]
    more = [(100 + i, rng.choice([" ", "-", "\n"]).join(rng.choice(parts) for _ in range(rng.randint(0, 60))), "en", "z") for i in range(150)]
    # a Kelvin sign is no k
    more += [(None, "mit license", "en", "z"), (None, "mit license", "en", "z"), (300, "MIT LICENſE K", "en", "z")]
    all_docs = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    got = rows(licenses.digests(licenses.find_licenses(all_docs.withColumn("label", F.lit(1)).withColumn("key", F.lit(2)).withColumn("w", F.lit(3)))),
               "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((r[0], *brute_phrases(r[1])) for r in docs_rows + more), key=str)
    assert licenses.digests(licenses.find_licenses(no_docs)).count() == 0


def test_notices(spark):
    """Whole notices, with words put in, left out and replaced, and too little of one."""
    notice = dict((x, t) for x, t in licenses.NOTICES)["bsd"].split()
    some = "one two three four five six seven".split()
    made = [(1, some + notice + some), (2, some + notice[:9] + ["new", "words"] + notice[9:] + some), (3, notice[:7] + notice[9:]),
            (4, notice[:5] + ["changed"] + notice[6:]), (5, notice[:8] + some), (6, some), (7, list(reversed(notice))), (8, notice[:12] + some * 30 + notice[12:])]
    df = spark.createDataFrame([(d, "; ".join(w).upper()) for d, w in made], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.digests(licenses.find_licenses(df)).collect()}
    assert [out[d]["labels"] for d, _ in made] == ["bsd"] * 4 + [""] * 4
    assert out[1]["score"] == 1.0 and out[2]["score"] == 1.0 and out[6]["score"] == 0.0 and out[7]["score"] == 0.0
    assert out[5]["score"] == 8 / len(notice) and all(0 <= r["score"] <= 1 for r in out.values())
    found = {r["doc_id"]: r["found"] for r in licenses.find_licenses(df).collect()}
    assert [(f["start"], f["end"]) for f in found[2]] == [(7, 7 + len(notice) + 2)]


# ---- spelling ----

def edits(w, v):
    """Whether v is w with exactly one code point put in, left out or replaced."""
    if len(v) < len(w):
        w, v = v, w
    if len(v) - len(w) > 1 or w == v:
        return False
    i = next((i for i in range(len(w)) if w[i] != v[i]), len(w))
    return w[i + (len(w) == len(v)):] == v[i + 1:]


def brute_groups(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and edits(w, v)] for w in counts}
    best = {w: min(near[w], key=lambda v: (-counts[v], v)) for w in near if near[w]}
    form = {w: v for w, v in best.items() if counts[v] >= 10 * counts[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w
    return sorted(((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()), key=str)


def brute_vocabulary(table):
    c = Counter()
    for d, t in table:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += len(w) >= 7
    return {w: n for w, n in c.items() if n >= 2}


def test_spelling_query(spark):
    got = rows(QUERIES["op13_spelling_variants"](spark, SF), "word", "form", "root", "n", "n_near", "form_n")
    assert got == brute_groups(brute_vocabulary(texts(spark)))


@pytest.mark.parametrize("half_words,task_words", [(1 << 16, 1 << 17), (5, 50)])
def test_near_words(spark, half_words, task_words):
    """Random words over small alphabets, where neighbours are many, also with halves split in blocks; very long and short ones."""
    rng = random.Random(7)
    made = {"".join(rng.choice(a) for _ in range(rng.randint(2, 9))) for a in ("ab", "abc", "aé漢😀") for _ in range(300)}
    made |= {"x" * n for n in (2, 3, 500, 501, 503, 2000)} | {"xy" * 300, "xy" * 300 + "x", "xy" * 100 + "yx" + "xy" * 199}
    df = spark.createDataFrame([(w, rng.randint(1, 99)) for w in sorted(made)], "word string, n long").repartition(3)
    count = dict(tuple(r) for r in df.collect())
    got = rows(spelling.near_words(df, half_words, task_words).distinct())
    assert got == sorted(((w, v, count[v]) for w in made for v in made if abs(len(v) - len(w)) < 2 and edits(w, v)), key=str)


def test_chains_and_ties(spark):
    counts = {"aaaaaaaa": 1, "aaaaaaab": 10, "aaaaaabb": 100, "aaaaabbb": 1000, "aaaabbbb": 10000, "aaabbbbb": 99999, "ccccccc": 1, "cccccccb": 20, "cccccccd": 20,
              "ddddddd": 3, "dddddddd": 30, "eeeeeee": 3, "eeeeeeee": 29}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = rows(spelling.group_variants(df))
    assert got == brute_groups(counts)
    of = {r[0]: r[1:3] for r in got}
    assert of["aaaaaaaa"] == ("aaaaaaab", "aaaabbbb") and of["ccccccc"] == ("cccccccb", "cccccccb") and of["ddddddd"][0] == "dddddddd" and of["eeeeeee"][0] is None


def test_spelling_edges(spark, docs, docs_rows, no_docs):
    got = rows(spelling.variants(docs.withColumn("word", F.lit("w")).withColumn("near", F.lit(0)), typo_of=31), "word", "form", "root", "n", "n_near", "form_n")
    assert got == brute_groups(brute_vocabulary([r[:2] for r in docs_rows]))
    assert spelling.variants(no_docs, typo_of=31).count() == 0
