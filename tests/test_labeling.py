"""Hand cases for labelling, cleaning and dedup (FIXTURES.md part 3)."""

from pyspark.sql import functions as F

from textlab.operators import cleaning, labeling


def _pubs(spark, rows):
    ann = spark.createDataFrame(rows, "row_no long, id long, pub_title string, mention string")
    return labeling.build_publications(ann)


def test_tie_rule_longest_then_smallest(spark):
    pubs = _pubs(spark, [(0, 1, "T", "data"), (1, 1, "U", "dataset"), (2, 1, "V", "set"), (3, 1, "W", "abc")])
    secs = spark.createDataFrame([(1, 0, "t", "our dataset and abc"), (1, 1, "t", "DATASET upper"),
                                  (1, 2, "t", "nothing here"), (2, 0, "t", "dataset but no pub")],
                                 "file_id long, pos int, section_title string, section_txt string")
    out = {r.pos: (r.dataset, r.label) for r in labeling.label_sections(secs, pubs).collect()}
    assert out == {0: ("dataset", 1), 1: ("None", 0), 2: ("None", 0)}  # file 2 has no publication


def test_first_title_and_empty_mention(spark):
    pubs = _pubs(spark, [(5, 1, "second", "x"), (2, 1, "first", ""), (9, 1, "third", None)]).collect()
    assert pubs[0].publication_name == "first" and pubs[0].pub_order == 2
    assert pubs[0].mentions == ["", "x"]
    secs = spark.createDataFrame([(1, 0, "t", "zzz")], "file_id long, pos int, section_title string, section_txt string")
    row = labeling.label_sections(secs, _pubs(spark, [(0, 1, "t", "")])).first()
    assert (row.dataset, row.label) == ("", 1)  # the empty needle is contained, as str.find


def test_length_filters_edges(spark):
    df = spark.createDataFrame([("a" * n,) for n in (4, 5, 20, 21)] + [("",), (None,)], "section_txt string")
    assert sorted(len(r[0]) for r in cleaning.skip_tiny_sections(df).collect()) == [5, 20, 21]
    assert [len(r[0]) for r in cleaning.min_length_filter(df).collect()] == [21]
    assert cleaning.drop_null_text(df).count() == 5


def test_dedup_keeps_first_and_is_idempotent(spark):
    df = spark.createDataFrame([(3, "t", 1, "b"), (1, "t", 1, "a"), (2, "t", 0, "c"), (4, "u", 1, "d")],
                               "pos long, section_txt string, label int, dataset string")
    once = cleaning.dedup_keep_first(df, ["section_txt", "label"], ["pos"])
    assert sorted((r.pos, r.dataset) for r in once.collect()) == [(1, "a"), (2, "c"), (4, "d")]
    twice = cleaning.dedup_keep_first(once, ["section_txt", "label"], ["pos"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_cascade_equals_last_step(spark):
    rows = [(i, f"f{i % 3}", f"text{i % 4}", f"d{i % 2}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "pos long, file_id string, section_txt string, dataset string, label int")
    step = cleaning.dedup_keep_first(df, ["file_id", "section_txt", "dataset", "label"], ["pos"])
    step = cleaning.dedup_keep_first(step, ["section_txt", "dataset", "label"], ["pos"])
    step = cleaning.dedup_keep_first(step, ["section_txt", "label"], ["pos"])
    fused = cleaning.dedup_keep_first(df, ["section_txt", "label"], ["pos"])
    assert sorted(step.collect()) == sorted(fused.collect())


def test_funnel_never_rises(spark):
    from textlab.plans import corpus
    from textlab.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    lab = corpus.labelled_with_funnel(fx.annotations(spark, SF_SMALL), fx.sections(spark, SF_SMALL))
    r = cleaning.clean_funnel(lab).first()
    assert r.n_labelled >= r.n_long >= r.n_dedup_file >= r.n_dedup_mention >= r.n_dedup_text > 0


def test_contain_pairs_short_and_long_passages(spark):
    docs = spark.createDataFrame([(1, "xabcx one two three four"), (2, "no match"), (3, "one two three")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(10, "abc"), (11, "one two three"), (12, "two thr"), (13, "zzz yyy")],
                                  "item_id long, text string")
    got = sorted(tuple(r) for r in labeling.contain_pairs(docs, items).collect())
    brute = sorted((d, i) for d, dt in [(1, "xabcx one two three four"), (2, "no match"), (3, "one two three")]
                   for i, it in [(10, "abc"), (11, "one two three"), (12, "two thr"), (13, "zzz yyy")] if it in dt)
    assert got == brute


def test_contain_pairs_chunked_short_passages_exact(spark):
    docs = spark.createDataFrame([(i, f"w{i} ab cd ef{i % 3} gh") for i in range(30)], "doc_id long, text string")
    items = spark.createDataFrame([(100 + j, t) for j, t in enumerate(["ab", "cd ef1", "f2 g", "zz", "b c", "h"])],
                                  "item_id long, text string")
    got = sorted(tuple(r) for r in labeling.contain_pairs(docs, items, max_broadcast_bytes=40).collect())
    brute = sorted((r.doc_id, it.item_id) for r in docs.collect() for it in items.collect() if it.text in r.text)
    assert got == brute and len(got) > 30


def test_contain_pairs_hot_words_and_blank_passages(spark):
    made = [(i, f"the of the w{i} the of x{i % 5} the of") for i in range(60)] + [(100, None), (101, "")]
    items = [(1, "the w7 the"), (2, "of the w9 the of"), (3, "the of x3 the"), (4, "the nowhere the"), (5, ""), (6, " "), (7, None), (8, "e o"), (9, "w1")]
    docs, its = spark.createDataFrame(made, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, i) for d, t in made for i, p in items if t is not None and p is not None and p in t)
    for limit in (None, 1):
        assert sorted(tuple(r) for r in labeling.contain_pairs(docs, its, max_broadcast_bytes=limit).collect()) == want


def test_label_corpus_repeatable_under_repartitioning(spark):
    from textlab.plans import corpus
    from textlab.sources import fixtures as fx
    from tests.conftest import SF_SMALL
    ann, secs = fx.annotations(spark, SF_SMALL), fx.sections(spark, SF_SMALL)
    base = sorted(tuple(r) for r in corpus.label_corpus(ann, secs).collect())
    for parts in (1, 17):
        again = corpus.label_corpus(ann.repartition(parts), secs.repartition(parts, "pos"))
        assert sorted(tuple(r) for r in again.collect()) == base


def test_thousands_of_names_match_as_one_by_one(spark, monkeypatch):
    """Publications with few, many and no names: the automaton's rows equal those of a plain loop, in blocks of any size."""
    import random

    from textlab.operators import labeling
    rng = random.Random(8)

    def word():
        return "".join(rng.choice("abé ") for _ in range(rng.randint(1, 6)))

    names = {"many": sorted({word() for _ in range(3000)} | {""}), "more": sorted({word() + "z" for _ in range(100)}), "few": ["a", "ab"], "none": []}
    pubs = spark.createDataFrame([(k, k.upper(), i, v) for i, (k, v) in enumerate(names.items())], "file_id string, publication_name string, pub_order int, mentions array<string>")
    made = [(rng.choice([*names, "other"]), i, None if i % 17 == 0 else "".join(rng.choice("abéz ") for _ in range(rng.randint(0, 30)))) for i in range(200)]
    secs = spark.createDataFrame(made, "file_id string, pos int, section_txt string").repartition(3)
    want = {(f, i): [m for m in names[f] if t is not None and m in t] for f, i, t in made if f in names}
    for block in (50_000, 7):
        monkeypatch.setattr(labeling._automaton_matches, "__defaults__", (block,))
        lab = labeling.label_sections(secs, pubs, keep_matches=True).collect()
        assert {(r.file_id, r.pos): r.matches for r in lab} == want and len(lab) == len(want)
        assert all(r.publication_name == r.file_id.upper() and r.label == bool(r.matches) for r in lab)
        pairs = sorted((r.file_id, r.pos, r.mention) for r in labeling.match_mentions(secs, pubs).collect())
        assert pairs == sorted((f, i, m) for (f, i), ms in want.items() for m in ms)
