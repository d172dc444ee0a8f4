"""Randomised properties, batched so each runs as one Spark job."""

import datetime
import math
import random
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import functions as F

from textlab.functions import arrays as A, formats


def test_window_matches_python_slices(spark):
    rnd = random.Random(7)
    arrays = [[f"t{j}" for j in range(rnd.randint(0, 40))] for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(arrays)], "i int, t array<string>")
    for h, k in [(0, 1), (1, 1), (3, 7), (5, 7), (7, 5), (12, 3), (15, 15), (2, 9), (9, 2), (4, 4)]:
        got = {r.i: r.w for r in df.select("i", A.head_tail_window(F.col("t"), h, k).alias("w")).collect()}
        for i, t in enumerate(arrays):
            assert got[i] == t[:h] + t[-k:], (t, h, k)


def test_half_even_ratio_is_exact(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randint(0, 500), rnd.randint(0, 500)) for _ in range(2000)] + [(1, 8), (3, 8), (5, 8), (53, 200)]
    df = spark.createDataFrame(pairs, "a long, b long")
    rows = df.select("a", "b", formats.round_ratio_text("a", "b").alias("t")).collect()
    for r in rows:
        want = "0.00" if r.b == 0 else str((Decimal(r.a) / Decimal(r.b)).quantize(Decimal("0.01"), ROUND_HALF_EVEN))
        assert r.t == want, (r.a, r.b, r.t, want)


def test_elapsed_matches_timedelta(spark):
    rnd = random.Random(5)
    vals = [rnd.uniform(0, 400000) for _ in range(500)] + [0.5, 1.5, 2.5, 86399.5, 86400.0, 172800.4]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    for r in df.select("s", formats.format_elapsed("s").alias("e")).collect():
        assert r.e == str(datetime.timedelta(seconds=int(round(r.s)))), r.s


def test_mcc_and_rates_match_formulas(spark):
    from textlab.operators import metrics
    rnd = random.Random(3)
    rows = []
    for run in range(40):
        for _ in range(rnd.randint(1, 60)):
            rows.append((run, rnd.randint(0, 1), rnd.randint(0, 1)))
    df = spark.createDataFrame(rows, "run long, label int, pred int")
    cm = {r.run: r for r in metrics.test_metrics(metrics.confusion_matrix(df, ["run"])).collect()}
    for run, r in cm.items():
        ys = [(y, p) for rr, y, p in rows if rr == run]
        tp = sum(1 for y, p in ys if y == 1 and p == 1)
        fp = sum(1 for y, p in ys if y == 0 and p == 1)
        fn = sum(1 for y, p in ys if y == 1 and p == 0)
        tn = sum(1 for y, p in ys if y == 0 and p == 0)
        den = math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
        mcc = 0.0 if den == 0 else (tp * tn - fp * fn) / den
        assert math.isclose(r.mcc, mcc, abs_tol=1e-12)
        assert math.isclose(r.precision, tp / (tp + fp) if tp + fp else 0.0, abs_tol=1e-12)
        assert math.isclose(r.recall, tp / (tp + fn) if tp + fn else 0.0, abs_tol=1e-12)


def test_label_sections_matches_brute_force(spark):
    from textlab.operators import labeling
    rnd = random.Random(13)
    alphabet = ["ab", "ba", "abc", "c", "data", "set", " ", "x"]
    pubs, secs = {}, []
    for fid in range(25):
        pubs[fid] = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 3)))
                            for _ in range(rnd.randint(0, 4))})
        for pos in range(rnd.randint(0, 6)):
            secs.append((fid, pos, "".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 12)))))
    ann = [(i, fid, "T", m) for i, (fid, m) in enumerate((f, m) for f, ms in pubs.items() for m in ms)]
    ann_df = spark.createDataFrame(ann or [(0, 999, "T", "zz")], "row_no long, id long, pub_title string, mention string")
    sec_df = spark.createDataFrame([(f, p, "t", s) for f, p, s in secs],
                                   "file_id long, pos int, section_title string, section_txt string")
    got = {(r.file_id, r.pos): (r.dataset, r.label)
           for r in labeling.label_sections(sec_df, labeling.build_publications(ann_df)).collect()}
    annotated = {a[1] for a in ann}  # inner join: a file without annotations is never opened
    want = {}
    for f, p, text in secs:
        if f not in annotated:
            continue
        hits = [m for m in pubs[f] if m in text]
        best = sorted(hits, key=lambda m: (-len(m), m.encode()))[0] if hits else "None"
        want[(f, p)] = (best, 1 if hits else 0)
    assert got == want


def test_funnel_and_fused_dedup_match_pandas_cascade(spark):
    import pandas as pd

    from textlab.operators import cleaning
    rnd = random.Random(17)
    texts = ["short", "a" * 21, "b" * 25, "c" * 30, "the same long text here", "another long section text"]
    rows = [(i, rnd.choice(["f1", "f2", "f3"]), rnd.choice(texts), rnd.choice(["None", "ds1", "ds2"]),
             rnd.randint(0, 1), i // 7, i % 7) for i in range(400)]
    cols = ["i", "file_id", "section_txt", "dataset", "label", "pub_order", "pos"]
    pdf = pd.DataFrame(rows, columns=cols)  # file order = i
    n0 = len(pdf)
    pdf = pdf[pdf.section_txt.str.len().gt(20)]
    n1 = len(pdf)
    pdf = pdf[~pdf.duplicated(["file_id", "section_txt", "dataset", "label"], keep="first")]
    n2 = len(pdf)
    pdf = pdf[~pdf.duplicated(["section_txt", "dataset", "label"], keep="first")]
    n3 = len(pdf)
    pdf = pdf[~pdf.duplicated(["section_txt", "label"], keep="first")]
    n4 = len(pdf)
    df = spark.createDataFrame(rows, "i long, file_id string, section_txt string, dataset string, label int, "
                                     "pub_order long, pos long")
    f = cleaning.clean_funnel(df).first()
    assert (f.n_labelled, f.n_long, f.n_dedup_file, f.n_dedup_mention, f.n_dedup_text) == (n0, n1, n2, n3, n4)
    fused = cleaning.dedup_cascade(cleaning.min_length_filter(df), order=("pub_order", "pos"))
    assert sorted(r.i for r in fused.collect()) == sorted(pdf.i.tolist())


def test_pr_curve_matches_numpy_histogram_formula(spark):
    import numpy as np

    from textlab.operators import metrics
    rnd = np.random.default_rng(23)
    n, t = 300, 127
    z = rnd.normal(size=(n, 2))
    y = rnd.integers(0, 2, size=n)
    df = spark.createDataFrame([(int(y[i]), float(z[i, 0]), float(z[i, 1])) for i in range(n)],
                               "label int, z0 double, z1 double").withColumn("z", F.array("z0", "z1"))
    got = {(r.cls, r.bucket): r for r in metrics.pr_curve(df, "z", "label", 2, t).collect()}
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p = p / p.sum(axis=1, keepdims=True)
    for c in (0, 1):
        lab = (y == c).astype(np.float64)
        idx = np.floor(p[:, c] * (t - 1)).astype(np.int64)
        tpb, _ = np.histogram(idx, bins=t, range=(0, t - 1), weights=lab)
        fpb, _ = np.histogram(idx, bins=t, range=(0, t - 1), weights=1 - lab)
        tp, fp = np.cumsum(tpb[::-1])[::-1], np.cumsum(fpb[::-1])[::-1]
        prec = tp / np.maximum(1e-7, tp + fp)
        rec = tp / np.maximum(1e-7, tp + (tp[0] - tp))
        for b in range(t):
            r = got[(c, b)]
            assert (r.tp, r.fp) == (tp[b], fp[b])
            assert math.isclose(r.precision, prec[b], abs_tol=1e-12) and math.isclose(r.recall, rec[b], abs_tol=1e-12)


def test_masks_leave_nothing_of_overlapping_names(spark):
    import random

    from textlab.functions.text import mask_mentions
    rng = random.Random(6)
    rows = [(0, "the Census data set of 2020", ["Census", "Census data set"]), (1, "aaa", ["aa"]), (2, "a.b*c \\E x", [".", "*", "\\E"]), (3, "x", []),
            (4, "", ["a"]), (5, None, ["a"]), (6, "abc", [None, "", "b"]), (7, "😀ab😀", ["😀"]), (8, "abc", None)]
    for i in range(300):
        t = "".join(rng.choice("ab é") for _ in range(rng.randint(0, 40)))
        rows.append((10 + i, t, ["".join(rng.choice("ab é") for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(0, 5))]))

    def brute(t, names):
        if t is None:
            return None
        gone = {j for m in names or [] if m for i in range(len(t)) if t.startswith(m, i) for j in range(i, i + len(m))}
        return "".join(c for i, c in enumerate(t) if i not in gone)

    df = spark.createDataFrame(rows, "i int, t string, m array<string>")
    got = {r.i: r.x for r in df.select("i", mask_mentions("t", "m").alias("x")).collect()}
    assert got == {i: brute(t, m) for i, t, m in rows}
