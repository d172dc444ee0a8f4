"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on labelled documents; each path to a tree node is a conjunctive rule over statistics
of the text. A logistic regression with lasso penalty weighs the rules, most of them with zero, and the
rest compile into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from textlab.llm.common import SPACE_WORD, Rolling, chunks, mix64, utf8, word_ranges, written

STATS = ("log_words", "log_chars", "word_len", "word_len_sd", "upper", "digit", "punct", "bang", "other", "space",
         "distinct", "distinct_pairs", "same_next", "lines", "line_len", "distinct_lines", "upper_words", "long_words")
#: labelled rows that trees and weights are fitted on, at most (about; by a hash of doc_id)
SAMPLE = 20_000

_WORDS = Rolling(41)


def _class(chars: str) -> np.ndarray:
    x = np.zeros(256, bool)
    x[list(chars.encode())] = True
    return x


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_PUNCT, _BANG = _class(".,;:'\"()-?"), _class("!")
_OTHER = _class("#$%&*+/<=>@[\\]^_`{|}~")
_SPACE = ~SPACE_WORD
_HEAD = np.ones(256, bool)
_HEAD[0x80:0xC0] = False


def _sums(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(flag)])
    return (c[off[1:]] - c[off[:-1]]).astype(float)


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1)
    for r, (s, e) in enumerate(zip(first[:-1], first[1:])):
        if e > s:
            x = np.sort(h[s:e])
            out[r] = 1 + np.count_nonzero(x[1:] != x[:-1])
    return out


def text_stats(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Statistics (rows x STATS) of the texts of a chunk; all zero for an empty one."""
    chars = np.maximum(_sums(_HEAD[data], off), 1)
    start, end, first = word_ranges(data, off, SPACE_WORD)
    n = np.diff(first).astype(float)
    some = np.maximum(n, 1)
    heads = np.concatenate([[0], np.cumsum(_HEAD[data])])
    size = (heads[end] - heads[start]).astype(float)
    w = mix64(_WORDS.ranges(_WORDS.prefix(data), start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    mean = _sums(size, first) / some
    var = np.maximum(_sums(size * size, first) / some - mean * mean, 0)
    row = np.repeat(np.arange(len(n)), np.diff(first))
    inner = np.concatenate([row[1:] == row[:-1], [False]]) if len(row) else np.zeros(0, bool)
    after = np.concatenate([w[1:], w[:1]]) if len(w) else w
    same = _sums((w == after) & inner, first)
    pairs = mix64(w * np.uint64(3) + after)
    pairs[~inner] = np.uint64(0)
    ups = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = (ups[end] - ups[start] >= 2).astype(float)
    newline = data == 10
    lines = _sums(newline, off) + 1
    line_off = np.flatnonzero(newline)
    # lines as ranges of a chunk: after each row's start or newline, to the next newline or row's end
    ls = np.sort(np.concatenate([off[:-1], line_off + 1]))
    le = np.sort(np.concatenate([line_off, off[1:]]))
    lw = mix64(_WORDS.ranges(_WORDS.prefix(data), ls, le) + (le - ls).astype(np.uint64)) if len(data) else np.zeros(len(ls), np.uint64)
    first_line = np.concatenate([[0], np.cumsum(lines)]).astype(np.int64)
    cols = [np.log1p(n), np.log(chars), mean, np.sqrt(var), _sums(_UPPER[data], off) / chars, _sums(_DIGIT[data], off) / chars,
            _sums(_PUNCT[data], off) / chars, _sums(_BANG[data], off) / chars, _sums(_OTHER[data], off) / chars, _sums(_SPACE[data], off) / chars,
            _distinct(w, first) / some, _distinct(pairs, first) / some, same / some, lines, chars / lines, _distinct(lw, first_line) / lines,
            _sums(shout, first) / some, _sums(size > 20, first) / some]
    out = np.stack(cols, axis=1)
    out[np.diff(off) == 0] = 0
    return out


def with_stats(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The columns ``keep`` and an array of STATS, from ``text``, for each row."""
    src = docs.select(*keep, *(["text"] if "text" not in keep else []))

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            stats = [text_stats(data[off[i]:off[j]], off[i:j + 1] - off[i]) for i, j in chunks(off)]
            x = np.concatenate(stats) if stats else np.zeros((0, len(STATS)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(STATS)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "_stats"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*keep).schema)
    return src.mapInArrow(run, f"{kinds}, _stats array<double>")


@dataclass(frozen=True)
class Rule:
    """A conjunction: each (statistic, above, threshold) asks for > or <= the threshold."""

    terms: tuple[tuple[int, bool, float], ...]

    def column(self, stats: str = "_stats") -> Column:
        out = F.lit(True)
        for i, above, t in self.terms:
            x = F.col(stats)[i]
            out = out & ((x > t) if above else (x <= t))
        return out


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: str = "_stats") -> Column:
        """Probability of label 1 as a column expression over the statistics."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def tree_rules(node, path: dict | None = None) -> set[Rule]:
    """Rules of all paths from a fitted tree's root. Several tests of one statistic in one direction
    count as the narrowest."""
    path = path or {}
    out = {Rule(tuple(sorted((i, up, t) for (i, up), t in path.items())))} if path else set()
    if node.subtreeDepth() == 0:
        return out
    split = node.split()
    i, t = split.featureIndex(), split.threshold()
    left, right = dict(path), dict(path)
    left[(i, False)] = min(t, path.get((i, False), t))
    right[(i, True)] = max(t, path.get((i, True), t))
    return out | tree_rules(node.leftChild(), left) | tree_rules(node.rightChild(), right)


def fit(rows: DataFrame, trees: int = 20, depth: int = 3, penalty: float = 0.0001, seed: int = 7) -> RuleEnsemble:
    """Rules and weights from (_stats, label 0/1). With one class only, or too few rows, the score is constant."""
    mean = rows.agg(F.avg("label"), F.count("*")).first()
    share = 0.5 if mean[0] is None else (mean[0] * mean[1] + 0.5) / (mean[1] + 1)
    constant = RuleEnsemble(float(np.log(share / (1 - share))), ())
    if mean[0] is None or mean[0] in (0.0, 1.0):
        return constant
    x = rows.select(array_to_vector("_stats").alias("features"), F.col("label").cast("double").alias("label"), "_stats")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, featureSubsetStrategy="onethird",
                                    subsamplingRate=0.7, seed=seed).fit(x.select("features", "label"))
    rules = sorted(set().union(*(tree_rules(t._call_java("rootNode")) for t in forest.trees)), key=lambda r: r.terms)
    if not rules:  # too few rows for any split
        return constant
    # the rules' truth values as a vector: one task evaluates them for a batch of rows
    terms = [r.terms for r in rules]

    def hold(batches):
        for batch in batches:
            s = np.asarray(batch.column("_stats").flatten()).reshape(-1, len(STATS))
            f = np.stack([np.logical_and.reduce([(s[:, i] > t) if up else (s[:, i] <= t) for i, up, t in r]) for r in terms], axis=1).astype(float)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * len(terms)), pa.array(f.reshape(-1)))
            yield pa.RecordBatch.from_arrays([lists, batch.column("label")], names=["f", "label"])

    held = rows.select("_stats", F.col("label").cast("double").alias("label")).mapInArrow(hold, "f array<double>, label double")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60, tol=1e-5)
    model = lasso.fit(held.select(array_to_vector("f").alias("features"), "label"))
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> RuleEnsemble:
    """An ensemble from the rows of ``labels`` (doc_id, quality) that are not held out: all of them up to
    ``sample``, else about that many by a hash of doc_id. Null labels and ids are left out; a document
    labelled more than once counts with its most frequent label (1 in a tie)."""
    y = (labels.filter("doc_id is not null and quality is not null").filter(~held_out(F.col("doc_id")))
         .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label")))
    n = y.count()
    if n > sample:
        y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * sample // n)
    y = y.select(F.col("doc_id").alias("_id"), "label")
    # at most about ``sample`` rows of two numbers
    known = docs.select("doc_id", "text").join(F.broadcast(y), F.col("doc_id") == F.col("_id")).select("label", "text")
    return fit(written(with_stats(known, ("label",)).coalesce(4), "labelled"))


def good(docs: DataFrame, model: RuleEnsemble, threshold: float) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose score is ``threshold`` or more."""
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]  # docs may have any names
    out = with_stats(docs.toDF(*names), tuple(names)).filter(model.score() >= threshold)
    return out.drop("_stats").toDF(*docs.columns)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, held_out, score and predicted (score >= threshold).

    Null texts are empty; empty texts have all statistics 0 and are scored like others. Null doc_ids are
    scored and not held out. Repeated rows are scored alike. Without labels every score is 0.5. Other
    columns are not read.
    """
    model = train(docs, labels, sample)
    scored = with_stats(docs, ("doc_id",)).withColumn("score", model.score())
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
