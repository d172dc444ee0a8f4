"""Spelling variants of a vocabulary by search schemes over an index in both directions.

A word one edit away from another keeps the other's first or its second half whole. Each half is a search
of its own: the half is matched exactly from the word's delimiter inwards, then the search goes on across
the other half with one error, as an interval of suffix ranks that shrinks symbol by symbol. First halves
run through the index of the reversed words and second halves through the index of the words as they are;
a word is delimited at both ends, so no search has to turn round.

The vocabulary is dealt out by halves: a word is indexed where searches look that may end at it, so that no
task needs more than its share. A half that very many words begin or end with is split in blocks, each of
which all its searches visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textlab.llm.common import written
from textlab.operators.joins import broadcast_if_small

#: letters of a word; the fewest code points and occurrences of a word; times a form is more frequent than its variant
LETTERS, SHORTEST, LEAST, TIMES = r"[A-Za-zÀ-ÿ]", 7, 2, 10
#: words in one task's index, words of one half in a block, and searches that run together
TASK_WORDS, HALF_WORDS, TOGETHER = 1 << 17, 1 << 16, 1 << 14

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, typo_of: int | None = None, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): maximal runs of LETTERS of all texts, A-Z lower-cased, of ``shortest`` code points or
    more, that occur ``least`` times or more. With ``typo_of``, a run whose crc32 of "<doc_id>:<run>" that
    number divides loses one code point first. A null doc_id is the empty string there; null texts have no words."""
    # the outer form: for the other one Spark puts a filter in front that finds all words once more
    word = F.explode_outer(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{shortest},}}+"), F.lit(0)))
    w = docs.select("doc_id", word.alias("_run")).select("doc_id", F.translate("_run", _UPPER, _LOWER).alias("word"))
    if typo_of:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")))
        w = w.withColumn("_h", h).withColumn("_at", (F.col("_h") % F.length("word")).cast("int"))
        cut = F.concat(F.substring("word", F.lit(1), F.col("_at")), F.substring("word", F.col("_at") + 2, F.length("word")))
        w = w.withColumn("word", F.when(F.col("_h") % typo_of == 0, cut).otherwise(F.col("word")))
    return w.filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


# ---- the index of one task ---------------------------------------------------------------

def _points(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and the offsets of the words in them."""
    w = words.to_pylist()
    off = np.concatenate([[0], np.cumsum(np.fromiter(map(len, w), np.int64, len(w)))])
    return np.frombuffer("".join(w).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), off


def _spread(start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of n[i] numbers from start[i] on: i of each number, and the number."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class WordIndex:
    """Suffix ranks of delimited words for searches that extend to the left. ``words`` and ``off`` hold symbols from 1 on;
    0 delimits."""

    def __init__(self, words: np.ndarray, off: np.ndarray):
        size = np.diff(off)
        text = np.zeros(len(words) + len(size), np.int64)  # each word, then its delimiter
        text[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = words
        n, k, rank = len(text), 1, text
        while True:  # the text is a ring: before the first word stands the last delimiter
            key = (rank << 32) | np.roll(rank, -k)
            order = np.argsort(key, kind="stable")
            s = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.cumsum(np.concatenate([[0], (s[1:] != s[:-1]).astype(np.int64)]))
            k *= 2
            if k >= n or new[order[-1]] == n - 1:
                break
            rank = new
        self.n, self.words = n, len(size)
        self.before = text[order - 1]  # the symbol to the left of each rank's suffix
        self.steps = np.sort(self.before * n + np.arange(n))
        # ranks below ``words`` are the delimiters'; the word after each of them
        self.word = np.searchsorted(off[1:] + np.arange(len(size)), order[:len(size)])
        self.word = (self.word + 1) % max(1, len(size))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the suffixes that have ``symbol`` to the left of those in [lo, hi)."""
        return np.searchsorted(self.steps, symbol * self.n + lo), np.searchsorted(self.steps, symbol * self.n + hi)

    def branches(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct symbols, delimiters left out, that stand to the left of the suffixes in each interval: (interval, symbol).
        Intervals of one depth are equal or disjoint, and each is read once."""
        apart, which = np.unique(lo * (self.n + 1) + hi, return_inverse=True)
        a, b = apart // (self.n + 1), apart % (self.n + 1)
        i, r = _spread(a, b - a)
        top = int(self.before.max()) + 1
        pair = np.unique(i * top + self.before[r])
        pair = pair[pair % top > 0]
        first = np.searchsorted(pair, np.arange(len(a) + 1) * top)
        j, p = _spread(first[which], np.diff(first)[which])
        return j, pair[p] % top

    def near(self, words: np.ndarray, off: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(search, word): words that differ from the searched one by one edit after its first ``half`` symbols.
        Searched words are given in the order in which they are matched; symbol -1 is in no word."""
        size = np.diff(off)
        at = lambda q, j: words[np.minimum(off[q] + j, len(words) - 1)]
        q = np.arange(len(size))
        lo, hi = np.zeros(len(q), np.int64), np.full(len(q), self.words, np.int64)
        errors, depth = [], 0
        while len(q):  # exact so far: the same number of symbols of each search
            late = half[q] <= depth
            if late.any():
                c, l, h = q[late], lo[late], hi[late]
                inside = size[c] > depth
                own = np.where(inside, at(c, depth), -2)
                # left out; of a stretch of one symbol the last
                skip = inside & ((size[c] == depth + 1) | (own != at(c, depth + 1)))
                errors.append((c[skip], np.full(skip.sum(), depth + 1), l[skip], h[skip]))
                i, symbol = self.branches(l, h)
                other = symbol != own[i]
                i, symbol = i[other], symbol[other]
                bl, bh = self.extend(symbol, l[i], h[i])
                errors.append((c[i], np.full(len(i), depth), bl, bh))  # one put in
                put = inside[i]
                errors.append((c[i][put], np.full(put.sum(), depth + 1), bl[put], bh[put]))  # one replaced
            live = size[q] > depth
            q, lo, hi = q[live], lo[live], hi[live]
            lo, hi = self.extend(at(q, depth), lo, hi)
            live = lo < hi
            q, lo, hi = q[live], lo[live], hi[live]
            depth += 1
        if not errors:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, j, lo, hi = (np.concatenate(x) for x in zip(*errors))
        found = []
        while len(q):
            over = j >= size[q]
            if over.any():
                l, h = self.extend(np.zeros(over.sum(), np.int64), lo[over], hi[over])
                hit = l < h
                found.append((q[over][hit], self.word[l[hit]]))
                q, j, lo, hi = (x[~over] for x in (q, j, lo, hi))
            lo, hi = self.extend(at(q, j), lo, hi)
            live = lo < hi
            q, j, lo, hi = q[live], j[live] + 1, lo[live], hi[live]
        a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
        return a, b


def _turned(points: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each word backwards."""
    i = np.repeat(np.arange(len(off) - 1), np.diff(off))
    return points[off[i] + off[i + 1] - 1 - np.arange(len(points))]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition: first the rows to index, then the searches, both by whether they read backwards."""
    held: dict[bool, list] = {}
    built: dict[bool, tuple] = {}

    def index(back: bool):
        if back not in built:
            parts = held.pop(back, [])
            words = pa.chunked_array([p[0] for p in parts], pa.string()).combine_chunks()
            count = np.concatenate([p[1] for p in parts])
            points, off = _points(words)
            alphabet = np.unique(points)
            # searches extend to the left, so words that are matched from their start on are kept turned
            symbols = np.searchsorted(alphabet, points) + 1
            built[back] = WordIndex(symbols if back else _turned(symbols, off), off), alphabet, words, count
        return built[back]

    for batch in batches:
        look, back = (np.array(batch.column(c).to_pylist(), bool) for c in ("look", "back"))
        for b in (False, True):
            own = np.flatnonzero(~look & (back == b))
            if len(own):
                part = batch.take(pa.array(own))
                held.setdefault(b, []).append((part.column("word"), part.column("n").to_numpy(zero_copy_only=False)))
            own = np.flatnonzero(look & (back == b))
            if not len(own) or not (b in held or b in built):
                continue
            tree, alphabet, words, count = index(b)
            for s in range(0, len(own), TOGETHER):
                asked = batch.take(pa.array(own[s:s + TOGETHER]))
                points, off = _points(asked.column("word"))
                at = np.minimum(np.searchsorted(alphabet, points), len(alphabet) - 1)
                symbols = np.where(alphabet[at] == points, at + 1, len(alphabet) + 1)
                size = np.diff(off)
                q, w = tree.near(_turned(symbols, off) if b else symbols, off, size - size // 2 if b else size // 2)
                yield pa.RecordBatch.from_arrays(
                    [asked.column("word").take(pa.array(q)), words.take(pa.array(w)), pa.array(count[w])], names=["word", "near", "near_n"])


def near_words(words: DataFrame, half_words: int = HALF_WORDS, task_words: int = TASK_WORDS) -> DataFrame:
    """(word, near, near_n): every ordered pair of words of ``words`` (word, n; distinct, of two code points or more) that
    differ by exactly one inserted, deleted or replaced code point."""
    size = F.length("word")

    def first(n: Column) -> Column:
        return F.substring("word", F.lit(1), n)

    def last(n: Column) -> Column:
        return F.substring("word", size - n + 1, n)

    half = F.floor(size / 2).cast("int")
    both = (F.struct(F.lit(False).alias("back"), first(half).alias("part")), F.struct(F.lit(True).alias("back"), last(size - half).alias("part")))
    looks = words.select("word", F.explode(F.array(*both)).alias("p")).select("word", "p.back", "p.part")
    # a search may come from a word one code point shorter or longer
    put = [F.struct(F.lit(False).alias("back"), first(F.floor((size + d) / 2).cast("int")).alias("part")) for d in (-1, 0, 1)]
    put += [F.struct(F.lit(True).alias("back"), last((size + d - F.floor((size + d) / 2)).cast("int")).alias("part")) for d in (-1, 0, 1)]
    rows = words.select("word", "n", F.explode(F.array_distinct(F.array(*put))).alias("p")).select("word", "n", "p.back", "p.part")
    # blocks of halves with too many words for one; as many as all words together have room for at most
    many = rows.groupBy("back", "part").agg(F.count("*").alias("c")).filter(F.col("c") > half_words)
    many, _ = broadcast_if_small(many.select(F.col("back").alias("_b"), F.col("part").alias("_p"), F.ceil(F.col("c") / half_words).cast("int").alias("blocks")))
    same = (F.col("back") == F.col("_b")) & (F.col("part") == F.col("_p"))
    blocks = F.coalesce("blocks", F.lit(1))
    rows = rows.join(many, same, "left").select(
        "word", "n", "back", "part", F.pmod(F.xxhash64("word"), blocks).cast("int").alias("block"), F.lit(False).alias("look"))
    looks = looks.join(many, same, "left").select(
        "word", F.lit(0).cast("long").alias("n"), "back", "part", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("look"))
    parts = max(words.sparkSession.sparkContext.defaultParallelism, -(-4 * words.count() // task_words))
    dealt = rows.unionByName(looks).repartition(parts, "back", "part", "block").sortWithinPartitions("look", "back")
    return dealt.select("word", "n", "back", "look").mapInArrow(_search, "word string, near string, near_n long")


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``words`` (word, n; distinct) with n_near, how many other words are one edit away; form, the most frequent of
    these (the smallest by code points of equal ones) if it is at least ``times`` as frequent, and form_n; and root, the last
    word when forms are followed, or the word itself."""
    near = near_words(words).distinct()
    best = near.groupBy(F.col("word").alias("_w")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    w = words.join(best, F.col("word") == F.col("_w"), "left")
    good = -F.col("b.m") >= F.col("n") * times
    w = written(w.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("b.near")).alias("form"),
                         F.when(good, -F.col("b.m")).alias("form_n")), "forms")
    # a form is ``times`` as frequent as its word, so chains are short, and each round doubles the steps
    root = w.filter("form is not null").select("word", F.col("form").alias("root"))
    on = root.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
    while True:
        more = written(root.join(on, F.col("root") == F.col("_at"), "left")
                       .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("went")), "roots")
        root = more.select("word", "root")
        if more.filter("went").isEmpty():
            break
        on = root.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
    root = root.select(F.col("word").alias("_w"), "root")
    return w.join(root, F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, typo_of: int | None = None, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near and form_n of the vocabulary of ``docs`` (doc_id, text).

    Nulls and empty texts have no words; repeated rows count as often as they stand there; a null doc_id
    only matters for ``typo_of``, as the empty string. Equal counts are told apart by code-point order.
    Other columns are not read. Empty tables give no rows.
    """
    return group_variants(written(vocabulary(docs, typo_of), "words"), times)
