"""Benchmark phrases in training texts by FM-indexes of training shards.

Each shard (the texts of an Arrow batch, cut where its symbols reach SHARD) becomes a sequence of symbols: the rank
of each word in the phrases' vocabulary, with one separator where other words stand; stretches too
short for any phrase hold no match and are left out. Its suffix array gives the Burrows-Wheeler
transform, kept as a wavelet matrix. All phrases are searched backward together, a rank query on the
wavelet matrix for each word; occurrences are located by walking to suffixes whose positions were
sampled, and hits in one document merge into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textlab.llm.common import ALNUM_WORD, Rolling, chunks, mix64, text_key, utf8, word_count, word_ranges

WINDOW = 10
#: symbols of one shard's index, and words of items that are searched in one pass over the documents
SHARD, ITEM_WORDS = 1 << 20, 1 << 20
#: every so many text positions the suffix array is kept
SAMPLE = 16

_WORDS = Rolling(31, fold_case=True)


def words_of(data: np.ndarray, off: np.ndarray):
    """Hashes of the words of a chunk's rows, their byte ranges, and each row's first word."""
    start, end, first = word_ranges(data, off, ALNUM_WORD)
    w = mix64(_WORDS.ranges(_WORDS.prefix(data), start, end) + (end - start).astype(np.uint64)) if len(start) else np.zeros(0, np.uint64)
    return w, start, end, first


class Phrases:
    """The distinct windows of a block of items, over the ranks of their words from 1 on."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        w, _, _, first = words_of(*utf8(pa.array([t for _, t in items], pa.string())))
        self.vocabulary, rank = np.unique(w, return_inverse=True)
        rank = rank + 1
        owners: dict[tuple, set[str]] = {}
        for (item, _), s, e in zip(items, first[:-1], first[1:]):
            for i in range(s, max(s + 1, e - window + 1) if e > s else s):
                owners.setdefault(tuple(rank[i:min(i + window, e)].tolist()), set()).add(item)
        self.names = np.array(sorted({i for o in owners.values() for i in o}), dtype=object)
        at = {n: k for k, n in enumerate(self.names)}
        self.size = np.array([len(k) for k in owners], np.int64)
        self.symbols = np.zeros((len(owners), window), np.int64)  # right-aligned
        for r, k in enumerate(owners):
            self.symbols[r, window - len(k):] = k
        self.owner = [np.array([at[i] for i in o]) for o in owners.values()]
        self.shortest = int(self.size.min()) if len(owners) else 0


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling the compared length."""
    n, k = len(seq), 1
    rank = seq.astype(np.int64) + 1
    while True:
        key = rank << 32
        key[:n - k] |= rank[k:]
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[1], (s[1:] != s[:-1]).astype(np.int64)]))
        if new[order[-1]] == n or 2 * k >= n:
            return order
        rank, k = new, 2 * k


class FMIndex:
    """Backward search and location over a sequence of small integers that ends in a unique 0."""

    def __init__(self, seq: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(seq)
        bwt = seq[order - 1]
        self.levels = max(1, int(seq.max()).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.levels):
            bit = (bwt >> (self.levels - 1 - level)) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        self.count = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=1 << self.levels))])
        self.first = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))
        self.sampled = order % sample == 0
        self.at = order[self.sampled]
        self.sampled_before = np.concatenate([[0], np.cumsum(self.sampled)])

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            one = self.ones[level][i]
            i = np.where((symbol >> (self.levels - 1 - level)) & 1, self.zeros[level] + one, i - one)
        return i

    def before(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Row of the first suffix that starts with ``symbol`` followed by row ``i`` or a later one."""
        return self.count[symbol] + self._down(symbol, i) - self.first[symbol]

    def search(self, phrases: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that start with each right-aligned phrase."""
        low, high = np.zeros(len(size), np.int64), np.full(len(size), len(self.sampled), np.int64)
        for t in range(phrases.shape[1]):
            live = np.flatnonzero((size > t) & (low < high))
            c = phrases[live, phrases.shape[1] - 1 - t]
            fits = c < 1 << self.levels
            high[live[~fits]] = low[live[~fits]]
            live, c = live[fits], c[fits]
            low[live], high[live] = self.before(c, low[live]), self.before(c, high[live])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps to the suffix one earlier until a sampled one is met."""
        row, steps, out = row.copy(), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        live = np.arange(len(row))
        while len(live):
            r = row[live]
            hit = self.sampled[r]
            out[live[hit]] = self.at[self.sampled_before[r[hit]]] + steps[live[hit]]
            live = live[~hit]
            i, symbol = row[live], np.zeros(len(live), np.int64)
            for level in range(self.levels):
                one = self.ones[level][i]
                bit = self.ones[level][i + 1] - one
                symbol = symbol * 2 + bit
                i = np.where(bit, self.zeros[level] + one, i - one)
            row[live] = self.count[symbol] + i - self.first[symbol]
            steps[live] += 1
        return out


def _search(phrases: Phrases, seq: list[np.ndarray], word: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Occurrences in one shard: phrase, first word, number of words."""
    if not seq or not len(phrases.size):
        return
    s, w = np.concatenate([*seq, [0]]), np.concatenate([*word, [-1]])
    # separators get a symbol above the vocabulary, so that the end is the only 0
    s[:-1][s[:-1] == 0] = len(phrases.vocabulary) + 1
    index = FMIndex(s)
    low, high = index.search(phrases.symbols, phrases.size)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    for a in range(0, len(rows), SHARD):
        yield which[a:a + SHARD], w[index.locate(rows[a:a + SHARD])], phrases.size[which[a:a + SHARD]]


def _symbols(phrases: Phrases, w: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and word numbers of the stretches of vocabulary words long enough for a phrase, each
    with a separator after it."""
    v = phrases.vocabulary
    if not len(v) or not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(v, w), len(v) - 1)
    known = v[at] == w
    edge = np.zeros(len(w) + 1, bool)
    edge[first] = True
    new = np.flatnonzero(known & (edge[:-1] | ~np.concatenate([[False], known[:-1]])))
    end = np.flatnonzero(known & (edge[1:] | ~np.concatenate([known[1:], [False]]))) + 1
    long = end - new >= phrases.shortest
    new, n = new[long], (end - new)[long] + 1
    i = np.repeat(new - (np.cumsum(n) - n), n) + np.arange(n.sum())
    sep = np.cumsum(n) - 1
    s = np.concatenate([at + 1, [0]])[i]
    s[sep] = 0
    return s, i


def _scan(docs: DataFrame, phrases: Phrases) -> DataFrame:
    """(doc_id, k, n_words, spans, items) for each row; spans in words [w, e) and bytes [b, f)."""

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            base, firsts, starts, ends, seq, word, found = 0, [], [], [], [], [], []
            for i, j in chunks(off):
                w, s, e, first = words_of(data[off[i]:off[j]], off[i:j + 1] - off[i])
                row = np.repeat(np.arange(j - i), np.diff(first))
                firsts.append(first[:-1] + base)
                starts.append((s - (off[i:j] - off[i])[row]).astype(np.int32))
                ends.append((e - (off[i:j] - off[i])[row]).astype(np.int32))
                sym, at = _symbols(phrases, w, first)
                seq.append(sym)
                word.append(at + base)
                base += len(w)
                if sum(map(len, seq)) >= SHARD:
                    found += _search(phrases, seq, word)
                    seq, word = [], []
            found += _search(phrases, seq, word)
            first = np.concatenate([*firsts, [base]])
            start, end = np.concatenate(starts) if starts else np.zeros(0), np.concatenate(ends) if ends else np.zeros(0)
            hit, pairs = np.zeros(base + 1, np.int32), []
            for which, at, size in found:
                np.add.at(hit, at, 1)
                np.add.at(hit, at + size, -1)
                row = np.searchsorted(first, at, side="right") - 1
                key = np.unique(row * len(phrases.size) + which)
                pairs.append(key)
            hit = np.cumsum(hit[:-1]) > 0
            edge = np.zeros(base + 1, bool)
            edge[first] = True
            s = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
            e = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]])))
            row = np.searchsorted(first, s, side="right") - 1
            values = pa.StructArray.from_arrays(
                [pa.array(x.astype(np.int32)) for x in (s - first[row], e + 1 - first[row], start[s], end[e])], names=["w", "e", "b", "f"])
            n_rows = batch.num_rows
            spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n_rows + 1)).astype(np.int32)), values)
            items: list[set] = [set() for _ in range(n_rows)]
            if pairs:
                for key in np.unique(np.concatenate(pairs)).tolist():
                    items[key // len(phrases.size)].update(phrases.names[phrases.owner[key % len(phrases.size)]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k"), pa.array(np.diff(first).astype(np.int64)), spans,
                 pa.array([sorted(x) for x in items], pa.list_(pa.string()))], names=["doc_id", "k", "n_words", "spans", "items"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("k"), "text")
    return src.mapInArrow(run, "doc_id long, k long, n_words long, spans array<struct<w:int,e:int,b:int,f:int>>, items array<string>")


def _merged(spans: Column) -> Column:
    """Overlapping and adjacent spans joined."""
    kind = "array<struct<w:int,e:int,b:int,f:int>>"

    def step(s, x):
        top = F.element_at(s, -1)
        joined = F.struct(top["w"].alias("w"), F.greatest(top["e"], x["e"]).alias("e"), top["b"].alias("b"), F.greatest(top["f"], x["f"]).alias("f")).cast(kind[6:-1])
        return F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["e"] >= x["w"]),
                      F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(joined))).otherwise(F.concat(s, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_words: int = ITEM_WORDS) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, k (the text's key), n_words, items (sorted item_ids
    with occurring windows) and spans, the merged ranges of hit words and their bytes.

    ``benchmark`` (item_id, text) is searched whole, in blocks of about ``item_words`` words, each of
    which is one pass over the documents; a block is all that the driver and a task hold of it. Null
    texts have no words and null item_ids are the item "null". Rows that repeat (doc_id, text) are
    returned as often; equal item_ids are one item. An empty benchmark hits nothing; other columns are
    not read.
    """

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    total = int(items.agg(F.coalesce(F.sum(word_count("text") + 1), F.lit(0))).first()[0])
    n = max(1, -(-total // item_words))
    found = None
    for block in range(n):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == block)
        rows = _scan(docs, Phrases([tuple(r) for r in part.collect()], window))
        found = rows if found is None else found.unionByName(rows)
    by_row = found.groupBy("doc_id", "k").agg(
        F.count("*").alias("_c"), F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    copies = F.explode(F.sequence(F.lit(1), F.expr(f"cast(_c div {n} as int)")))
    return by_row.select("doc_id", "k", "n_words", _merged(F.col("spans")).alias("spans"), "items", copies.alias("_i")).drop("_i")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["e"] - x["w"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
