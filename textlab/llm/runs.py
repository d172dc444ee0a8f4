"""Periodic runs of words by way of a Re-Pair grammar.

The words of a task's texts become ids, and Re-Pair turns the ids into a grammar: pairs of neighbouring
symbols that occur most often are replaced by a new symbol, again and again, until no pair occurs twice;
what is left of a stretch is then paired into a balanced tree. Every run lies in a lowest symbol whose
expansion holds it, and crosses the boundary between that symbol's two parts. So runs across the boundary are
looked for once for each symbol, and hold, moved along, at every place where the symbol was put in; of the
intervals of one period those inside others are dropped.

A run of ``LEAST`` words or more, twice its period at least, holds its first and last LEAST / 2 words
twice, and so on throughout: words in no sequence of LEAST / 2 words that occurs twice in the text are in no run, and the grammar is
made of the stretches between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from textlab.llm.common import SPACE_WORD, Rolling, chunks, mix64, utf8, word_ranges

#: words of the shortest run that counts, and bytes of text that share a grammar (a longer text has its own)
LEAST, TOGETHER = 12, 4 << 20

_WORDS = Rolling(41)


class Equal:
    """Whether ranges of a sequence are equal, by prefix sums of random values times powers modulo two primes."""

    PRIMES = (2147483647, 2147483629)

    def __init__(self, seq: np.ndarray):
        rng = np.random.default_rng(43)
        n = len(seq)
        self.parts = []
        for p in self.PRIMES:
            p = np.uint64(p)
            power = np.ones(n + 1, np.uint64)
            power[1:2] = int(rng.integers(1 << 20, int(p) - 1))
            k = 1
            while k < n:  # powers k + 1 to 2 k from those up to k
                m = min(k, n - k)
                power[k + 1:k + 1 + m] = power[1:1 + m] * power[k] % p
                k *= 2
            value = mix64(seq.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + p) % p
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(value * power[:n] % p, out=total[1:])
            self.parts.append((p, power, total))

    def __call__(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """seq[a:a + size] == seq[b:b + size], for a <= b."""
        same = np.ones(len(a), bool)
        for p, power, total in self.parts:
            i = np.flatnonzero(same)
            x = (total[a[i] + size[i]] - total[a[i]]) % p * power[b[i] - a[i]] % p
            same[i] = x == (total[b[i] + size[i]] - total[b[i]]) % p
        return same


class Grammar:
    """Re-Pair over a sequence in which the symbols of ``alone`` positions belong to no pair.

    Per rule: start, middle and end of its first place, and ``place``, the starts of all of them (those of rule r from
    ``first[r]`` on)."""

    def __init__(self, seq: np.ndarray, alone: np.ndarray, least: int):
        n = len(seq)
        self.start, self.middle, self.end, self.size = [], [], [], []
        self.places: list[np.ndarray] = []
        symbol, at, fixed = seq.astype(np.int64), np.arange(n), alone.copy()
        made = int(symbol.max()) + 1 if n else 0
        while len(symbol) > 1:
            pair = ~(fixed[:-1] | fixed[1:])
            # of equal symbols in a row, every other pair
            twin = np.concatenate([[False], (symbol[1:] == symbol[:-1]) & pair])
            head = np.maximum.accumulate(np.where(~twin, np.arange(len(symbol)), 0))
            pair &= ~((symbol[:-1] == symbol[1:]) & ((np.arange(len(pair)) - head[:-1]) % 2 == 1))
            i = np.flatnonzero(pair)
            kind, which, count = np.unique(symbol[i] * (made + 1) + symbol[i + 1], return_inverse=True, return_counts=True)
            if not len(i) or count.max() < 2:
                break
            # the most frequent pairs first; one is replaced wherever no neighbour is before it
            order = np.empty(len(kind), np.int64)
            order[np.lexsort((mix64(kind.astype(np.uint64)), count))] = np.arange(1, len(kind) + 1)
            rank = np.zeros(len(symbol) + 1, np.int64)
            rank[i + 1] = np.where(count[which] > 1, order[which], 0)
            chosen = np.flatnonzero((rank[1:-1] > 0) & (rank[1:-1] > rank[:-2]) & (rank[1:-1] >= rank[2:]))
            kind, which, count = np.unique(rank[1:][chosen], return_inverse=True, return_counts=True)
            twice = count[which] > 1
            chosen, which = chosen[twice], which[twice]
            kind, which = np.unique(which, return_inverse=True)
            symbol, at, fixed = self._replace(symbol, at, fixed, chosen, which, made, n)
            made += len(kind)
        # what is left, by twos
        while len(symbol) > 1:
            free = ~fixed
            head = np.maximum.accumulate(np.where(fixed, np.arange(len(symbol)) + 1, 0))
            chosen = np.flatnonzero(free[:-1] & free[1:] & ((np.arange(len(symbol) - 1) - head[:-1]) % 2 == 0))
            if not len(chosen):
                break
            symbol, at, fixed = self._replace(symbol, at, fixed, chosen, np.arange(len(chosen)), made, n)
            made += len(chosen)
        empty = [np.zeros(0, np.int64)]
        self.start, self.middle, self.end, self.size, self.place = (
            np.concatenate(x or empty) for x in (self.start, self.middle, self.end, self.size, self.places))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        big = np.flatnonzero(self.end - self.start >= least)
        self.rules = big

    def _replace(self, symbol, at, fixed, chosen, which, made, n):
        end = np.concatenate([at[1:], [n]])
        order = np.argsort(which, kind="stable")
        first = np.searchsorted(which[order], np.arange(int(which.max()) + 1)) if len(which) else np.zeros(0, np.int64)
        one = chosen[order[first]]
        self.start.append(at[one])
        self.middle.append(at[one + 1])
        self.end.append(end[one + 1])
        self.size.append(np.diff(np.concatenate([first, [len(which)]])))
        self.places.append(at[chosen[order]])
        symbol = symbol.copy()
        symbol[chosen] = made + which
        stays = np.ones(len(symbol), bool)
        stays[chosen + 1] = False
        return symbol[stays], at[stays], fixed[stays]


def _reach(same: Equal, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many symbols from a and b on (before them, if ``back``) are equal, ``most`` at most."""
    lo, hi = np.zeros(len(a), np.int64), most.copy()
    while True:
        i = np.flatnonzero(lo < hi)
        if not len(i):
            return lo
        mid = (lo[i] + hi[i] + 1) >> 1
        x, y = (a[i] - mid, b[i] - mid) if back else (a[i], b[i])
        yes = same(x, y, mid)
        lo[i[yes]] = mid[yes]
        hi[i[~yes]] = mid[~yes] - 1


def _across(seq: np.ndarray, same: Equal, start: np.ndarray, middle: np.ndarray, end: np.ndarray, least: int):
    """(rule, start, end, period) of the runs across each rule's middle: those with a whole period before
    it by comparing what stands around ``middle - q`` and ``middle``, the others around ``middle`` and ``middle + q``."""
    out = []
    for left in (True, False):
        room = middle - start if left else end - middle
        # in pieces, as the periods to try are as many as the rules' symbols
        for i, j in chunks(np.concatenate([[0], np.cumsum(room)]), 1 << 20):
            r = np.repeat(np.arange(i, j), room[i:j])
            q = np.arange(len(r)) - np.repeat(np.cumsum(room[i:j]) - room[i:j], room[i:j]) + 1
            m = middle[r]
            a = m - q if left else m
            # of the symbols that repeat, max(q, least - q) or more, half stand on one side; their first or last ones agree
            need = (np.maximum(q, least - q) + 1) >> 1
            ahead, behind = end[r] - a - q, a - start[r]
            fore = (ahead >= need) & (seq[a] == seq[np.minimum(a + q, len(seq) - 1)])
            aft = (behind >= need) & (seq[np.maximum(a, 1) - 1] == seq[a + q - 1])
            may = np.flatnonzero(fore | aft)
            r, q, a, need, fore, aft = r[may], q[may], a[may], need[may], fore[may], aft[may]
            k = np.flatnonzero(fore)
            fore[k] = same(a[k], a[k] + q[k], need[k])
            k = np.flatnonzero(aft & ~fore)
            aft[k] = same(a[k] - need[k], a[k] + q[k] - need[k], need[k])
            may = np.flatnonzero(fore | aft)
            r, q, a = r[may], q[may], a[may]
            f = _reach(same, a, a + q, end[r] - a - q, False)
            g = _reach(same, a, a + q, a - start[r], True)
            good = (f + g >= q) & (f + g + q >= least)
            r, q, a, f, g = (x[good] for x in (r, q, a, f, g))
            out.append((r, a - g, a + q + f, q))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def runs_of(seq: np.ndarray, alone: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all maximal runs of ``seq`` of ``least`` symbols or more, twice the
    period at least; ``alone`` positions are in none. By start, then period."""
    none = (np.zeros(0, np.int64),) * 3
    if len(seq) < least:
        return none
    g = Grammar(seq, alone, least)
    big = g.rules
    r, s, e, q = _across(seq, Equal(seq), g.start[big], g.middle[big], g.end[big], least)
    # of one interval the smallest period
    order = np.lexsort((q, e, s, r))
    r, s, e, q = r[order], s[order], e[order], q[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    r, s, e, q = big[r[new]], s[new], e[new], q[new]
    # at all places of the rule
    i = np.repeat(np.arange(len(r)), g.size[r])
    move = g.place[np.arange(len(i)) - np.repeat(np.cumsum(g.size[r]) - g.size[r], g.size[r]) + g.first[r[i]]] - g.start[r[i]]
    s, e, q = s[i] + move, e[i] + move, q[i]
    order = np.lexsort((-e, s, q))
    s, e, q = s[order], e[order], q[order]
    if not len(s):
        return none
    # of one period, no interval inside another: ends only count beyond all ends before them
    step = np.cumsum(np.concatenate([[0], (q[1:] != q[:-1]).astype(np.int64)])) * (len(seq) + 1)
    top = np.maximum.accumulate(e + step)
    keep = np.concatenate([[True], (e + step)[1:] > top[:-1]])
    s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, s))
    return s[order], e[order], q[order]


def _stretches(ids: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """Which words stand in a sequence of least / 2 words (rounded down) that its text holds twice."""
    k, n = least // 2, len(ids)
    inside = np.zeros(n, bool)
    if n < k:
        return inside
    gram = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        gram = mix64(gram + ids[j:n - k + 1 + j])
    row = np.searchsorted(first, np.arange(n - k + 1), side="right") - 1
    whole = np.arange(n - k + 1) + k <= first[row + 1]
    at = np.flatnonzero(whole)
    key = mix64(gram[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    twin = np.zeros(len(s), bool)
    twin[1:] = s[1:] == s[:-1]
    twin[:-1] |= twin[1:].copy()
    at = at[order[twin]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return np.cumsum(edge[:-1]) > 0


def _text_runs(data: np.ndarray, off: np.ndarray, least: int):
    """Runs of the texts of a chunk: row, first word, length, period; with the words' byte ranges and each row's first word."""
    start, end, first = word_ranges(data, off, SPACE_WORD)
    none = (np.zeros(0, np.int64),) * 4
    if not len(start):
        return none, start, end, first
    ids = mix64(_WORDS.ranges(_WORDS.prefix(data), start, end) + (end - start).astype(np.uint64))
    inside = _stretches(ids, first, least)
    at = np.flatnonzero(inside)
    if not len(at):
        return none, start, end, first
    # stretches with a separator after each: a new one begins after a gap and with each row
    edge = np.zeros(len(ids) + 1, bool)
    edge[first] = True
    cut = np.flatnonzero(edge[at] | np.concatenate([[True], np.diff(at) > 1]))
    place = np.arange(len(at)) + np.searchsorted(cut, np.arange(len(at)), side="right") - 1
    n = len(at) + len(cut)
    seq, alone, word = np.full(n, -1, np.int64), np.ones(n, bool), np.zeros(n, np.int64)
    names, seq[place] = np.unique(ids[at], return_inverse=True)
    alone[place], word[place] = False, at
    seq[alone] = len(names) + np.arange(int(alone.sum()))
    s, e, q = runs_of(seq, alone, least)
    w = word[s]
    row = np.searchsorted(first, w, side="right") - 1
    return (row, w - first[row], e - s, q), start, end, first


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """For each row of (doc_id, text): doc_id, n_words, runs as an array of (start, length, period) by start, then
    period, and collapsed, the words joined by single spaces without those that any run holds after its first period.

    A run is a stretch of consecutive words with smallest period q, of ``least`` words or more and 2 q or more, that
    cannot be extended. Words are runs of anything but ASCII white space. Null and empty texts have no words, no
    runs and an empty collapsed text; rows may repeat and doc_id may be null; other columns are not read;
    empty tables give no rows. A text is worked on within one task, linear in its size but for a logarithm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in chunks(off, TOGETHER):
                part = data[off[i]:off[j]]
                (row, w, length, q), start, end, first = _text_runs(part, off[i:j + 1] - off[i], least)
                gone = np.zeros(len(start) + 1, np.int64)
                np.add.at(gone, first[row] + w + q, 1)
                np.add.at(gone, first[row] + w + length, -1)
                gone = np.cumsum(gone[:-1]) > 0
                hit = set(np.unique(row).tolist())
                raw, texts = part.tobytes(), []
                for d in range(j - i):
                    if d in hit:
                        kept = np.flatnonzero(~gone[first[d]:first[d + 1]]) + first[d]
                        texts.append(b" ".join([raw[s:e] for s, e in zip(start[kept].tolist(), end[kept].tolist())]))
                    else:
                        texts.append(b" ".join(raw[off[i + d] - off[i]:off[i + d + 1] - off[i]].split()))
                values = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (w, length, q)], fields=list(_RUN))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(np.diff(first).astype(np.int64)), runs,
                     pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return src.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """The texts that ``op11_word_runs`` is asked about: (doc_id, text), where every tenth doc_id by its crc32
    repeats a stretch of words from some word on to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", "text", h.alias("_h")).withColumn("_loop", F.col("_h") % 10 == 0)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    d = d.withColumn("_w", F.when(F.col("_loop"), words)).withColumn("_n", F.size("_w")).withColumn("_g", F.expr("_h div 10"))
    d = d.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    d = d.withColumn("_p", F.expr("cast(1 + (_n - _a) div (3 + _g % 8) as int)"))
    tail = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.expr("cast(ceil((_n - _a) / _p) as int)")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(tail, F.lit(1), F.col("_n") - F.col("_a"))), " ")
    return d.select("doc_id", F.when(F.col("_loop") & (F.col("_n") > 0), text).otherwise(F.col("text")).alias("text"))


def _lines(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_runs``: n_runs, the longest run (of equal ones the first) and two digests."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    d = found.withColumn("_b", F.when(F.size("runs") > 0, best))
    length = -F.col("_b.l")
    return d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), length.alias("length"),
                    F.col("_b.period").alias("period"), F.floor(F.lit(1000) * length / F.col("_b.period")).cast("long").alias("exponent_milli"),
                    F.sha2(_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
