"""Near duplicates of word shingles: MinHash with tensored banding, every link confirmed on full sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import (SPACE_WORD, Rolling, chunks, mix64, text_key, utf8, word_ranges, written)
from textlab.llm.components import components
from textlab.operators.joins import broadcast_if_small

#: shingle width in words, and the similarity of a link in hundredths
WIDTH, PERCENT = 5, 75
#: two collections of GROUPS groups of ROWS minhashes; a table for each pair of groups, one from either.
#: At similarity 0.75 a pair misses every table with probability 1 - (1 - (1 - 0.75**2)**10)**2 = 0.0005,
#: for 40 minhashes; 100 separate tables of 4 would take 400.
GROUPS, ROWS = 10, 2
#: the members of larger buckets are compared with the smallest one, their hub, and with each other only
#: where what tells them from the hub leaves a link possible
SMALL = 16

_WORDS = Rolling(11, fold_case=True)
_RNG = np.random.default_rng(12)
_PLACE = _RNG.integers(0, 2**63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SIGN = "n long, d1 long, d2 long, a array<long>, b array<long>"


def shingle_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all word shingles of the rows of a chunk, and where each row's begin.
    A row with fewer words than WIDTH has its whole sequence as one; without words it has none."""
    start, end, first = word_ranges(data, off, SPACE_WORD)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    w = mix64(_WORDS.ranges(_WORDS.prefix(data), start, end) + (end - start).astype(np.uint64))
    n_words = np.diff(first)
    n = np.where(n_words >= WIDTH, n_words - WIDTH + 1, np.minimum(n_words, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    row = np.repeat(np.arange(len(n)), n)
    i = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    out = np.zeros(at[-1], np.uint64)
    padded = np.concatenate([w, np.zeros(WIDTH, np.uint64)])
    size = np.minimum(n_words, WIDTH)[row]
    for j in range(WIDTH):
        out += np.where(j < size, padded[i + j], np.uint64(0)) * _PLACE[j]
    return mix64(out + size.astype(np.uint64)), at


def shingle_sets(text: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """For ranges of rows, each row's shingle set as a sorted array."""
    data, off = utf8(text)
    for i, j in chunks(off):
        h, at = shingle_hashes(data[off[i]:off[j]], off[i:j + 1] - off[i])
        sets = []
        for s, e in zip(at[:-1], at[1:]):
            x = h[s:e]
            x.sort()
            sets.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if e > s else x)
        yield i, j, sets


def _groups(sets: list[np.ndarray], seed: int, groups: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The two collections: a 64-bit value for each (row with shingles, group)."""
    rng = np.random.default_rng(seed)
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    halves = []
    for _ in range(2):
        out = np.zeros((groups, len(sets)), np.uint64)
        for g in range(groups):
            for _ in range(rows):
                mul, add = (int(x) | 1 for x in rng.integers(0, 2**63, 2, dtype=np.uint64))
                least = np.minimum.reduceat(flat * np.uint64(mul) + np.uint64(add), at)
                out[g] = mix64(out[g] * np.uint64(31) + least)
        halves.append(out.T.copy())
    return halves[0], halves[1]


def _lists(x: np.ndarray) -> pa.Array:
    n, m = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(x.reshape(-1).view(np.int64)))


def signatures(docs: DataFrame, seed: int = 1, groups: int = GROUPS, rows: int = ROWS) -> DataFrame:
    """(doc_id, k, n, d1, d2, a, b): the set's size, a 128-bit digest of the set, and its two collections
    of minhash groups (empty sets have null digests and collections)."""

    def run(batches):
        for batch in batches:
            for i, j, sets in shingle_sets(batch.column("text")):
                some = [s for s in sets if len(s)]
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n > 0)
                take = np.full(len(sets), -1)
                take[full] = np.arange(len(full))
                idx = pa.array(take, mask=take < 0)
                if some:
                    a, b = _groups(some, seed, groups, rows)
                    at = np.cumsum([0, *map(len, some[:-1])])
                    flat = np.concatenate(some)
                    d1, d2 = (np.add.reduceat(mix64(flat ^ np.uint64(x)), at).view(np.int64) for x in (0x5851F42D, 0x14057B7E))
                else:
                    a = b = np.zeros((0, groups), np.uint64)
                    d1 = d2 = np.zeros(0, np.int64)
                keys = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays(
                    [keys.column("doc_id"), keys.column("k"), pa.array(n.astype(np.int64)), pa.array(d1).take(idx),
                     pa.array(d2).take(idx), _lists(a).take(idx), _lists(b).take(idx)],
                    names=["doc_id", "k", "n", "d1", "d2", "a", "b"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("k"), "text")
    return src.mapInArrow(run, f"doc_id long, k long, {_SIGN}")


def _entries(sig: DataFrame, groups: int) -> DataFrame:
    """A row (key, id, k, n) for each set and table: keys are pairs of a group from either collection."""
    pair = F.explode(F.expr(f"flatten(transform(sequence(0, {groups - 1}), i -> transform(sequence(0, {groups - 1}), "
                            "j -> xxhash64(i, j, a[i], b[j]))))")).alias("key")
    return sig.select(pair, "id", "k", "n")


def _fits(x: str, y: str) -> str:
    """Sizes between which a link is possible at all."""
    return f"100 * least({x}, {y}) >= {PERCENT} * greatest({x}, {y})"


def _pairs_within(entries: DataFrame) -> DataFrame:
    """All pairs within buckets of bounded size."""
    met = entries.groupBy("key").agg(F.collect_list(F.struct("id", "k", "n")).alias("m"))
    pairs = F.expr("flatten(transform(m, x -> transform(filter(m, y -> x.id < y.id and "
                   f"{_fits('x.n', 'y.n')}), y -> struct(x.id as a, x.k as ak, y.id as b, y.k as bk))))")
    return met.select(F.explode(pairs).alias("p")).select("p.*")


def _to_hub(entries: DataFrame) -> DataFrame:
    """Each member of a bucket with the smallest one."""
    return (entries.filter("id > least.id or (id = least.id and k > least.k)")
            .select(F.col("least.id").alias("a"), F.col("least.k").alias("ak"), F.col("id").alias("b"), F.col("k").alias("bk")).distinct())


def apart(hub: np.ndarray, other: np.ndarray) -> tuple[int, np.ndarray]:
    """What tells a set from the hub: the size of the symmetric difference, and a bitmap with a bit set
    for each element's hash, two bits wide for each shingle of the hub."""
    d = np.setxor1d(hub, other, assume_unique=True)
    words = len(hub) // 32 + 1
    bits = np.zeros(words * 64, np.uint8)
    bits[d % np.uint64(words * 64)] = 1
    return len(d), np.packbits(bits).view(np.int64)


def _met(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, ak, b, bk) with their texts."""
    ids = written(pairs.select(F.col("a").alias("i"), F.col("ak").alias("ik"))
                  .unionByName(pairs.select(F.col("b").alias("i"), F.col("bk").alias("ik"))).distinct(), "ids")
    ids, _ = broadcast_if_small(ids, max_bytes=8 << 20, materialize=False)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), text_key().alias("_k"), "text").join(
        ids, (F.col("_id") == F.col("i")) & (F.col("_k") == F.col("ik"))).select("_id", "_k", "text")
    left = texts.select(F.col("_id").alias("a"), F.col("_k").alias("ak"), F.col("text").alias("ta"))
    right = texts.select(F.col("_id").alias("b"), F.col("_k").alias("bk"), F.col("text").alias("tb"))
    return pairs.join(left, ["a", "ak"]).join(right, ["b", "bk"])


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, ak, b, bk, star) with ``linked``, whether their full shingle sets have
    100 * intersection >= 75 * union; for stars also the size n of b's set and what tells it from a's."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 256):  # the sets of a few pairs at a time
                batch = whole.slice(i, 256)
                x = [s for _, _, sets in shingle_sets(batch.column("ta")) for s in sets]
                y = [s for _, _, sets in shingle_sets(batch.column("tb")) for s in sets]
                linked, far, bits = [], [], []
                for s, t, star in zip(x, y, batch.column("star").to_pylist()):
                    both = len(s) + len(t) - len(np.union1d(s, t))
                    linked.append(both > 0 and 100 * both >= PERCENT * (len(s) + len(t) - both))
                    d, b = apart(s, t) if star else (0, np.zeros(0, np.int64))
                    far.append(d)
                    bits.append(b)
                at = np.cumsum([0, *map(len, bits)]).astype(np.int32)
                flat = pa.array(np.concatenate(bits))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("a", "ak", "b", "bk", "star")), pa.array(linked, pa.bool_()),
                     pa.array([len(t) for t in y], pa.int64()), pa.array(far, pa.int64()), pa.ListArray.from_arrays(pa.array(at), flat)],
                    names=["a", "ak", "b", "bk", "star", "linked", "n", "far", "bits"])

    met = _met(pairs, docs).select("a", "ak", "b", "bk", "star", "ta", "tb")
    return met.mapInArrow(run, "a long, ak long, b long, bk long, star boolean, linked boolean, n long, far long, bits array<long>")


def _past_hub(judged: DataFrame) -> DataFrame:
    """Pairs of sets with a common hub, in different components so far, that may be linked although one
    of them, y, is not linked to the hub.

    Let X and Y be what tells x and y from the hub (their symmetric differences with it). A link asks for
    |X xor Y| <= (|x| + |y|) / 7, so X and Y share at least (|X| + |Y| - (|x| + |y|) / 7) / 2 elements.
    A bit of X's map that Y's lacks stands for an element that is not shared: pairs that differ in too
    many bits are no link, and the join's condition leaves them out. No linked pair is lost.
    """
    comp = components(judged.filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v")))
    stars = judged.filter("star").join(comp, F.col("b") == F.col("node"), "left")
    s = stars.select("a", "ak", F.col("b").alias("y"), F.col("bk").alias("yk"), F.col("n").alias("ny"),
                                     F.col("far").alias("fy"), F.col("bits").alias("by"), F.col("linked").alias("ly"),
                     F.coalesce("component", "b").alias("cy"))
    o = s.toDF("a2", "ak2", "x", "xk", "nx", "fx", "bx", "lx", "cx")
    lost = "aggregate(zip_with({0}, {1}, (p, q) -> bit_count(p & ~q)), 0, (s, v) -> s + v)"
    shared = f"least(fx - {lost.format('bx', 'by')}, fy - {lost.format('by', 'bx')})"
    may = (f"a = a2 and ak = ak2 and (lx or x < y) and cx <> cy and {_fits('nx', 'ny')} and "
           f"14 * least(fx, fy) >= 7 * (fx + fy) - (nx + ny) and 14 * {shared} >= 7 * (fx + fy) - (nx + ny)")
    met = s.filter("not ly").join(o, F.expr(may))
    first = F.expr("x < y")
    return met.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("xk")).otherwise(F.col("yk")).alias("ak"),
                      F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), F.when(first, F.col("yk")).otherwise(F.col("xk")).alias("bk")).distinct()


def _grouped(e: DataFrame) -> DataFrame:
    """Entries (key, id, k, n) of buckets with several members, with the bucket's size and smallest member."""
    g = (e.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "k")).alias("least"))
         .filter("size > 1").withColumnRenamed("key", "_key"))
    return e.join(g, e["key"] == g["_key"]).drop("_key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_shingles, component_id, kept.

    1. Each row gets its set's digest and its minhash groups; equal sets become one class, searched once.
    2. Tables are keyed by pairs of groups, one from either collection. Buckets of up to SMALL classes
       give all their pairs, larger ones the pairs of their smallest member, the hub, with the others.
       Members of a large bucket that may be linked past the hub are told by how they differ from it.
    3. Each pair is confirmed on the two full sets; components come from the confirmed links and from
       the classes' members.

    Nulls and empty texts have no shingles and no links: component_id is their own doc_id, kept is true.
    Rows with a null doc_id are not linked (null component_id, kept true). Rows that repeat a doc_id are
    one node of the graph; each is returned. Other columns are not read; empty tables give no rows.
    """
    sig = written(signatures(docs), "signatures")
    known = sig.filter("doc_id is not null and n > 0")
    cls = written(known.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "k")).alias("least"))
                  .select("n", "d1", "d2", F.col("least.doc_id").alias("id"), F.col("least.k").alias("k")), "classes")
    reps = (known.withColumnRenamed("doc_id", "id").dropDuplicates(["id", "k"])
            .join(cls.select("id", "k"), ["id", "k"], "left_semi"))
    found = written(_grouped(_entries(reps, GROUPS)), "buckets")
    pairs = (_pairs_within(found.filter(F.col("size") <= SMALL)).withColumn("star", F.lit(False))
             .unionByName(_to_hub(found.filter(F.col("size") > SMALL)).withColumn("star", F.lit(True)))
             .groupBy("a", "ak", "b", "bk").agg(F.max("star").alias("star")))
    judged = written(_confirmed(written(pairs, "pairs"), docs), "judged")
    past = written(_past_hub(judged).join(judged, ["a", "ak", "b", "bk"], "left_anti").withColumn("star", F.lit(False)), "past")
    more = written(_confirmed(past, docs), "judged")
    links = judged.unionByName(more).filter("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    member = (known.join(cls.withColumnRenamed("id", "rep").drop("k"), ["n", "d1", "d2"])
              .select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).filter("u <> v").distinct())
    comp = components(links.unionByName(member)).withColumnRenamed("node", "_node")
    out = sig.join(comp, F.col("doc_id") == F.col("_node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
                      F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("doc_id")), F.lit(True)).alias("kept"))
