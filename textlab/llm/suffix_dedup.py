"""Repeated byte windows by refining groups of equal digests.

The dealt method, a depth-limited radix sort of all suffixes, would make a record of every byte for each pass. Only equal
windows have to meet, which takes no order among the others, so groups of windows are refined by digests instead, from coarse to
fine, and those that occur once leave early. A window's first digest is its anchor: the stretch
of ANCHOR bytes in it with the smallest hash (the leftmost of equal ones). Equal windows have the same
anchor at the same place. Neighbouring windows mostly share their anchor, so the first passes work on
whole runs of them as one record:

1. by the anchor: runs whose anchor occurs once leave;
2. by the whole stretch of bytes that a run's windows span: in a group of equal runs all but
   the first run are decided, every window of theirs starts earlier in the first;
3. for the first runs of groups that share their anchor with another group: blocks of BLOCK windows,
   by the bytes common to a block's windows; blocks alone with these leave;
4. the remaining windows one by one, by all their bytes.

Each pass is a hash aggregation of 64-bit digests with map-side combining, so a window found in a third
of all documents reaches no task more often than once per map task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import Rolling, chunks, mix64, text_key, utf8, written

WIDTH, ANCHOR, BLOCK = 100, 32, 8

_ONE, _TWO = Rolling(21), Rolling(22)


def _pack(start: np.ndarray, more: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A run in one long that orders by start: first window's start, further windows, and the anchor's
    distance from the last window's start."""
    return (start << 30) | (more << 23) | (place << 16)


def runs(data: np.ndarray, off: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR):
    """Runs of windows with one anchor in the rows of a chunk: first and last window's start, and anchor."""
    n, reach = len(data), width - anchor + 1
    prefix = _ONE.prefix(data)
    if n < width:
        e = np.zeros(0, np.int64)
        return e, e, e, prefix
    at = np.arange(n - anchor + 1)
    h = mix64(_ONE.ranges(prefix, at, at + anchor))
    low = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    size = 1
    while size * 2 <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[:len(low) - (reach - size)], low[reach - size:])
    best = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    fits = np.zeros(n + 1, np.int32)  # windows that end within their row
    long = np.diff(off) >= width
    np.add.at(fits, off[:-1][long], 1)
    np.add.at(fits, off[1:][long] - width + 1, -1)
    p = np.flatnonzero(np.cumsum(fits[:len(best)]) > 0)
    x = best[p]
    new = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (p[1:] != p[:-1] + 1)])) if len(p) else p
    last = np.concatenate([new[1:], [len(p)]]) - 1 if len(p) else p
    return p[new], p[last], x[new], prefix


def _digest(one: np.ndarray, two: np.ndarray, start, end, more) -> np.ndarray:
    """64-bit digest of byte ranges and a small number, from two rolling hashes."""
    a = mix64(_ONE.ranges(one, start, end) + (end - start).astype(np.uint64))
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + _TWO.ranges(two, start, end) + mix64(more.astype(np.uint64))).view(np.int64)


def _run_table(texts: DataFrame) -> DataFrame:
    """(h, d, doc_id, pos, k): each run's anchor hash, the digest of its bytes, and where it is."""

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            ids, key = batch.column("doc_id"), batch.column("k")
            for i, j in chunks(off):
                o = off[i:j + 1] - off[i]
                part = data[off[i]:off[j]]
                first, last, x, one = runs(part, o)
                if not len(first):
                    continue
                two = _TWO.prefix(part)
                row = np.searchsorted(o, first, side="right") - 1
                h = mix64(_ONE.ranges(one, x, x + ANCHOR)).view(np.int64)
                d = _digest(one, two, first, last + WIDTH, x - first)
                pos = _pack(first - o[row], last - first, x - last)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(d), ids.take(pa.array(i + row)), pa.array(pos), key.take(pa.array(i + row))],
                                                 names=["h", "d", "doc_id", "pos", "k"])

    return texts.mapInArrow(run, "h long, d long, doc_id long, pos long, k long")


def _run_bytes(places: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, k, run, bytes): the bytes that the windows of each run in ``places`` span. Texts are dealt
    out once for it, each with the list of its runs (bounded by the text)."""
    p = places.groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).agg(F.collect_list("pos").alias("at"))
    rows = texts.join(p, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k"))).select("doc_id", "k", "text", "at")

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            at = batch.column("at")
            pos = np.asarray(at.flatten())
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(at.offsets)))
            for i in range(0, len(pos), 1 << 14):
                q, r = pos[i:i + (1 << 14)], row[i:i + (1 << 14)]
                start = off[r] + (q >> 30)
                size = ((q >> 23) & 127) + WIDTH
                ends = np.cumsum(size)
                cut = data[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), len(q), [None, offsets, pa.py_buffer(cut)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(r)), batch.column("k").take(pa.array(r)), pa.array(q), column],
                                                 names=["doc_id", "k", "run", "bytes"])

    return rows.mapInArrow(run, "doc_id long, k long, run long, bytes binary")


def _blocks(rows: DataFrame, single: bool) -> DataFrame:
    """From (doc_id, k, run, bytes, pos): a record for each block of the windows in ``pos``, a part of the
    run (blocks are aligned by the windows' distance from the anchor), with the digest of the bytes common to
    a whole block's windows and the digest of all its bytes; or one for each single window."""

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column("bytes"))
            whole, part = np.asarray(batch.column("run")), np.asarray(batch.column("pos"))
            for i, j in chunks(off):
                bytes_, base, pos = data[off[i]:off[j]], off[i:j] - off[i], part[i:j]
                first = base + (pos >> 30) - (whole[i:j] >> 30)
                more = (pos >> 23) & 127
                anchor = first + more + ((pos >> 16) & 127)
                one, two = _ONE.prefix(bytes_), _TWO.prefix(bytes_)
                # distances of the windows' starts from the anchor, cut at multiples of the block's size
                far, near = anchor - first, anchor - first - more
                size = 1 if single else BLOCK
                n = far // size - near // size + 1
                src = np.repeat(np.arange(len(pos)), n)
                b = (near // size)[src] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hi = np.minimum(far[src], b * size + size - 1)
                lo = np.maximum(near[src], b * size)
                s, e = anchor[src] - hi, anchor[src] - lo
                # common to the windows of the whole block, also where a run has only some of them
                core = _digest(one, two, anchor[src] - b * size, anchor[src] - b * size - size + 1 + WIDTH, b)
                p = _pack(s - base[src] + (whole[i:j] >> 30)[src], e - s, lo)
                ids, key = (batch.column(c).take(pa.array(i + src)) for c in ("doc_id", "k"))
                if single:
                    yield pa.RecordBatch.from_arrays([pa.array(core), ids, pa.array(p), key], names=["h", "doc_id", "pos", "k"])
                else:
                    full = _digest(one, two, s, e + WIDTH, b + (hi << 8))
                    yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(full), ids, pa.array(p), key, pa.array(whole[i:j][src])],
                                                     names=["h", "d", "doc_id", "pos", "k", "run"])

    return rows.mapInArrow(run, "h long, doc_id long, pos long, k long" if single else "h long, d long, doc_id long, pos long, k long, run long")


def _refined(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """One pass over records (h, d, doc_id, pos, k and further columns): records whose h occurs once leave; of
    equal (h, d) all but the first are decided; the first ones of the h that have several d go on."""
    often = found.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("h").alias("_h"))
    kept = written(found.join(often, found["h"] == often["_h"]).drop("_h"), name)
    further = [c for c in kept.columns if c not in ("h", "d")]
    groups = kept.groupBy("h", "d").agg(F.min(F.struct(*further)).alias("least"), F.count("*").alias("n"))
    lead = groups.filter("n > 1").select(F.col("h").alias("_h"), F.col("d").alias("_d"), F.expr("struct(least.doc_id as doc_id, shiftright(least.pos, 30) as at)").alias("least"))
    decided = (kept.join(lead, (kept["h"] == lead["_h"]) & (kept["d"] == lead["_d"]))
               .filter(F.expr("struct(doc_id, shiftright(pos, 30) as at) > least")).select("doc_id", "pos", "k"))
    several = groups.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("h").alias("_h"))
    on = groups.join(several, F.col("h") == F.col("_h")).select("least.*")
    return decided, on


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, k, text) without null texts; doc_id and k tell different texts apart, so k is 0 where no doc_id (or null) has several
    texts, and then takes no room."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    shared = not texts.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if shared:  # only then texts have to be read to tell
        keys = texts.select("doc_id", text_key().alias("k")).groupBy("doc_id").agg(F.min("k").alias("least"), F.max("k").alias("most"))
        shared = not keys.filter("least <> most").isEmpty()
    k = text_key() if shared else F.lit(0).cast("long")
    return texts.select("doc_id", k.alias("k"), "text")


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, k, spans): for each text of (doc_id, k, text) with any, the packed runs of windows of
    WIDTH bytes that also start earlier. See the module for the method and ``removed`` for nulls."""
    whole, edge = _refined(_run_table(texts), "runs")
    cut = written(_run_bytes(edge, texts), "bytes")
    blocks, edge = _refined(_blocks(cut.withColumn("pos", F.col("run")), single=False), "blocks")
    part = edge.select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), F.col("run").alias("_r"), "pos")
    part = cut.join(part, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")) & (F.col("run") == F.col("_r"))).drop("_d", "_k", "_r")
    single = written(_blocks(part, single=True), "windows")
    least = single.groupBy(F.col("h").alias("_h")).agg(F.min(F.struct("doc_id", F.shiftright("pos", 30).alias("at"))).alias("least"), F.count("*").alias("n")).filter("n > 1")
    ones = (single.join(least, single["h"] == least["_h"]).filter(F.expr("struct(doc_id, shiftright(pos, 30) as at) > least"))
            .select("doc_id", "pos", "k"))
    spans = whole.unionByName(blocks).unionByName(ones)
    return spans.groupBy("doc_id", "k").agg(F.collect_set("pos").alias("spans"))


def covered(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal disjoint ranges; ranges that touch are one."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    return s[new], e[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(s) - 1]])]


def removed(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept, the
    remaining bytes.

    A null text is empty; texts under WIDTH bytes lose nothing. Null doc_ids come before all others.
    Rows that repeat a doc_id are judged by (doc_id, start) like one document: of windows with equal
    doc_id and start none is earlier, so exact repeats of a row fare alike; different texts of one doc_id are told apart by 64 bits. Other columns are not read;
    empty tables give no rows.
    """
    texts = _texts(docs)
    spans = repeated_spans(texts).select(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), "spans")
    rows = texts.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")), "left") \
        .select("doc_id", "text", F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            at = batch.column("spans")
            starts, where = np.asarray(at.offsets) - at.offsets[0].as_py(), np.asarray(at.flatten())
            out = []
            for r in range(batch.num_rows):
                b, pos = data[off[r]:off[r + 1]], where[starts[r]:starts[r + 1]]
                n = spans = 0
                kept = b.tobytes()
                if len(pos):
                    s, e = covered(pos >> 30, (pos >> 30) + ((pos >> 23) & 127) + WIDTH)
                    n, spans = int((e - s).sum()), len(s)
                    kept = b"".join(kept[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(b)]))
                out.append((len(b), n, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())))] if out \
                else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
