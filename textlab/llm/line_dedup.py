"""Line dedup by content-defined chunks of lines.

Each end of a line is ranked by the hash of that line; taken in this order, an end becomes a boundary
unless a neighbouring one already is. So chunks have two or three lines, and boundaries move with the
lines when others are inserted before them. Multi-line chunks whose bytes occur at several places are
removed at all but the first.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from textlab.llm.common import Rolling, chunks, mix64, text_key, utf8, written

#: chunks of fewer lines stay; only a text of one line is such a chunk
LEAST = 2

_LINES = Rolling(51)


def line_ranges(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (with its newline) of each line of a chunk's rows, and each row's first line.
    An empty row has no lines, and a newline at the end of a row begins no further one."""
    newline = np.flatnonzero(data == 10) + 1
    full = np.diff(off) > 0
    start = np.unique(np.concatenate([off[:-1][full], newline]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))[:len(start)]
    return start, end, np.searchsorted(start, off)


def _steps(up: np.ndarray) -> np.ndarray:
    """For each place how many steps up end there without a break."""
    at = np.arange(len(up))
    return at - np.maximum.accumulate(np.where(up, 0, at))


def boundaries(rank: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which places are taken if, group by group, they are tried by (rank, position) and a neighbour of a
    taken one is not. From each local minimum upwards every second place is taken; a peak is if both its
    slopes leave it free. One pass, whatever the ranks."""
    if not len(rank):
        return np.zeros(0, bool)
    near, higher = group[1:] == group[:-1], rank[1:] >= rank[:-1]
    left = _steps(np.append(False, near & higher))
    right = _steps(np.append(False, (near & ~higher)[::-1]))[::-1]
    return (left % 2 == 0) & (right % 2 == 0)


def chunk_lines(data: np.ndarray, off: np.ndarray):
    """Chunks of the rows of a chunk of texts: byte range, number of lines, digest, row."""
    start, end, first = line_ranges(data, off)
    if not len(start):
        e = np.zeros(0, np.int64)
        return e, e, e, e, e
    prefix = _LINES.prefix(data)
    line = mix64(_LINES.ranges(prefix, start, end) + (end - start).astype(np.uint64))
    row = np.searchsorted(off, start, side="right") - 1
    at = np.arange(len(line))
    inner = np.flatnonzero((at > first[row]) & (at < first[row + 1] - 2))  # two lines at least on either side
    stop = np.append(row[1:] != row[:-1], True)
    stop[inner[boundaries(line[inner], row[inner])]] = True
    last = np.flatnonzero(stop)
    head = np.concatenate([[0], last[:-1] + 1])
    s, e = start[head], end[last]
    d = mix64(_LINES.ranges(prefix, s, e) + (e - s).astype(np.uint64)).view(np.int64)
    return s, e, last - head + 1, d, row[last]


def _chunk_table(texts: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            for i, j in chunks(off):
                o = off[i:j + 1] - off[i]
                s, e, n, d, row = chunk_lines(data[off[i]:off[j]], o)
                keep = n >= least
                s, e, d, row = s[keep], e[keep], d[keep], row[keep]
                at = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([pa.array(d), batch.column("doc_id").take(at), batch.column("k").take(at),
                                                  pa.array(s - o[row]), pa.array(e - o[row])], names=["d", "doc_id", "k", "s", "e"])

    return texts.mapInArrow(run, "d long, doc_id long, k long, s long, e long")


def _texts(docs: DataFrame) -> DataFrame:
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return t.withColumn("k", text_key()).select("doc_id", "k", "text")


def _with_places(texts: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Texts with the list of their places (bounded by the text), meeting by document."""
    p = places.groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).agg(F.collect_set(F.struct("s", "e", "d")).alias("at"))
    return texts.join(p, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("k") == F.col("_k")), how).select("doc_id", "k", "text", "at")


def repeated_chunks(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, k, s, e, d): byte ranges of multi-line chunks that also stand earlier, by (doc_id, start).

    Digests find chunks that may repeat; of these the bytes are fetched and compared: a chunk is removed
    only if the bytes of an earlier one are equal. Equal chunks are combined before the shuffle, so a
    chunk that a third of all documents share arrives once per map task.
    """
    texts = _texts(docs)
    found = _chunk_table(texts, least).distinct()
    often = found.groupBy(F.col("d").alias("_e")).agg(F.count("*").alias("n")).filter("n > 1")
    maybe = written(found.join(often, F.col("d") == F.col("_e")).select("doc_id", "k", "s", "e", "d"), "maybe")
    cut = (_with_places(texts, maybe, "inner").select("doc_id", "k", F.encode("text", "UTF-8").alias("b"), F.explode("at").alias("x"))
           .select("doc_id", "k", "x.s", "x.e", "x.d", F.expr("substring(b, cast(x.s + 1 as int), cast(x.e - x.s as int))").alias("bytes")))
    cut = written(cut, "bytes")
    lead = cut.groupBy(F.col("d").alias("_e"), F.col("bytes").alias("_b")).agg(
        F.min(F.struct("doc_id", "s")).alias("least"), F.count("*").alias("n")).filter("n > 1")
    same = (F.col("d") == F.col("_e")) & (F.col("bytes") == F.col("_b"))
    return cut.join(lead, same).filter(F.expr("struct(doc_id, s) > least")).select("doc_id", "k", "s", "e", "d")


def dedup_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row per row of (doc_id, text): doc_id, n_lines, n_removed_lines, n_removed_chunks, kept_sha256
    and kept, the text without the multi-line chunks that repeat an earlier one.

    A null text is empty and has no lines. Null doc_ids come before all others. Rows that repeat a doc_id
    are judged by (doc_id, start) like one document: chunks at one place of them are not earlier than
    each other, so exact repeats of a row fare alike. Other columns are not read; empty tables give no rows.
    """
    rows = _with_places(_texts(docs), repeated_chunks(docs, least), "left")
    rows = rows.select("doc_id", "text", F.array_sort(F.coalesce(F.expr("transform(at, x -> struct(x.s as s, x.e as e))"),
                                                                 F.array().cast("array<struct<s:long,e:long>>"))).alias("at"))

    def run(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            out = []
            for r, places in enumerate(batch.column("at").to_pylist()):
                b = data[off[r]:off[r + 1]].tobytes()
                gone, kept, at = 0, [], 0
                for p in places:
                    kept.append(b[at:p["s"]])
                    gone += b.count(b"\n", p["s"], p["e"]) + (b[p["e"] - 1:p["e"]] != b"\n")
                    at = p["e"]
                kept = b"".join([*kept, b[at:]])
                n = b.count(b"\n") + (len(b) > 0 and b[-1:] != b"\n")
                out.append((n, gone, len(places), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", "kept_sha256", "kept"])

    return rows.mapInArrow(run, "doc_id long, n_lines long, n_removed_lines long, n_removed_chunks long, kept_sha256 string, kept string")
