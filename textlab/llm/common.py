"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textlab.session import scratch_dir

#: words of a text for sizes and shingles: runs of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read again: lineage ends
    there, and losing an executor costs only the tasks that were running on it."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str | Column = "text") -> Column:
    """Tells rows with one doc_id and different texts apart."""
    return F.xxhash64(F.col(text) if isinstance(text, str) else text)


def word_count(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


# ---- texts as numpy arrays, inside Arrow tasks -------------------------------------------

#: bytes of text that a task turns into arrays at once
CHUNK = 1 << 19


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; nulls are empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    buf = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(buf[1], kind)[arr.offset:arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buf[2], np.uint8) if buf[2] is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Rolling:
    """Hashes of any byte range of a chunk from one prefix sum: sum of value[byte] * base**i
    modulo 2**64, divided by base**start (the base is odd, so it has an inverse)."""

    def __init__(self, seed: int, fold_case: bool = False):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        if fold_case:
            self.value[65:91] = self.value[97:123]
        self.base = (int(rng.integers(0, 2**60)) << 3) | 3
        self.inverse = pow(self.base, -1, 2**64)
        self.pow = self.inv = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pow) < n:
            size = 1 << max(16, math.ceil(math.log2(n)))
            for name, b in (("pow", self.base), ("inv", self.inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.pow[:len(data)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._powers(len(prefix))  # a task's own copy of this object may not have made them yet
        return (prefix[end] - prefix[start]) * self.inv[start]


def word_ranges(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (one more at the end).
    ``is_word``: for each byte value whether it is part of words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = is_word[data]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins = inside[1:-1] & (~inside[:-2] | first[:-1])
    ends = inside[1:-1] & (~inside[2:] | first[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


SPACE_WORD = np.ones(256, bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORD = np.zeros(256, bool)
ALNUM_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
