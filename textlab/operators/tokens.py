"""Text -> token ids with head-and-tail windows, special ids, padding and masks.

The vocabulary reserves 0 = PAD, 1 = UNK, 2 = CLS, 3 = SEP (so a mask of
``id > 0`` never hides CLS).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from textlab.functions.arrays import add_special_tokens, attention_mask, head_tail_window, pad_to_length
from textlab.functions.text import tokenize_text
from textlab.operators.joins import DEFAULT_BROADCAST_BYTES, measured_bytes
from textlab.session import cut_lineage, written

# fixed values: reserved ids and their tokens
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
#: copies of a vocabulary's lines that rows share out among them
SALTS = 16
#: tokens of a batch that a task turns into ids at once
SLICE_TOKENS = 1 << 18


def tokenize(df: DataFrame, text: str = "text", out: str = "tokens", pattern: str = " ",
             lower: bool = True) -> DataFrame:
    return df.withColumn(out, tokenize_text(F.col(text), pattern, lower))


def build_vocab(df: DataFrame, tokens: str = "tokens", max_size: int = 30000,
                min_count: int = 1) -> DataFrame:
    """(token, id, n): the ``max_size`` most frequent tokens (ties by token), ids
    after the reserved ones.

    Token counts combine map-side, so a token that fills a third of the corpus
    is one row per map task.  The top-k never funnels k rows from every
    partition into one task: a histogram over the count values (one row per
    distinct count) finds the count ``c`` at which the k-th token falls; all
    tokens counted above ``c`` are in (fewer than k), and only the tokens
    counted exactly ``c`` are ranked by token, by the range-partitioned dense
    index.  The final ranking window sees at most ``max_size`` rows.
    """
    from textlab.operators.indexing import assign_row_id
    counts = cut_lineage(df.select(F.explode(tokens).alias("token"))
                         .groupBy("token").agg(F.count("*").cast("bigint").alias("n"))
                         .filter(F.col("n") >= min_count))
    hist = counts.groupBy("n").agg(F.count("*").alias("_m"))
    wdesc = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_above", F.coalesce(F.sum("_m").over(wdesc), F.lit(0)))
    # threshold: the count whose group holds the k-th token (the smallest count
    # if there are fewer tokens); one row, read on the driver
    cut = hist.filter(F.col("_above") < max_size).orderBy("n").limit(1).first()
    if cut is None:
        return counts.select("token", F.lit(None).cast("int").alias("id"), "n").limit(0)
    c_val, above = int(cut["n"]), int(cut["_above"])
    top = counts.filter(F.col("n") > c_val)
    ties = counts.filter(F.col("n") == c_val)
    ties = assign_row_id(ties, ["token"], "_r").filter(F.col("_r") < max_size - above).drop("_r")
    chosen = top.unionByName(ties)
    w = Window.orderBy(F.desc("n"), F.asc("token"))
    return chosen.select("token", (F.row_number().over(w) - 1 + len(SPECIAL_TOKENS)).cast("int").alias("id"), "n")


def _encoder(slice_tokens: int = SLICE_TOKENS) -> Callable[[pa.Array, dict], pa.Array]:
    """The function that tasks turn a batch into ids by (made here, it is sent to them whole; they need not have this module)."""
    def ids_of(lists: pa.Array, ids: dict) -> pa.Array:
        """Lists of tokens as lists of their ``ids``, unknown and null tokens as UNK, a null list as an empty one. A batch is worked
        off in slices of rows of about ``slice_tokens`` tokens; each distinct token of a slice is looked up once."""
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        found, at = np.empty(ends[-1] if len(ends) else 0, np.int32), 0
        while at < len(lists):
            done = ends[at - 1] if at else 0
            cut = max(at + 1, int(np.searchsorted(ends, done + slice_tokens, "right")))
            coded = lists.slice(at, cut - at).flatten().dictionary_encode()  # null lists hold nothing
            known = np.array([*(ids.get(t, UNK_ID) for t in coded.dictionary.to_pylist()), UNK_ID], np.int32)
            found[done:ends[cut - 1]] = known[coded.indices.fill_null(len(known) - 1).to_numpy()]
            at = cut
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(found))

    return ids_of


def encode_tokens(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", out: str = "ids",
                  max_broadcast_bytes: int | None = None) -> DataFrame:
    """Token -> id lookup, unknown and null tokens -> UNK; a null list is empty.

    A vocabulary whose measured size is under the bound is sent to the tasks once (a broadcast variable) and looked up inside each row:
    rows need no key and nothing is shuffled. A larger one meets the distinct tokens of the rows in a join, in ``_encode_by_join``.
    """
    v = cut_lineage(vocab.select("token", F.col("id").cast("int").alias("id")))
    limit = DEFAULT_BROADCAST_BYTES if max_broadcast_bytes is None else max_broadcast_bytes
    if measured_bytes(v) > limit:
        return _encode_by_join(df, v, tokens, out)
    held = v.toArrow()
    sent = df.sparkSession.sparkContext.broadcast(dict(zip(held.column("token").to_pylist(), held.column("id").to_pylist())))
    ids_of = _encoder()

    @F.arrow_udf("array<int>")
    def lookup(lists: pa.Array) -> pa.Array:
        return ids_of(lists, sent.value)

    return df.withColumn(out, lookup(F.col(tokens)))


def _encode_by_join(df: DataFrame, vocab: DataFrame, tokens: str, out: str) -> DataFrame:
    """``encode_tokens`` for a vocabulary too large for a task. The rows are written once, with a number each; a row's distinct tokens
    meet the vocabulary and come back as the row's own small dictionary. A token's line is there ``SALTS`` times, and each row
    looks in one of the copies, so that a token of all rows is no single task's."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "encode")
    listed = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    need = rows.select("_row", F.explode(F.array_distinct(listed)).alias("token")).withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    lines = vocab.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = (need.join(lines, ["token", "_salt"]).groupBy(F.col("_row").alias("_r"))
           .agg(F.collect_list(F.struct("token", "id")).alias("_own")))
    ids_of = _encoder()

    @F.arrow_udf("array<int>")
    def lookup(lists: pa.Array, names: pa.Array, numbers: pa.Array) -> pa.Array:
        # a token has the same id in every row, so the dictionaries of a batch's rows are one
        coded = names.flatten().dictionary_encode()
        ids = np.zeros(len(coded.dictionary), np.int32)
        ids[coded.indices.to_numpy()] = numbers.flatten().to_numpy()
        return ids_of(lists, dict(zip(coded.dictionary.to_pylist(), ids.tolist())))

    j = rows.join(own, F.col("_row") == F.col("_r"), "left")
    return j.withColumn(out, lookup(F.col(tokens), F.col("_own.token"), F.col("_own.id"))).drop("_row", "_r", "_own")


def hash_encode(df: DataFrame, tokens: str = "tokens", out: str = "ids", buckets: int = 1 << 18) -> DataFrame:
    """Vocabulary-free ids: ``4 + pmod(xxhash64(token), buckets)`` (narrow, no join)."""
    return df.withColumn(out, F.transform(tokens, lambda t: (F.pmod(F.xxhash64(t), F.lit(buckets))
                                                               + len(SPECIAL_TOKENS)).cast("int")))


def window_tokens(df: DataFrame, tokens: str = "tokens", head: int = 382, tail: int = 128,
                  out: str | None = None) -> DataFrame:
    return df.withColumn(out or tokens, head_tail_window(F.col(tokens), head, tail))


def encode_text(df: DataFrame, vocab: DataFrame | None, text: str = "text",
                head: int = 382, tail: int = 128, pad_to: int | str = 512,
                buckets: int = 1 << 18) -> DataFrame:
    """text -> tokens -> head/tail window -> CLS ... SEP ids -> padded ids + mask.

    ``pad_to`` is a length or ``"max"`` (the longest encoded row, computed once
    as a scalar subquery).  With ``vocab=None`` ids come from feature hashing.
    """
    t = tokenize(df, text, "_tok")
    t = t.withColumn("_tok", head_tail_window(F.col("_tok"), head, tail))
    if vocab is None:
        e = hash_encode(t, "_tok", "_ids", buckets)
    else:
        e = encode_tokens(t, vocab, "_tok", "_ids")
    e = e.withColumn("_ids", F.concat(F.array(F.lit(CLS_ID)), F.col("_ids"), F.array(F.lit(SEP_ID))))
    if pad_to == "max":  # encoding keeps the number of tokens
        length = t.agg(F.max(F.coalesce(F.size("_tok"), F.lit(0))) + 2).scalar()
    else:
        length = F.lit(int(pad_to))
    e = e.withColumn("input_ids", pad_to_length(F.col("_ids"), length))
    return e.withColumn("attention_mask", attention_mask(F.col("input_ids"))).drop("_tok", "_ids")


__all__ = ["tokenize", "build_vocab", "encode_tokens", "hash_encode", "window_tokens", "encode_text",
           "add_special_tokens", "pad_to_length", "attention_mask", "head_tail_window"]
