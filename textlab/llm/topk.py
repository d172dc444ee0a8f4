"""Exact top-k by integer inner product over an impact-ordered index, processed score at a time.

The index cuts the vectors into blocks. In a block every dimension has postings segmented by impact:
its components quantised in steps of STEP. A query processes the segments of all dimensions by
descending |query component * impact|, in a few waves, and adds each segment's middle score to its
rows. What a row's sum can still be wrong by is bounded by the quantisation and by the largest and
smallest contributions of the segments not yet processed; a row is out once its upper bound is below
the k-th best lower bound. Only on that proof does processing stop early; every row that may still be
a member is rescored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from textlab.llm.common import mix64, written

STEP = 8
#: vectors of an index block, queries of a query block, waves of segments, and rows few enough to rescore
BLOCK, QUERIES, WAVES, FEW = 4096, 512, 8, 64


class ImpactIndex:
    """Postings of one block of integer vectors, segmented by dimension and level."""

    def __init__(self, vectors: np.ndarray, step: int = STEP):
        n, dims = vectors.shape
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable").T.reshape(-1)
        dim = np.repeat(np.arange(dims), n)
        level = vectors[order, dim] // step
        new = np.flatnonzero(np.concatenate([[True], (level[1:] != level[:-1]) | (dim[1:] != dim[:-1])]))
        self.rows, self.dim, self.begin = order, dim[new], new
        self.low, self.high = level[new] * step, level[new] * step + step - 1
        self.impact = np.maximum(np.abs(self.low), np.abs(self.high))
        self.size = np.diff(np.append(new, len(order)))

    def candidates(self, q: np.ndarray, k: int, out: np.ndarray, waves: int = WAVES) -> np.ndarray:
        """Rows that may be among the k best of those not in the mask ``out``, all ties included."""
        n, dims = self.vectors.shape
        weight = q[self.dim]
        one, two = weight * self.low, weight * self.high
        least, most = np.minimum(one, two), np.maximum(one, two)
        middle = (least + most) / 2
        order = np.argsort(-(np.abs(weight) * self.impact), kind="stable")
        done = np.cumsum(self.size[order])
        cuts = np.searchsorted(done, done[-1] * np.arange(1, waves + 1) // waves) + 1
        error = float(np.abs(q).sum() * (self.high[0] - self.low[0]) / 2)
        score = np.zeros(n)
        score[out] = -np.inf
        alive = np.arange(n)
        at = 0
        for cut in cuts:
            now, at = order[at:cut], cut
            if len(now):
                size = self.size[now]
                postings = np.repeat(self.begin[now] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                score += np.bincount(self.rows[postings], np.repeat(middle[now], size), n)
            rest = order[cut:]
            gain, loss = np.zeros(dims), np.zeros(dims)
            np.maximum.at(gain, self.dim[rest], most[rest])
            np.minimum.at(loss, self.dim[rest], least[rest])
            slack = 2 * error + gain.sum() - loss.sum()
            if n - out.sum() > k:
                kth = np.partition(score, n - k)[n - k]
                alive = np.flatnonzero(score >= kth - slack)
            else:
                alive = np.flatnonzero(~out)
            if len(alive) <= max(FEW, 4 * k):
                break
        return alive[~out[alive]]


def _digest(vectors: np.ndarray) -> np.ndarray:
    """Tells queries of one id apart by their vectors."""
    place = mix64(np.arange(1, vectors.shape[1] + 1, dtype=np.uint64))
    return mix64((mix64(vectors.view(np.uint64)) * (place | np.uint64(1))).sum(axis=1, dtype=np.uint64)).view(np.int64)


def integer_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v, dims): components as floor(256 * x); rows with nulls, non-finite or no components go."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ok = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)
    return (df.filter(ok).filter(~F.coalesce(bad, F.lit(True)))
            .select(F.col(key).cast("long").alias("id"),
                    F.transform(vector, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v"), F.size(vector).alias("dims")))


def _packed(rows: DataFrame, block: str) -> DataFrame:
    """One row (dims, block, ids, v) for each block of bounded size, ids and vectors as bytes."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dims": [pdf["dims"].iloc[0]], block: [pdf[block].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()],
                             "v": [np.concatenate(pdf["v"].to_numpy()).astype(np.int64).tobytes()]})
    return rows.groupBy("dims", block).applyInPandas(pack, f"dims int, {block} long, ids binary, v binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best other vectors by inner product, ties to the
    smaller vec_id. ``vectors`` and ``queries``: (id, v, dims) as from ``integer_vectors``.

    Blocks of vectors meet blocks of queries of as many dimensions; each meeting is one task that
    returns at most k rows a query. Rows with a query's own id are no candidates of it. Repeated
    (id, vector) rows are one query, and as many candidates as there are. Empty tables give no rows.
    """
    n, m = vectors.count(), queries.distinct().count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    key = F.xxhash64("id", "v")
    index = _packed(vectors.withColumn("block", F.pmod(key, F.lit(blocks))), "block")
    asked = _packed(queries.distinct().withColumn("group", F.pmod(F.xxhash64("v", "id"), F.lit(groups))), "group")
    meet = ["dims", "block", "group"]
    parts = min(blocks * groups, 20_000)
    index = index.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).repartition(parts, *meet)
    asked = (asked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).repartition(parts, *meet)
             .select(*meet, F.col("ids").alias("q_ids"), F.col("v").alias("q")))

    def run(batches):
        for pdf in batches:
            for dims, ids, v, q_ids, q in zip(pdf["dims"], pdf["ids"], pdf["v"], pdf["q_ids"], pdf["q"]):
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                block, asked = ImpactIndex(np.frombuffer(v, np.int64).reshape(-1, dims)), np.frombuffer(q, np.int64).reshape(-1, dims)
                out = []
                for qid, key, vec in zip(q_ids, _digest(asked), asked):
                    rows = block.candidates(vec, k, ids == qid)
                    score = block.vectors[rows] @ vec
                    best = np.lexsort((ids[rows], -score))[:k]
                    out.append((np.full(len(best), qid), np.full(len(best), key), ids[rows][best], score[best]))
                if out:
                    yield pd.DataFrame(dict(zip(("query_id", "q", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    found = index.join(asked, meet).select("dims", "ids", "v", "q_ids", "q").mapInPandas(run, "query_id long, q long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The k best of all (vec_id, embedding) for each row whose vec_id is divisible by ``every``.
    Rows with a null vec_id or a vector that is null, empty or not finite take no part; vectors of
    different length do not meet. Other columns are not read."""
    v = written(integer_vectors(embeddings, "vec_id", "embedding"), "vectors")
    return top_k(v, v.filter(F.col("id") % every == 0), k)
