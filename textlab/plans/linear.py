"""The linear classifier of the experiment stage: sparse vectors in the row, gradients summed task by task.

A row is (key, indices, values): hashed token counts, built inside the row. The weights are a small dense
matrix, one line a seed, bounded by ``n_features`` times the seeds; each epoch sends them to the tasks once
(a broadcast variable), every task adds up the gradient of its rows in one vector for all seeds, and what the tasks hold of a feature is
summed in one aggregation. Rows carry a weight for each seed, so that no row is copied for a seed or an
oversampled class, and no epoch joins, sorts or moves a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from textlab.functions.arrays import head_tail_window

BIAS_FEATURE = -1
#: further lines of a gradient beside the features and the bias: summed loss, summed row weights
_LOSS, _ROWS = -2, -3


#: tokens of a batch that a task counts at once
SLICE_TOKENS = 1 << 18


def _counter(bucket: Callable[[pa.Array], np.ndarray], n_features: int, slice_tokens: int = SLICE_TOKENS) -> Callable[[pa.Array], pa.Array]:
    """The function that tasks count a batch by (made here, it is sent to them whole; they need not have this module)."""
    def counts_of(lists: pa.Array) -> pa.Array:
        """Each list's distinct buckets, sorted, and how often they stand there; nulls count nothing. A batch is worked off in slices of
        rows of about ``slice_tokens`` tokens, by sorting a slice's (row, bucket) numbers and counting equal neighbours."""
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        total = ends[-1] if len(ends) else 0
        sizes, indices, values, at, n = [np.array([0])], np.empty(total, np.int64), np.empty(total), 0, 0
        while at < len(lists):
            done = ends[at - 1] if at else 0
            cut = max(at + 1, int(np.searchsorted(ends, done + slice_tokens, "right")))
            flat = lists.slice(at, cut - at).flatten()  # null lists hold nothing
            row = np.repeat(np.arange(cut - at), np.diff(ends[at:cut], prepend=done))
            if flat.null_count:
                row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
            places, counts = np.unique(row * n_features + bucket(flat), return_counts=True)
            sizes.append(np.bincount(places // n_features, minlength=cut - at))
            indices[n:n + len(places)], values[n:n + len(places)] = places % n_features, counts
            at, n = cut, n + len(places)
        offsets = pa.array(np.cumsum(np.concatenate(sizes)), pa.int32())
        parts = [pa.ListArray.from_arrays(offsets, pa.array(p[:n])) for p in (indices, values)]
        return pa.StructArray.from_arrays(parts, ["indices", "values"])

    return counts_of


def token_counts(tokens: Column, n_features: int, hashing: str = "md5") -> Column:
    """Struct of sorted distinct ``indices`` and their counts ``values`` of an array of tokens, inside the row."""
    if hashing == "md5":  # reproducible in DuckDB
        def bucket(flat):  # each distinct token of a slice is hashed once
            coded = flat.dictionary_encode()
            of = [int.from_bytes(md5(t.encode()).digest()[:4]) % n_features for t in coded.dictionary.to_pylist()]
            return np.array(of, np.int64)[coded.indices.to_numpy()]
    elif hashing == "xxhash64":  # Spark's native hash
        tokens = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(n_features)))

        def bucket(flat):
            return flat.to_numpy()
    else:
        raise ValueError("hashing is 'md5' or 'xxhash64'")

    counts_of = _counter(bucket, n_features)

    @F.arrow_udf("indices array<bigint>, values array<double>")
    def counted(lists: pa.Array) -> pa.Array:
        return counts_of(lists)

    return counted(tokens)


def windowed_tokens(text: str | Column, head: int | None = None, tail: int | None = None) -> Column:
    """Lower-cased tokens between single spaces, whole or as their head and tail window."""
    toks = F.split(F.lower(F.col(text) if isinstance(text, str) else text), " ", -1)
    return toks if head is None else head_tail_window(toks, head, tail or 0)


def text_features(df: DataFrame, key: str = "row_id", text: str = "text", n_features: int = 1 << 18,
                  group: Sequence[str] = (), head: int | None = None, tail: int | None = None,
                  hashing: str = "md5", keep: Sequence[str] = ()) -> DataFrame:
    """M1: hashed token counts as a sparse vector in the row: ``(*group, key, *keep, indices, values)``.

    The bucket is ``md5(token)`` mod ``n_features`` (the same in DuckDB) or Spark's xxhash64. Indices
    are sorted and distinct. Nothing leaves the row, so there is no shuffle. A null text has no features."""
    d = df.select(*group, key, *keep, token_counts(windowed_tokens(text, head, tail), n_features, hashing).alias("_f"))
    return d.select(*group, key, *keep, "_f.indices", "_f.values")


def tall_features(feats: DataFrame, key: str = "row_id", bias: bool = True) -> DataFrame:
    """(key, feature, value): a line for each entry of the vectors, and one of value 1 for the bias."""
    zipped = F.arrays_zip(F.col("indices").alias("feature"), F.col("values").alias("value"))
    if bias:
        one = F.struct(F.lit(BIAS_FEATURE).cast("bigint").alias("feature"), F.lit(1.0).alias("value"))
        zipped = F.concat(F.transform(zipped, lambda x: F.struct(x["feature"].alias("feature"), x["value"].alias("value"))), F.array(one))
    return feats.select(key, F.inline(zipped).alias("feature", "value"))


def document_frequencies(feats: DataFrame) -> DataFrame:
    """(feature, df, idf): in how many rows each feature stands, and ``ln((rows + 1) / (df + 1))``. At most a line a feature."""
    rows = feats.count()
    df = feats.select(F.explode("indices").alias("feature")).groupBy("feature").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log(F.lit(float(rows + 1)) / (F.col("df") + 1)))


def with_idf(feats: DataFrame, frequencies: DataFrame, n_features: int) -> DataFrame:
    """``feats`` with values times their feature's ``idf`` (features that ``frequencies`` lacks weigh 0), inside the row.
    The weights go to the tasks as one vector of ``n_features`` numbers, whatever the number of rows."""
    weights = np.zeros(n_features)
    for part in frequencies.select("feature", "idf").toArrow().to_batches():
        weights[part.column(0).to_numpy()] = part.column(1).to_numpy()
    sent = feats.sparkSession.sparkContext.broadcast(weights)
    schema = feats.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = batch.column("indices"), batch.column("values")
            scaled = v.flatten().to_numpy() * sent.value[at.flatten().to_numpy()]
            values = pa.ListArray.from_arrays(pa.array(np.asarray(v.offsets) - v.offsets[0].as_py(), pa.int32()), pa.array(scaled))
            yield batch.set_column(batch.schema.get_field_index("values"), "values", values)

    return feats.mapInArrow(run, schema)


class Model:
    """Weights of a two-class linear model for several seeds: class 1's, class 0's being their negatives (so they
    start, and the two gradients are each other's negatives). The last column is the bias."""

    def __init__(self, groups: Sequence, n_features: int):
        self.groups, self.n_features = list(groups), n_features
        self.w = np.zeros((len(self.groups), n_features + 1))
        self.squares = np.zeros_like(self.w)

    def copy(self) -> Model:
        new = Model(self.groups, self.n_features)
        new.w, new.squares = self.w.copy(), self.squares.copy()
        return new

    def take(self, other: Model, which: np.ndarray) -> None:
        """The lines of ``which`` as they are in ``other``."""
        self.w[which], self.squares[which] = other.w[which], other.squares[which]

    def step(self, gradient: np.ndarray, lr: float, l2: float, optimizer: str = "gd") -> None:
        full = gradient + l2 * self.w
        if optimizer == "gd":
            self.w -= lr * full
        elif optimizer == "adagrad":  # a step a feature: lr over the root of its summed squares
            self.squares += full * full
            self.w -= lr * full / (np.sqrt(self.squares) + 1e-8)
        else:
            raise ValueError("optimizer is 'gd' or 'adagrad'")

    def table(self, spark: SparkSession, names: Sequence[str]) -> DataFrame:
        """(*names, feature, w0, w1) of the features with a weight and the bias."""
        line, at = np.nonzero(np.concatenate([self.w[:, :-1] != 0, np.ones((len(self.groups), 1), bool)], axis=1))
        feature = np.where(at == self.n_features, BIAS_FEATURE, at)
        cols = [pa.array([self.groups[i][j] for i in line.tolist()]) for j in range(len(names))]
        w = self.w[line, at]
        return spark.createDataFrame(pa.table([*cols, pa.array(feature), pa.array(-w), pa.array(w)], names=[*names, "feature", "w0", "w1"]))


def _scorer():
    """A function of (weights, offsets, indices, values): each row's logit of class 1 for each line of ``weights``, the row
    scaled to unit length and the bias added; with the row of each entry and the scaled values. Made by a call, so that tasks get it by value."""
    def score(weights, off, idx, val):
        n = len(off) - 1
        row = np.repeat(np.arange(n), np.diff(off))
        norm = np.sqrt(np.bincount(row, val * val, n))
        x = val / np.where(norm > 0, norm, 1.0)[row]
        z = np.stack([np.bincount(row, x * w[idx], n) + w[-1] for w in weights]) if len(weights) else np.zeros((0, n))
        return z, row, x
    return score


def gradient(rows: DataFrame, model: Model, gamma: float, alpha: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Mean gradient of class 1's weights and mean loss for each line of the model, over ``rows`` (indices, values, label,
    mult: how often the row counts for each line). One pass; the rows of a task add up to one vector."""
    n_features, lines = model.n_features, len(model.groups)
    sent, score = rows.sparkSession.sparkContext.broadcast(model.w), _scorer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((lines, n_features + 3))
        for batch in batches:
            at = batch.column("indices")
            off = np.asarray(at.offsets) - at.offsets[0].as_py()
            idx, val = at.flatten().to_numpy(), batch.column("values").flatten().to_numpy()
            mult = batch.column("mult").flatten().to_numpy().reshape(-1, lines).T
            y = batch.column("label").to_numpy(zero_copy_only=False)
            z, row, x = score(sent.value, off, idx, val)
            p1 = 1 / (1 + np.exp(np.clip(-2 * z, -700, 700)))  # class 0's logit is the negative
            pt = np.maximum(np.where(y == 1, p1, 1 - p1), 1e-12)
            cw = np.ones(len(y)) if alpha is None else np.where(y == 0, alpha, 1 - alpha)
            loss = cw * (1 - pt) ** gamma * -np.log(pt)
            slope = -cw / pt if gamma == 0 else cw * (gamma * (1 - pt) ** (gamma - 1) * np.log(pt) - (1 - pt) ** gamma / pt)
            g = mult * slope * pt * ((y == 1) - p1)
            for s in range(lines):
                total[s, :n_features] += np.bincount(idx, x * g[s][row], n_features)
            total[:, n_features] += g.sum(1)
            total[:, n_features + 1] += (mult * loss).sum(1)
            total[:, n_features + 2] += mult.sum(1)
        used = np.flatnonzero(np.any(total != 0, axis=0))
        names = np.concatenate([np.arange(n_features), [-1, -2, -3]])[used]
        for i in range(0, len(used), 1 << 16):
            part = total[:, used[i:i + (1 << 16)]]
            yield pa.RecordBatch.from_arrays([pa.array(names[i:i + (1 << 16)]), *(pa.array(part[s]) for s in range(lines))],
                                             names=["feature", *(f"g{s}" for s in range(lines))])

    kind = "feature bigint, " + ", ".join(f"g{s} double" for s in range(lines))
    parts = rows.select("indices", "values", "label", "mult").mapInArrow(run, kind)
    found = parts.groupBy("feature").agg(*[F.sum(f"g{s}").alias(f"g{s}") for s in range(lines)]).toArrow()
    out = np.zeros((lines, n_features + 3))
    where = found.column("feature").to_numpy()
    where = np.where(where == BIAS_FEATURE, n_features, np.where(where == _LOSS, n_features + 1, np.where(where == _ROWS, n_features + 2, where)))
    for s in range(lines):
        out[s, where] = found.column(f"g{s}").to_numpy()
    sent.unpersist()
    n = np.maximum(out[:, n_features + 2:], 1e-300)
    return out[:, :n_features + 1] / n, (out[:, n_features + 1:n_features + 2] / n)[:, 0]


def score_vectors(rows: DataFrame, model: Model, key: str = "row_id", seed: str = "seed", chosen: str | None = None) -> DataFrame:
    """M4 on vectors: (seed, key, copy, label, z0, z1, z) of each row of (key, label, indices, values) for each line of the model; with ``chosen``, an array
    column that lists for each line the copies of the row that count, once for each of those."""
    from pyspark.sql.types import StructField, StructType
    lines = [g[0] for g in model.groups]
    sent, score = rows.sparkSession.sparkContext.broadcast(model.w), _scorer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("indices")
            z, _, _ = score(sent.value, np.asarray(at.offsets) - at.offsets[0].as_py(), at.flatten().to_numpy(), batch.column("values").flatten().to_numpy())
            n = batch.num_rows
            if chosen is None:
                line, row, copy = np.repeat(np.arange(len(lines)), n), np.tile(np.arange(n), len(lines)), np.ones(n * len(lines), np.int32)
            else:
                inner = batch.column("which").flatten()  # a list for each row and line
                cell = np.repeat(np.arange(len(inner)), np.diff(np.asarray(inner.offsets)))
                row, line, copy = cell // len(lines), cell % len(lines), inner.flatten().to_numpy()
            v = z[line, row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(lines)[line]), batch.column(key).take(pa.array(row)), pa.array(copy, pa.int32()), batch.column("label").take(pa.array(row)),
                 pa.array(-v), pa.array(v)], names=[seed, key, "copy_no", "label", "z0", "z1"])

    d = rows.select(key, "label", "indices", "values", *([F.col(chosen).alias("which")] if chosen else []))
    kinds = rows.select(key, "label").schema.fields
    schema = StructType([StructField(seed, _kind(lines)), kinds[0], *StructType.fromDDL("copy_no int").fields, kinds[1],
                         *StructType.fromDDL("z0 double, z1 double").fields])
    return d.mapInArrow(run, schema).withColumn("z", F.array("z0", "z1"))


def _kind(values: Sequence):
    from pyspark.sql.types import LongType, StringType
    return LongType() if all(isinstance(v, (int, np.integer)) for v in values) else StringType()
