"""Dense positions and exact cuts without a single-partition window.

A global ``row_number()`` with no ``partitionBy`` moves every row into one
task.  Here the order is range-partitioned instead; each partition counts its
rows, the per-partition counts (one row per partition: a bound set by the
partition count) become offsets, and every row adds its offset to its
position inside its partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F


def assign_row_id(df: DataFrame, order: Sequence, name: str = "row_id",
                  partitions: int | None = None) -> DataFrame:
    """0-based dense position of each row in ``order`` (which must be unique).

    Plan: range exchange on ``order`` -> sort inside partitions -> position
    inside the partition; that sorted, partition-tagged table is written once
    as Parquet in the shared checkpoint folder, so the count
    branch and the row branch read the same partitions, the former only the tags.  (Two independent
    range exchanges may sample different bounds.)  Per-partition counts (one
    row per partition) become prefix-sum offsets, broadcast back.
    """
    from textlab.session import written
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    r = (df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
         .withColumn("_p", F.spark_partition_id())
         .withColumn("_m", F.monotonically_increasing_id()))
    r = written(r, "ordered")
    counts = r.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_m0"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_p", "_m0", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = r.join(F.broadcast(offsets), "_p")
    return out.withColumn(name, (F.col("_off") + F.col("_m") - F.col("_m0")).cast("bigint")) \
        .drop("_p", "_m", "_m0", "_off")


def hash_dense_index(df: DataFrame, hash_col: str, tiebreak: Sequence[str], name: str,
                     bits: int = 16, group: Sequence[str] = ()) -> DataFrame:
    """0-based dense position in (hash_col, *tiebreak) order, per ``group``, for
    unsigned 32-bit hash values.  Buckets are the top ``bits`` bits, a pure
    function of the row, so the count branch and the row branch always agree;
    the bucket histogram (at most 2^bits rows per group) gives offsets; rows
    are ranked inside their bucket after a shuffle on (group, bucket), and are then where their bucket's offset is, too."""
    g = list(group)
    shift = 32 - bits
    d = df.withColumn("_b", F.shiftright(F.col(hash_col), shift))
    hist = d.groupBy(*g, "_b").agg(F.count("*").alias("_c"))
    wcum = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy("_b") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offs = hist.select(*g, "_b", F.coalesce(F.sum("_c").over(wcum), F.lit(0)).alias("_off"))
    rw = Window.partitionBy(*g, "_b").orderBy(F.col(hash_col), *[F.col(c) for c in tiebreak])
    ranked = d.withColumn("_r", F.row_number().over(rw))
    out = ranked.join(offs, [*g, "_b"])
    return out.withColumn(name, (F.col("_off") + F.col("_r") - 1).cast("bigint")).drop("_b", "_r", "_off")


#: rows of a bucket that selection aims at, and hash bits that one histogram tells apart
BUCKET_ROWS, LEVEL_BITS = 1 << 14, 16


def _same_group(g: Sequence[str]) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in g])


def cut_rows(df: DataFrame, rank: Column, tiebreak: Sequence, k: Column, group: Sequence[str] = ()):
    """The ``k``-th smallest row of each group in (rank, *tiebreak) order, by radix selection:
    (group as _g_*, _cut_rank, _cut_tie, _take, _same), ``_same`` rows being equal to the cut and the first ``_take``
    of them inside; without groups a dict. Groups whose ``k`` is 0 have no cut; past a group's end its last row is it.

    ``rank`` holds unsigned 32-bit hash values; ``k`` is an expression over ``n``, the group's row count. The input is
    read once, for its ranks and keys alone; histograms over the leading bits of the rank then
    narrow the cut down, one level of at most 2**LEVEL_BITS buckets a group for as many as it takes until
    buckets hold about BUCKET_ROWS rows, and only the last bucket is put in order."""
    from textlab.session import written
    g = list(group)
    names = [f"_g_{c}" for c in g]
    tie = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"t{i}") for i, c in enumerate(tiebreak)])
    keys = written(df.select(*[F.col(c).alias(f"_g_{c}") for c in g], rank.cast("bigint").alias("_rank"), tie.alias("_tie")), "keys")
    total = keys.count()
    bits = min(32, (total // BUCKET_ROWS).bit_length())
    start = [F.lit(0).cast("bigint").alias("_lo"), F.lit(1 << 32).alias("_hi"), F.least(k.cast("bigint"), F.col("n")).alias("_left")]
    if g:
        sizes = keys.groupBy(*names).agg(F.count("*").alias("n")).select("*", *[F.col(f"_g_{c}").alias(c) for c in g])
        state = sizes.select(*names, *start).filter("_left > 0")
    else:
        state = df.sparkSession.sql(f"SELECT {total}L AS n").select(*start).first().asDict()
    w = Window.partitionBy(*names) if g else Window.partitionBy(F.lit(0))

    def inside():
        if g:
            part = keys.join(state.select(*[F.col(c).alias(f"_s{c}") for c in names], "_lo", "_hi", "_left"),
                             reduce(and_, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in names]))
        else:
            part = keys.select("*", *[F.lit(v).alias(c) for c, v in state.items()])
        return part.filter((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))

    def holding(counts: DataFrame, order: list[str]) -> DataFrame:
        before = F.coalesce(F.sum("_c").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.withColumn("_before", before).filter((F.col("_before") < F.col("_left")) & (F.col("_left") <= F.col("_before") + F.col("_c")))

    for done in range(0, bits, LEVEL_BITS):
        shift = 32 - min(bits, done + LEVEL_BITS)
        hist = inside().groupBy(*names, F.shiftright("_rank", shift).alias("_b"), "_left").agg(F.count("*").alias("_c"))
        lo = F.shiftleft("_b", shift)
        found = holding(hist, ["_b"]).select(*names, lo.alias("_lo"), (lo + F.lit(1 << shift)).alias("_hi"), (F.col("_left") - F.col("_before")).alias("_left"))
        if g:
            state = written(found, "cut")
        else:
            row = found.first()
            state = row.asDict() if row else {"_lo": 0, "_hi": 0, "_left": 0}
    equal = inside().groupBy(*names, "_left", "_rank", "_tie").agg(F.count("*").alias("_c"))
    cut = holding(equal, ["_rank", "_tie"]).select(*names, F.col("_rank").alias("_cut_rank"), F.col("_tie").alias("_cut_tie"),
                                                   (F.col("_left") - F.col("_before")).alias("_take"), F.col("_c").alias("_same"))
    if g:
        return cut
    row = cut.first()
    return row.asDict() if row else {}


def _cut_test(at: Column, cut: dict, kinds: dict[str, str]) -> tuple[Column, Column]:
    """Whether ``at`` (rank, tie) is not after, and whether it equals, the single cut of ``cut_rows`` (whose ties have these types)."""
    if not cut:
        return F.lit(False), F.lit(False)
    values = cut["_cut_tie"].asDict()
    end = F.struct(F.lit(cut["_cut_rank"]).cast("bigint").alias("r"), F.struct(*[F.lit(values[c]).cast(kind).alias(c) for c, kind in kinds.items()]).alias("t"))
    return at <= end, at == end


def take_smallest(df: DataFrame, rank_col: str, tiebreak: Sequence[str], k: Column,
                  flag: str | None = None, group: Sequence[str] = (), few: bool = False) -> DataFrame:
    """Rows whose position in (rank_col, *tiebreak) order is below ``k``, per ``group``.

    ``cut_rows`` reads the input once for its keys; this reads it a second time and compares each row
    with its group's cut, without any shuffle of rows. Only where rows equal in rank and tiebreak lie on both sides of
    a cut are those numbered. ``k`` is a column expression over ``n`` (the group's row count), e.g.
    ``F.bround(F.col("n") * 0.2, 0)``.  With ``flag`` set, all rows are kept and
    ``flag`` says whether the row is among the smallest. ``few`` says that there are no more groups than the caller has listed, so that
    their cuts become constants of the plan.
    """
    from textlab.operators.joins import broadcast_if_small
    g = list(group)
    cut = cut_rows(df, F.col(rank_col), tiebreak, k, g)
    tie = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak)])
    at = F.struct(F.col(rank_col).cast("bigint").alias("r"), tie.alias("t"))
    kinds = dict(df.select(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak)]).dtypes)
    j, helper = df, ["_edge", "_first"]
    if g and not few:
        cut, _ = broadcast_if_small(cut)
        split = not cut.filter("_take < _same").isEmpty()
        j = df.join(cut, _same_group(g), "left")
        end, some = F.struct(F.col("_cut_rank").alias("r"), F.col("_cut_tie").alias("t")), F.col("_cut_rank").isNotNull()
        inside, edge, first = some & (at <= end), some & (at == end) & (F.col("_take") < F.col("_same")), F.col("_take")
        helper += [*[f"_g_{c}" for c in g], "_cut_rank", "_cut_tie", "_take", "_same"]
    else:
        lines = [r.asDict() for r in cut.collect()] if g else [cut]
        split = any(c and c["_take"] < c["_same"] for c in lines)
        inside, edge, first = F.lit(False), F.lit(False), F.lit(0)
        for c in lines:
            here = reduce(and_, [F.col(x).eqNullSafe(F.lit(c[f"_g_{x}"])) for x in g], F.lit(True))
            before, equal = _cut_test(at, c, kinds)
            inside = F.when(here, before).otherwise(inside) if g else before
            if split:
                cuts = F.lit(bool(c) and c["_take"] < c["_same"])
                edge = F.when(here, equal & cuts).otherwise(edge)
                first = F.when(here, F.lit(c.get("_take", 0))).otherwise(first)
    if not split:
        out = j.withColumn("_in", inside)
    else:
        j = j.withColumn("_edge", F.coalesce(edge, F.lit(False))).withColumn("_first", first)
        # equal rows are told apart by where they happen to be; they are numbered across partitions and written, so that each keeps its number
        nth = assign_row_id(j.filter("_edge").withColumn("_place", F.monotonically_increasing_id()), [*g, "_place"], "_nth")
        if g:
            least = nth.groupBy(*[F.col(c).alias(f"_n_{c}") for c in g]).agg(F.min("_nth").alias("_least"))
            nth = nth.join(least, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in g])).withColumn("_nth", F.col("_nth") - F.col("_least"))
            nth = nth.drop("_least", *[f"_n_{c}" for c in g])
        numbered = nth.withColumn("_in", F.col("_nth") < F.col("_first")).drop("_nth", "_place")
        out = j.filter("not _edge").withColumn("_in", inside).unionByName(numbered)
    out = out.drop(*helper)
    return out.filter("_in").drop("_in") if flag is None else out.withColumnRenamed("_in", flag)


def assign_batches(df: DataFrame, size: int, order: Sequence, name: str = "batch_id",
                   position: str = "row_pos") -> DataFrame:
    """Consecutive rows in ``order`` cut into groups of ``size``; the last may be short."""
    idx = assign_row_id(df, order, position)
    return idx.withColumn(name, F.expr(f"`{position}` div {int(size)}"))


def assign_hash_batches(df: DataFrame, size: int, hash_col: str, tiebreak: Sequence[str],
                        group: Sequence[str] = (), name: str = "batch_id",
                        position: str = "row_pos") -> DataFrame:
    """Batches of ``size`` over a seeded random order (a 32-bit hash column), per group."""
    idx = hash_dense_index(df, hash_col, tiebreak, position, group=group)
    return idx.withColumn(name, F.expr(f"`{position}` div {int(size)}"))
