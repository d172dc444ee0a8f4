"""Join helpers: broadcast only a side whose measured size is under a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DEFAULT_BROADCAST_BYTES = 64 * 1024 * 1024


def measured_bytes(df: DataFrame) -> int:
    """Bytes that ``df`` takes as a broadcast hash table: one aggregate pass over its values as text
    (nulls included), plus the row format's fixed part and a table slot for each row."""
    fixed = 64 + 24 * len(df.columns)
    values = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    row = df.select(F.coalesce(F.sum(values + F.lit(fixed)), F.lit(0)).alias("b")).first()
    return int(row["b"])


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None,
                       materialize: bool = True) -> tuple[DataFrame, bool]:
    """``(broadcast(df), True)`` when the measured size is at most ``max_bytes``,
    else ``(df, False)`` and the join shuffles (AQE splits skewed keys).

    With ``materialize`` the side is first written as Parquet to the shared checkpoint
    folder, so measuring it and joining it do not compute it twice.
    """
    from textlab.session import written
    limit = DEFAULT_BROADCAST_BYTES if max_bytes is None else max_bytes
    if materialize:
        df = written(df, "side")
    if measured_bytes(df) <= limit:
        return F.broadcast(df), True
    return df, False
