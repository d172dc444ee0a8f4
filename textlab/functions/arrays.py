"""Array functions for token windows and model inputs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head_tail_window(tokens, head: int, tail: int) -> Column:
    """``t[:head] + t[-tail:]`` with Python slice meaning: overlaps and repeats when
    the array is shorter than head + tail.  ``tail == 0`` keeps no tail (a Python
    ``t[-0:]`` would keep everything)."""
    t = _c(tokens)
    first = F.slice(t, 1, max(head, 0))
    if tail <= 0:
        return first
    start = F.greatest(F.size(t) - F.lit(tail) + 1, F.lit(1))
    return F.concat(first, F.slice(t, start, F.lit(tail)))


def add_special_tokens(tokens, cls="[CLS]", sep="[SEP]") -> Column:
    t = _c(tokens)
    first = F.array(F.lit(cls) if not isinstance(cls, Column) else cls)
    last = F.array(F.lit(sep) if not isinstance(sep, Column) else sep)
    return F.concat(first, t, last)


def pad_to_length(ids, length, pad: int = 0) -> Column:
    """Right-pad with ``pad`` to ``length``; a longer row raises, as the reference asserts."""
    x = _c(ids)
    n = F.lit(length) if not isinstance(length, Column) else length
    padded = F.concat(x, F.array_repeat(F.lit(pad), F.greatest(n - F.size(x), F.lit(0))))
    return F.when(F.size(x) <= n, padded).otherwise(
        F.raise_error(F.concat(F.lit("sequence longer than "), n.cast("string"))))


def attention_mask(ids) -> Column:
    """1 where the id is above 0 (PAD is 0)."""
    return F.transform(_c(ids), lambda v: (v > 0).cast("int"))


def array_to_text(arr, sep: str = " ") -> Column:
    """Arrays compared with the oracle as joined strings."""
    return F.array_join(F.transform(_c(arr), lambda v: v.cast("string")), sep)
