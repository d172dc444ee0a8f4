"""Logit maths: softmax, argmax, cross entropy, focal terms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def softmax(z) -> Column:
    """Stable softmax over an array of logits."""
    x = _c(z)
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0).cast("double"), lambda a, v: a + v)
    return F.transform(e, lambda v: v / s)


def argmax_class(z) -> Column:
    """0-based index of the largest logit, the first one on ties (as numpy)."""
    x = _c(z)
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def log_sum_exp(z) -> Column:
    x = _c(z)
    m = F.array_max(x)
    return m + F.log(F.aggregate(F.transform(x, lambda v: F.exp(v - m)),
                                 F.lit(0.0).cast("double"), lambda a, v: a + v))


def cross_entropy(z, label) -> Column:
    """``-log softmax(z)[label]`` for a 0-based class label."""
    return log_sum_exp(z) - F.element_at(_c(z), _c(label).cast("int") + 1)


def class_weight(label, alpha: float | None) -> Column:
    """alpha for class 0, 1 - alpha for class 1; 1 when alpha is None."""
    if alpha is None:
        return F.lit(1.0)
    return F.when(_c(label) == 0, F.lit(float(alpha))).otherwise(F.lit(1.0 - float(alpha)))


def focal_term(ce, gamma: float, weight=None) -> Column:
    """``w * (1 - exp(-ce))^gamma * ce``."""
    c = _c(ce)
    pt = F.exp(-c)
    out = F.pow(F.lit(1.0) - pt, F.lit(float(gamma))) * c
    return out if weight is None else _c(weight) * out


def sigmoid_bce(z, y) -> Column:
    """Binary cross-entropy with logits, the stable form."""
    zc, yc = _c(z), _c(y)
    return F.greatest(zc, F.lit(0.0)) - zc * yc + F.log1p(F.exp(-F.abs(zc)))
