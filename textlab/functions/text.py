"""String functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_length(c) -> Column:
    """Code points, as Python's ``len`` and DuckDB's ``length`` count them."""
    return F.length(_c(c))


def contains_mention(text, mention) -> Column:
    """Case-sensitive substring test; the empty mention is contained in any text."""
    return F.contains(_c(text), _c(mention))


def replace_char(text, old: str = "$", new: str = " ") -> Column:
    return F.replace(_c(text), F.lit(old), F.lit(new))


def tokenize_text(text, pattern: str = " ", lower: bool = True) -> Column:
    """Whitespace tokens (``pattern`` is a Java regex; the default is one space)."""
    t = F.lower(_c(text)) if lower else _c(text)
    return F.split(t, pattern, -1)


def extract_spans(text, starts, ends) -> Column:
    """Substrings for 0-based, end-exclusive [start, end) offsets, in array order."""
    z = F.arrays_zip(_c(starts).alias("s"), _c(ends).alias("e"))
    return F.transform(z, lambda x: F.substring(_c(text), x["s"] + 1, x["e"] - x["s"]))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(names) -> Column:
    """A regular expression for the longest of an array of names that stands at a place; null without names. Null and empty
    names are left out."""
    quoted = F.transform(F.array_distinct(F.filter(_c(names), lambda m: F.length(m) > 0)), lambda m: F.struct(
        (-F.length(m)).alias("n"), F.concat(F.lit("\\Q"), F.replace(m, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")).alias("q")))
    return _let(F.array_sort(quoted), lambda q: F.when(F.size(q) > 0, F.array_join(F.transform(q, lambda x: x["q"]), "|")))


def mask_mentions(text, mentions) -> Column:
    """Text without any character that an occurrence of any mention covers. Occurrences are those in the text as it is, also where
    they overlap or lie in each other, so the order of the mentions does not matter.

    The text is cut where some mention begins; the longest one that begins there says how far its cover reaches, on into further
    pieces if need be."""
    t = _c(text)

    def cut(pattern):
        pieces = F.split(t, F.concat(F.lit("(?="), pattern, F.lit(")")), -1)
        found = F.regexp_extract_all(t, F.concat(F.lit("(?=("), pattern, F.lit("))")), F.lit(1))
        return _let(F.struct(pieces.alias("p"), found.alias("m")), join)

    def join(v):
        # the first piece begins with a mention, or there is one piece more than mentions
        lead = F.when(F.size(v["p"]) > F.size(v["m"]), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        reach = F.concat(lead, F.transform(v["m"], lambda m: F.length(m)))

        def step(s, x):
            c = F.greatest(s["cover"], x["n"])
            return F.struct(F.greatest(c - F.length(x["p"]), F.lit(0)).alias("cover"),
                            F.concat(s["out"], F.substring(x["p"], c + 1, F.length(x["p"]))).alias("out"))

        both = F.zip_with(v["p"], reach, lambda p, n: F.struct(p.alias("p"), n.alias("n")))
        return F.aggregate(both, F.struct(F.lit(0).alias("cover"), F.lit("").alias("out")), step, lambda s: s["out"])

    return _let(any_of(mentions), lambda p: F.when(p.isNull() | t.isNull(), t).otherwise(cut(p)))
