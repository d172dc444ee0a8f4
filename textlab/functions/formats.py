"""Text formats: elapsed time, fixed-width report fields, rounded ratios."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_elapsed(seconds) -> Column:
    """Seconds -> ``h:mm:ss`` rounded half-to-even to the second, with a
    ``N day(s), `` prefix from 24 hours on (Python timedelta text)."""
    r = F.rint(_c(seconds)).cast("bigint")
    days = F.floor(r / F.lit(86400)).cast("bigint")
    rem = F.pmod(r, F.lit(86400))
    hms = F.format_string("%d:%02d:%02d", (rem / 3600).cast("bigint"),
                          ((rem % 3600) / 60).cast("bigint"), rem % 60)
    plural = F.when(F.abs(days) == 1, F.lit("")).otherwise(F.lit("s"))
    return F.when(days == 0, hms).otherwise(
        F.concat(days.cast("string"), F.lit(" day"), plural, F.lit(", "), hms))


def report_slice(line, start: int, stop: int) -> Column:
    """Python ``float(line[start:stop])`` on a fixed-width report line."""
    return F.trim(F.substring(_c(line), start + 1, stop - start)).try_cast("double")


def ratio_half_even(num, den, digits: int = 2) -> Column:
    """``num/den`` scaled by 10^digits and rounded half-to-even on exact integers
    (identical in every engine); 0 when ``den`` is 0."""
    scale = 10 ** digits
    n = _c(num).cast("bigint") * F.lit(scale)
    d = _c(den).cast("bigint")
    q = F.floor(n / d).cast("bigint")
    r = n - q * d
    up = F.when(r * 2 > d, 1).when((r * 2 == d) & (F.pmod(q, F.lit(2)) == 1), 1).otherwise(0)
    return F.when(d == 0, F.lit(0).cast("bigint")).otherwise(q + up)


def round_ratio_text(num, den, digits: int = 2) -> Column:
    """Rounded ratio as fixed-decimal text, e.g. 0.27."""
    v = ratio_half_even(num, den, digits)
    scale = 10 ** digits
    return F.format_string(f"%d.%0{digits}d", (v / scale).cast("bigint"), v % scale)


def float_text(x) -> Column:
    """A double as Python writes it: the fewest digits (15 to 17) that read back as the same number, positional from 1e-4 up to
    1e16, else with an exponent of two digits or more. Subnormal numbers may get more digits than they need."""
    v = _c(x).cast("double")

    def shortest(v):
        a = F.abs(v)
        # 15, 16 and 17 digits, and the 17 without the last one
        tried = [F.format_string(f"%.{p - 1}e", a) for p in (15, 16, 17)]
        cut = F.regexp_replace(tried[2], "[0-9]e", "e")
        return (F.when(tried[0].cast("double") == a, tried[0]).when(tried[1].cast("double") == a, tried[1])
                .when(cut.cast("double") == a, cut).otherwise(tried[2]))

    def parts(s):
        digits = F.regexp_replace(F.replace(F.substring_index(s, "e", 1), F.lit("."), F.lit("")), "0+$", "")
        return F.struct(F.when(digits == "", F.lit("0")).otherwise(digits).alias("d"), F.substring_index(s, "e", -1).cast("int").alias("e"))

    def text(p):
        d, e = p["d"], p["e"]
        whole = F.rpad(F.substring(d, F.lit(1), e + 1), F.greatest(e + 1, F.lit(1)), F.lit("0"))
        rest = F.substring(d, e + 2, F.length(d))
        big = F.concat(whole, F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d)
        mantissa = F.concat(F.substring(d, 1, 1), F.when(F.length(d) > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), F.length(d)))).otherwise(F.lit("")))
        power = F.concat(F.lit("e"), F.when(e < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        return F.when(e >= 16, F.concat(mantissa, power)).when(e >= 0, big).when(e >= -4, small).otherwise(F.concat(mantissa, power))

    def let(value, body):
        return F.element_at(F.transform(F.array(value), body), 1)

    sign = F.when((v < 0) | (v.cast("string") == "-0.0"), F.lit("-")).otherwise(F.lit(""))
    plain = F.concat(sign, let(let(shortest(v), parts), text))
    return F.when(F.isnan(v), F.lit("nan")).when(v == float("inf"), F.lit("inf")).when(v == float("-inf"), F.lit("-inf")).otherwise(plain)
