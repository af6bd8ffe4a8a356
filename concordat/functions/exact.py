"""Decimal numbers of any length as digit strings, compared and subtracted exactly in the JVM.

The *plain* form of a number has a sign only if negative, no leading zeros, no exponent and no
trailing zeros after the point: ``-0.5``, ``750``, ``0``.  Spark's decimals end at 38 digits; these
do not.  Sums run over chunks of ``CHUNK`` digits, from the right, as whole numbers with a carry.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat.functions.text import let

#: Digits of a chunk; two of them and a carry are far inside a long.
CHUNK = 15
_LIMIT = 10**CHUNK
#: Digits that tell how many digits come before the point, in a magnitude's key.
_LENGTH_DIGITS = 9


def _trimmed(whole: Column, fraction: Column, negative: Column) -> Column:
    """The plain form of digits before and after the point."""

    def joined(whole, fraction, negative):
        body = F.when(fraction == "", whole).otherwise(F.concat(whole, F.lit("."), fraction))
        return F.when(negative & (body != "0"), F.concat(F.lit("-"), body)).otherwise(body)

    # One zero stays; trims of fixed characters are cheaper than patterns.
    short = let(lambda short: F.when(short == "", "0").otherwise(short), short=F.ltrim(whole, F.lit("0")))
    return let(joined, whole=short, fraction=F.rtrim(fraction, F.lit("0")), negative=negative)


def plain(number: Column) -> Column:
    """The plain form of number text: sign, digits, a point, an exponent of at most three digits.

    NULL for NULL and for other text.
    """
    shape = "^([-+]?)(\\d*)(?:\\.(\\d*))?(?:[eE]([-+]?\\d{1,3}))?$"

    def moved(sign, whole, fraction, exponent):
        # The point stands after this many of all digits; it may lie outside them.
        digits, point = F.concat(whole, fraction), F.length(whole) + exponent
        size = F.length(digits)
        before = F.when(point <= 0, F.lit("")).otherwise(F.rpad(F.left(digits, F.least(point, size)), F.greatest(point, F.lit(0)), F.lit("0")))
        after = F.when(point < 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substring(digits, point + 1, F.greatest(size - point, F.lit(0))))
        return _trimmed(before, after, sign == "-")

    def parsed(number):
        part = lambda i: F.regexp_extract(number, shape, i)
        exponent = F.coalesce(F.when(part(4) != "", part(4)).cast("int"), F.lit(0))
        simple = _trimmed(part(2), part(3), part(1) == "-")
        full = F.when(number.rlike("[eE]"), let(moved, sign=part(1), whole=part(2), fraction=part(3), exponent=exponent)).otherwise(simple)
        return F.when(number.rlike(shape) & number.rlike("^[-+]?\\.?\\d"), full)

    return let(parsed, number=number)


def magnitude_key(number: Column) -> Column:
    """Text that orders plain numbers by their size, signs left out: how many digits come before the
    point, then the digits."""

    def keyed(digits):
        whole = F.substring_index(digits, ".", 1)
        return F.concat(F.lpad(F.length(whole).cast("string"), _LENGTH_DIGITS, "0"), digits)

    return let(keyed, digits=F.ltrim(number, F.lit("-")))


def literal_key(number: Decimal) -> Column:
    """``magnitude_key`` of a number that is known when the query is written."""
    digits = f"{abs(number):f}"
    digits = digits.rstrip("0").rstrip(".") if "." in digits else digits
    return F.lit(str(len(digits.split(".")[0])).rjust(_LENGTH_DIGITS, "0") + digits)


def gap(a: Column, b: Column) -> Column:
    """The plain form of the absolute difference of two plain numbers."""

    def aligned(a, b):
        whole = lambda x: F.substring_index(F.ltrim(x, F.lit("-")), ".", 1)
        fraction = lambda x: F.when(F.contains(x, F.lit(".")), F.substring_index(x, ".", -1)).otherwise("")

        def padded(wa, wb, fa, fb):
            after = F.greatest(F.length(fa), F.length(fb))
            digits = F.greatest(F.length(wa), F.length(wb)) + 1 + after
            chunks = F.ceil(digits / CHUNK).cast("int")
            # Both get the same number of digits before and after the point, in whole chunks.
            wide = lambda w, f: F.lpad(F.rpad(F.concat(w, f), F.length(w) + after, F.lit("0")), chunks * CHUNK, F.lit("0"))
            return F.struct(wide(wa, fa).alias("x"), wide(wb, fb).alias("y"), after.alias("after"), chunks.alias("chunks"))

        packed = let(padded, wa=whole(a), wb=whole(b), fa=fraction(a), fb=fraction(b))
        return let(combined, p=packed, apart=F.startswith(a, F.lit("-")) != F.startswith(b, F.lit("-")))

    def combined(p, apart):
        # Numbers of different sign are as far apart as their sizes together.
        large, small = F.greatest(p["x"], p["y"]), F.least(p["x"], p["y"])

        def step(acc, i):
            piece = lambda s: F.substring(s, (p["chunks"] - i) * CHUNK + 1, F.lit(CHUNK)).cast("bigint")
            raw = F.when(apart, piece(large) + piece(small) + acc["carry"]).otherwise(piece(large) - piece(small) - acc["carry"])

            def put(raw):
                over = (raw >= _LIMIT) | (raw < 0)
                digit = F.when(raw >= _LIMIT, raw - _LIMIT).when(raw < 0, raw + _LIMIT).otherwise(raw)
                return F.struct(F.when(over, 1).otherwise(0).cast("bigint").alias("carry"), F.concat(F.lpad(digit.cast("string"), CHUNK, "0"), acc["out"]).alias("out"))

            return let(put, raw=raw)

        start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.lit("").alias("out"))
        return let(
            lambda out, after: _trimmed(F.left(out, F.length(out) - after), F.right(out, after), F.lit(False)),
            out=F.aggregate(F.sequence(F.lit(1), p["chunks"]), start, step)["out"], after=p["after"],
        )

    return let(aligned, a=a, b=b)
