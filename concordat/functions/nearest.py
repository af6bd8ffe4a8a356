"""The measure of a text that is nearest to a filed one, read and compared in Arrow batches.

Reads what ``measures.measures_in`` reads.  Spark interprets lambdas over arrays row by row, at several
times the cost of this loop; Python's decimals are exact at any length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import MAX_EMAX, MAX_PREC, MIN_EMIN, Context, Decimal
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F

from concordat.functions.measures import THOUSANDS, TOKEN, UNIT_FORMS
from concordat.functions.text import folded_lines

#: ``filed`` and ``near`` are plain forms, ``near`` is NULL where no measure has the filed one's ``unit``.
FOUND = "struct<filed:string,unit:string,near:string,fits:boolean>"

_TOKEN, _THOUSANDS = re.compile(TOKEN, re.ASCII), re.compile(THOUSANDS, re.ASCII)
_EXACT = Context(prec=MAX_PREC, Emax=MAX_EMAX, Emin=MIN_EMIN)
# Blanks within a line; in ASCII text they are all that folding changes for a token, besides case.
_BLANKS = str.maketrans("\t\x1f", "  ")
_ALL_BLANKS = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f", " "))


def _tokens(text: str, one_line: bool) -> Iterator[re.Match]:
    if text.isascii():
        folded = text.lower().translate(_ALL_BLANKS) if one_line else text.lower()
        if "\t" in folded or "\x1f" in folded:
            folded = folded.translate(_BLANKS)
    else:
        folded = folded_lines(text).replace("\n", " ") if one_line else folded_lines(text)
    return _TOKEN.finditer(_THOUSANDS.sub("", folded) if "," in folded else folded)


def plain(number: Decimal) -> str:
    """A number without exponent, plus sign, leading zeros or trailing zeros after the point."""
    text = f"{number:f}" if number else "0"
    return text.rstrip("0").rstrip(".") if "." in text else text


def nearest(filed: str | None, observed: str | None, limit: Decimal) -> tuple[str | None, str | None, str | None, bool | None]:
    """The first measure of ``filed``, its unit, the nearest measure of that unit (the first of equals)
    and whether it is within the limit."""
    first = next(_tokens(filed, True), None) if filed else None
    if first is None:
        return None, None, None, None
    number, unit = Decimal(first[1]), UNIT_FORMS[first[2]]
    best = least = None
    for token in _tokens(observed or "", False):
        if UNIT_FORMS[token[2]] == unit:
            value = Decimal(token[1])
            gap = _EXACT.subtract(value, number).copy_abs()
            if best is None or gap < least:
                best, least = value, gap
    if best is None:
        return plain(number), unit, None, None
    return plain(number), unit, plain(best), least <= limit


@lru_cache(None)
def nearest_measure(limit: Decimal):
    """The UDF of :func:`nearest` for one limit."""

    @F.arrow_udf(FOUND)
    def found(filed: pa.Array, observed: pa.Array) -> pa.Array:
        rows = [nearest(a, b, limit) for a, b in zip(filed.to_pylist(), observed.to_pylist())]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.string(), pa.string(), pa.string(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["filed", "unit", "near", "fits"])

    return found
