"""Labels and number formats of the report and review tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions.text import lookup

DASH = "—"


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def source_label(col: Column | str) -> Column:
    c = _as_col(col)
    return (
        F.when(c.startswith("llm:"), F.lit("AI"))
        .when(c.startswith("ocr:"), F.lit("OCR"))
        .otherwise(F.lit("On label"))
    )


def resolve_type(col: Column | str) -> Column:
    """A filter label in any case as a type; NULL means no filter."""
    return lookup(F.lower(F.trim(_as_col(col))), vocab.FILTER_LABELS)


def label_or_raw(col: Column | str, table: Mapping[str, str]) -> Column:
    c = _as_col(col)
    return F.coalesce(lookup(c, table), c)


def variant_label(col: Column | str) -> Column:
    c = _as_col(col)
    return F.coalesce(lookup(c, vocab.VARIANT_LABELS), F.lower(c))


def indicator(col: Column | str) -> Column:
    return F.coalesce(lookup(_as_col(col), vocab.READING_INDICATORS), F.lit(""))


def _half_even(col: Column, places: int) -> Column:
    return F.bround(col.cast("decimal(30,10)"), places)


def fmt_percent(col: Column | str) -> Column:
    c = _as_col(col)
    text = _half_even(c * 100, 1).cast("decimal(20,1)").cast("string")
    return F.coalesce(text, F.lit(DASH))


def fmt_ms(col: Column | str) -> Column:
    whole = _half_even(_as_col(col), 0).cast("decimal(20,0)")
    return F.coalesce(F.format_number(whole, 0), F.lit(DASH))


def fmt_cost(col: Column | str) -> Column:
    text = F.concat(F.lit("$"), _half_even(_as_col(col), 2).cast("decimal(20,2)").cast("string"))
    return F.coalesce(text, F.lit("not priced"))


def fmt_seconds(col: Column | str) -> Column:
    text = _half_even(_as_col(col) / 1000, 1).cast("decimal(20,1)").cast("string")
    return F.coalesce(text, F.lit(DASH))
