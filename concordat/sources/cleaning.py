"""Registry-record cleaning as Column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concordat.functions.text import collapse_ws, lookup, nullify_blank

# Patterns and word lists of the registry's own formats.
PERMIT = "^([A-Z]{1,4}-[A-Z]?-?\\d[\\w-]*)\\s"
PERMIT_PREFIX = "^[A-Z0-9]+(?:-[A-Z0-9]+)+\\s+"
NET = (
    "(?i)(\\d+(?:\\.\\d+)?)\\s*"
    "(MILLILITERS?|MILLILITRES?|ML|CENTILITERS?|CL|LITERS?|LITRES?|L|"
    "FL\\.?\\s*OZ\\.?|FLUID\\s*OUNCES?|OUNCES?|OZ|GALLONS?|GAL|PINTS?|QUARTS?)\\b"
)
NET_UNITS = {
    "MILLILITER": "mL", "MILLILITRE": "mL", "ML": "mL", "CENTILITER": "cL", "CL": "cL",
    "LITER": "L", "LITRE": "L", "L": "L", "FLOZ": "fl oz", "FLUIDOUNCE": "fl oz",
    "OUNCE": "fl oz", "OZ": "fl oz", "GALLON": "Gallons", "GAL": "Gallons",
    "PINT": "Pint", "QUART": "Quart",
}
CLASS_FILLER = ("OTHER", "FOREIGN", "TABLE", "FB", "DISTILLED", "PROOF")
ROLES = {"front": "BRAND", "back": "BACK", "neck": "NECK"}
PRODUCT_TYPES = {
    "DISTILLED SPIRITS": "DISTILLED_SPIRITS", "WINE": "WINE", "MALT BEVERAGE": "MALT_BEVERAGE",
}
DOMESTIC_ORIGINS = (
    "NEW YORK", "CALIFORNIA", "FLORIDA", "MARYLAND", "MINNESOTA", "OREGON", "KENTUCKY",
    "TEXAS", "WASHINGTON", "COLORADO", "ILLINOIS", "VIRGINIA", "MASSACHUSETTS",
    "PENNSYLVANIA", "MICHIGAN", "OHIO", "WISCONSIN", "MISSOURI", "GEORGIA",
)
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": "\xa0",
    "&copy;": "©", "&middot;": "·",
}


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def iso_date(col: Column | str) -> Column:
    """``M/D/YYYY`` at the start as an ISO date text; anything else gives the
    registry's stand-in date."""
    c = F.trim(_as_col(col))
    part = lambda i: F.regexp_extract(c, "^(\\d{1,2})/(\\d{1,2})/(\\d{4})", i)
    text = F.concat(part(3), F.lit("-"), F.lpad(part(1), 2, "0"), F.lit("-"), F.lpad(part(2), 2, "0"))
    return F.when(F.coalesce(part(3), F.lit("")) != "", text).otherwise(F.lit("2023-01-01"))


def permit_code(col: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(F.trim(_as_col(col)), PERMIT, 1), F.lit(""))


@F.pandas_udf(T.StringType())
def _unescape_rare(values: pd.Series) -> pd.Series:
    return values.map(html.unescape, na_action="ignore")


def unescape_html(col: Column | str) -> Column:
    """HTML entities as characters.  The usual ones stay in the JVM; only texts
    with others are sent to Arrow."""
    c = _as_col(col)
    usual = "|".join(e[1:-1] for e in (*ENTITIES, "&amp;"))
    rare = c.rlike(f"&(?!(?:{usual});)#?\\w")
    native = c
    for entity, char in ENTITIES.items():
        native = F.replace(native, F.lit(entity), F.lit(char))
    native = F.replace(native, F.lit("&amp;"), F.lit("&"))
    return F.coalesce(F.when(~rare, native), _unescape_rare(F.when(rare, c)))


def clean_applicant(col: Column | str) -> Column:
    raw = F.trim(unescape_html(F.coalesce(_as_col(col), F.lit(""))))
    return collapse_ws(F.regexp_replace(raw, PERMIT_PREFIX, ""))


def title_case(col: Column | str) -> Column:
    """A capital after every non-letter, lower case elsewhere."""
    c = F.lower(_as_col(col))
    runs = F.regexp_extract_all(c, F.lit("([^\\p{L}]*)(\\p{L}*)"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(
                F.regexp_extract(r, "^[^\\p{L}]*", 0),
                F.initcap(F.regexp_extract(r, "\\p{L}*$", 0)),
            ),
        ),
        "",
    )


def clean_origin(col: Column | str) -> Column:
    c = F.coalesce(_as_col(col), F.lit(""))
    return title_case(F.trim(F.regexp_replace(c, "\\([^)]*\\)", "")))


def clean_net(col: Column | str) -> Column:
    """The first quantity with its display unit; empty where there is none."""
    c = F.coalesce(_as_col(col), F.lit(""))
    number, unit = F.regexp_extract(c, NET, 1), F.regexp_extract(c, NET, 2)
    key = F.rtrim(F.regexp_replace(F.upper(unit), "[.\\s]", ""), F.lit("S"))
    return F.when(number == "", F.lit("")).otherwise(
        F.concat(number, F.lit(" "), F.coalesce(lookup(key, NET_UNITS), unit))
    )


def clean_abv(col: Column | str) -> Column:
    c = F.trim(F.rtrim(F.trim(F.coalesce(_as_col(col), F.lit(""))), F.lit("%")))
    return F.when(c.rlike("\\d"), F.concat(c, F.lit("% Alc./Vol."))).otherwise(F.lit(""))


def clean_class(col: Column | str) -> Column:
    """A class code as the label prints it: no grouping words, FLAVORED first."""
    c = F.coalesce(_as_col(col), F.lit(""))
    for pattern in ("\\([^)]*\\)", "/[^/\\s]*", "\\b\\d[\\d-]*\\b"):
        c = F.regexp_replace(c, pattern, " ")
    words = F.filter(
        F.split(F.trim(F.regexp_replace(F.upper(c), "\\s+", " ")), " "),
        lambda w: ~w.isin("", *CLASS_FILLER),
    )
    first = F.array_position(words, "FLAVORED")
    moved = F.when(
        first > 0,
        F.concat(
            F.array(F.lit("FLAVORED")),
            F.slice(words, F.lit(1), (first - 1).cast("int")),
            F.slice(words, (first + 1).cast("int"), F.size(words)),
        ),
    ).otherwise(words)
    return F.array_join(
        F.transform(moved, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))), " "
    )


def image_role(col: Column | str) -> Column:
    return F.coalesce(lookup(F.lower(_as_col(col)), ROLES), F.lit("OTHER"))


def product_source(col: Column | str) -> Column:
    origin = F.upper(F.trim(_as_col(col)))
    return F.when(origin.isin(*DOMESTIC_ORIGINS), "DOMESTIC").otherwise("IMPORTED")


#: A patched filed column is mirrored to its gold column unless that is patched too.
MIRRORED = {
    "alcohol_content": "gt_alcohol_content",
    "net_contents": "gt_net_contents",
    "applicant_name_address": "gt_applicant_name_address",
}


def patch(df: DataFrame, overrides: DataFrame, key: str = "ttb_id") -> DataFrame:
    """Rows with the values of an override table, a short hand-kept list."""
    named = [c for c in overrides.columns if c != key]
    o = overrides.select(key, *[F.col(c).alias(f"_o_{c}") for c in named])
    joined = df.join(o, key, "left")
    source = {c: [f"_o_{c}"] if c in named else [] for c in df.columns}
    for filed, gold in MIRRORED.items():
        if filed in named and gold in source:
            source[gold].append(f"_o_{filed}")
    return joined.select(*[F.coalesce(*source[c], F.col(c)).alias(c) for c in df.columns])


def build_corpus(records: DataFrame, per_type: int = 5, order: str = "ttb_id") -> DataFrame:
    """Cleaned submissions from registry records; the preferred few per type.

    ``records``: the registry's text columns and ``has_back``.  Only the ranking
    key is shuffled before the pick: a rank limit reduces each type on the map
    side, whatever its share of the records.
    """
    kind = lookup(F.upper(F.trim("product_type")), PRODUCT_TYPES)
    known = records.withColumn("beverage_type", kind).filter(F.col("beverage_type").isNotNull())
    rank = W.partitionBy("beverage_type").orderBy(F.col("has_back").desc(), order)
    picked = known.withColumn("_rank", F.row_number().over(rank)).filter(F.col("_rank") <= per_type)
    tidy = lambda c: F.coalesce(nullify_blank(c), F.lit(""))
    return picked.select(
        tidy("ttb_id").alias("ttb_id"),
        "beverage_type",
        product_source("origin_code").alias("source_of_product"),
        F.lit("LABEL_APPROVAL").alias("application_type"),
        tidy("brand_name").alias("brand_name"),
        clean_class("class_type_code").alias("class_type_designation"),
        clean_applicant("applicant_principal").alias("applicant_name_address"),
        permit_code("applicant_principal").alias("plant_registry_no"),
        clean_abv("alcohol_content").alias("alcohol_content"),
        clean_net("net_contents").alias("net_contents"),
        clean_origin(F.upper(F.trim("origin_code"))).alias("country_of_origin"),
        iso_date("approval_date").alias("application_date"),
        "has_back",
    )


def corpus_counts(subs: DataFrame) -> DataFrame:
    """Submissions per type, with a back label, with size and with strength."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    return subs.groupBy("beverage_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("has_back").alias("with_back"),
        filled("net_contents").alias("with_net"),
        filled("alcohol_content").alias("with_abv"),
    )
