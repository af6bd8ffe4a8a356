"""Format and policy checks over label text.

Each builder returns ``struct<verdict, detail>`` over columns of one row; the
DataFrame forms scan a text for its unit tokens once and judge on the result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions.measures import (
    first_of_unit, parse_numeric, pick_abv, pick_size_ml, plain_number, unit_tokens,
)
from concordat.functions.text import any_phrase, any_word, has_value, lookup, normalize_text
from concordat.vocab import FAIL, PASS, REVIEW


def _verdict(verdict: str, detail) -> Column:
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(F.lit(verdict).alias("verdict"), text.alias("detail"))


def abv_policy(
    beverage_type: Column, filed_abv: Column, abv: Column, text: Column,
    policy: Mapping[str, str] = vocab.ABV_POLICY,
) -> Column:
    """Presence and form of the strength statement, by type of product."""
    rule = lookup(beverage_type, policy)
    filed = parse_numeric(filed_abv, "alcohol_content")["value"]
    threshold = F.lit(vocab.WINE_ABV_THRESHOLD)
    worded = any_word(F.lower(text), vocab.ABV_WORDS)
    return (
        F.when(abv.isNotNull() & ~worded, _verdict(FAIL, F.concat(plain_number(abv), F.lit("% has no accepted abbreviation"))))
        .when(abv.isNotNull(), _verdict(PASS, F.concat(F.lit("strength stated: "), plain_number(abv), F.lit("%"))))
        .when(rule == "ABV_ALWAYS_REQUIRED", _verdict(FAIL, "a strength statement is required and was not found"))
        .when(
            rule == "ABV_REQUIRED_ABOVE_14_PCT",
            F.when(filed.isNull(), _verdict(REVIEW, "filed strength is unreadable and none is on the label"))
            .when(filed > threshold, _verdict(REVIEW, "filed strength needs a statement; none was found"))
            .otherwise(_verdict(PASS, "no statement is needed at this strength")),
        )
        .when(rule == "ABV_OPTIONAL_UNLESS_TRIGGER", _verdict(REVIEW, "optional unless flavoring adds alcohol"))
        .otherwise(_verdict(REVIEW, "no policy for this type"))
    )


def standard_size(size: Column, sizes: Sequence[int] = vocab.STANDARD_SIZES_ML) -> Column:
    shown = F.concat(plain_number(size), F.lit(" ml"))
    return (
        F.when(size.isNull(), _verdict(REVIEW, "no size could be isolated"))
        .when(size.isin(*sizes), _verdict(PASS, F.concat(shown, F.lit(" is a standard size"))))
        .otherwise(_verdict(FAIL, F.concat(shown, F.lit(f" is not a standard size ({vocab.SIZE_CITATION})"))))
    )


def proof_consistency(proof: Column, abv: Column) -> Column:
    gap = F.abs(proof - abv * F.lit(vocab.PROOF_PER_ABV))
    shown = F.concat(plain_number(proof), F.lit(" proof, "), plain_number(abv), F.lit("%"))
    return (
        F.when(proof.isNull(), _verdict(PASS, "no proof statement"))
        .when(abv.isNull(), _verdict(REVIEW, "proof is stated but the strength is unreadable"))
        .when(gap <= F.lit(vocab.PROOF_TOLERANCE), _verdict(PASS, shown))
        .otherwise(_verdict(FAIL, shown))
    )


def responsibility_phrase(text: Column, phrases: Sequence[str] = vocab.RESPONSIBILITY_PHRASES) -> Column:
    return F.when(any_phrase(text, phrases), _verdict(PASS, "responsibility phrase present")).otherwise(
        _verdict(REVIEW, "no responsibility phrase was found")
    )


def presence_trio(filed: Mapping[str, Column], text_norm: Column, abv: Column) -> Column:
    """Presence of each element; always left to a person."""
    flags = []
    for name in vocab.FIELD_OF_VISION:
        if name == "alcohol_content":
            flag = abv.isNotNull()
        else:
            norm = normalize_text(filed[name])
            flag = has_value(filed[name]) & (norm != "") & F.contains(text_norm, norm)
        flags.append(F.coalesce(flag, F.lit(False)).alias(name))
    detail = F.to_json(
        F.struct(
            F.lit("co_location_deferred").alias("outcome"),
            F.struct(*flags).alias("elements"),
            F.lit("one viewable face cannot be confirmed from a flat photo").alias("reason"),
            F.lit(vocab.FIELD_OF_VISION_CITATION).alias("cfr_citation"),
        )
    )
    return _verdict(REVIEW, detail)


def with_label_numbers(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the strength, proof and size stated in a text: ``abv, proof, size_ml``."""
    df = df.withColumn("_tokens", unit_tokens(F.coalesce(F.col(text), F.lit(""))))
    return (
        df.withColumn("abv", pick_abv(F.col("_tokens"), text))
        .withColumn("proof", first_of_unit(F.col("_tokens"), "proof"))
        .withColumn("size_ml", pick_size_ml(F.col("_tokens")))
        .drop("_tokens")
    )


#: check_key -> builder over a row that carries the label numbers.
FORMAT_CHECKS = {
    "abv_format": lambda: abv_policy(F.col("beverage_type"), F.col("alcohol_content"), F.col("abv"), F.col("text")),
    "standards_of_fill": lambda: standard_size(F.col("size_ml")),
    "proof_abv_consistency": lambda: proof_consistency(F.col("proof"), F.col("abv")),
    "name_address_format": lambda: responsibility_phrase(F.col("text")),
}


def format_checks(subs_text: DataFrame, check_keys: Sequence[str]) -> DataFrame:
    """``(id, check_key, verdict, detail)`` for submissions with their ``text``.

    An unknown key gives REVIEW.
    """
    df = with_label_numbers(subs_text)
    results = []
    for key in check_keys:
        build = FORMAT_CHECKS.get(key)
        judged = build() if build else _verdict(REVIEW, f"no format rule named {key}")
        results.append(F.struct(F.lit(key).alias("check_key"), judged["verdict"].alias("verdict"), judged["detail"].alias("detail")))
    return df.select("id", F.inline(F.array(*results)))


def approved_size(df: DataFrame, sizes: DataFrame, value: str, unit: str) -> DataFrame:
    """Adds ``approved``: exact membership of (value, unit) in a size table."""
    flagged = sizes.select(
        F.col("value").alias(value), F.col("unit").alias(unit), F.lit(True).alias("_ok")
    ).distinct()
    return df.join(flagged, [value, unit], "left").withColumn(
        "approved", F.coalesce("_ok", F.lit(False))
    ).drop("_ok")
