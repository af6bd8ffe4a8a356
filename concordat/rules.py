"""The live rules as data, and their joins to submissions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    beverage_type: str
    check_key: str
    label: str
    check_type: str
    cfr_citation: str
    source_date: str
    strategy: str
    field_key: str | None


# Key, label, field and default strategy of the seven elements, and
# the citation of each element per type.
_ELEMENTS = (
    ("brand_name", "Brand name", "brand_name", "field_match"),
    ("class_type_designation", "Class/type designation", "class_type_designation", "field_match"),
    ("alcohol_content", "Alcohol content", "alcohol_content", "field_match"),
    ("net_contents", "Net contents", "net_contents", "field_match"),
    ("name_address", "Name and address", "applicant_name_address", "field_match"),
    ("government_warning", "Government Warning", None, "government_warning"),
    ("country_of_origin", "Country of origin", "country_of_origin", "country_of_origin"),
)
_CITATIONS = {
    "DISTILLED_SPIRITS": (
        "2022-01-08",
        ("27 CFR 5.64", "27 CFR 5.141", "27 CFR 5.65", "27 CFR 5.70", "27 CFR 5.66", "27 CFR 16.21", "27 CFR 5.69"),
    ),
    "WINE": (
        "2026-06-11",
        ("27 CFR 4.33", "27 CFR 4.21", "27 CFR 4.36", "27 CFR 4.37", "27 CFR 4.35", "27 CFR 16.21", "19 CFR 134.11"),
    ),
    "MALT_BEVERAGE": (
        "2026-06-11",
        ("27 CFR 7.64", "27 CFR 7.141", "27 CFR 7.65", "27 CFR 7.70", "27 CFR 7.66", "27 CFR 16.21", "27 CFR 7.69"),
    ),
}


def _build() -> tuple[Rule, ...]:
    rules = []
    for kind, (source_date, citations) in _CITATIONS.items():
        for (key, label, field_key, strategy), citation in zip(_ELEMENTS, citations):
            check_type = "DETERMINISTIC" if key == "government_warning" else "FIELD_MATCH"
            if kind == "DISTILLED_SPIRITS" and key == "class_type_designation":
                strategy, check_type = "class_type", "HYBRID"
            rules.append(Rule(kind, key, label, check_type, citation, source_date, strategy, field_key))
    return tuple(rules)


RULES = _build()

RULE_SCHEMA = (
    "beverage_type string, check_key string, label string, check_type string, "
    "cfr_citation string, source_date string, strategy string, field_key string"
)


def rules_frame(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    df = spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)
    return df.withColumn("source_date", F.to_date("source_date"))


def attach_rules(subs: DataFrame, rules: DataFrame) -> DataFrame:
    """Submissions with their rules; a submission of an unknown type stays, with
    no rule.  The rule table has a fixed few rows and is sent to all executors."""
    return subs.join(F.broadcast(rules), "beverage_type", "left")
