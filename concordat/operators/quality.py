"""Constraints as validation jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions.text import has_value
from concordat.operators.joins import left_join_spread


def in_domain(col: str, allowed: Sequence[str]) -> Column:
    """NULL passes, as in a table constraint."""
    return F.col(col).isNull() | F.col(col).isin(*allowed)


def in_range(col: str, low=None, high=None) -> Column:
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col(col) >= low)
    if high is not None:
        ok = ok & (F.col(col) <= high)
    return F.col(col).isNull() | ok


def table_constraints(table: str) -> dict[str, Column]:
    """Named predicates that every row of ``table`` must satisfy."""
    non_negative = lambda *cols: {f"{c}_not_negative": in_range(c, 0) for c in cols}
    return {
        "submissions": lambda: {
            "beverage_type_known": in_domain("beverage_type", vocab.BEVERAGE_TYPES),
            "source_known": in_domain("source_of_product", vocab.PRODUCT_SOURCES),
            "application_type_known": in_domain("application_type", vocab.APPLICATION_TYPES),
            "status_known": in_domain("status", vocab.STATUSES),
            "verdict_known": in_domain("engine_verdict", ("PASS", "REVIEW", "FAIL")),
            "disposition_known": in_domain("disposition", vocab.DISPOSITIONS),
            **non_negative("processing_ms"),
        },
        "label_images": lambda: {
            "role_known": in_domain("image_role", vocab.IMAGE_ROLES),
            "position_range": in_range("position", 1, vocab.MAX_IMAGES),
            **non_negative("preprocess_ms"),
        },
        "audit_events": lambda: {"event_known": in_domain("event_type", vocab.EVENT_TYPES)},
        "ocr_results": lambda: {
            "confidence_range": in_range("confidence", 0, 1),
            "variant_known": in_domain("image_variant", vocab.IMAGE_VARIANTS),
            "status_known": in_domain("status", vocab.ROW_STATUSES),
            **non_negative("latency_ms"),
        },
        "llm_results": lambda: {
            "status_known": in_domain("status", vocab.ROW_STATUSES),
            **non_negative("latency_ms", "prompt_tokens", "completion_tokens"),
        },
        "field_comparisons": lambda: {
            "match_status_known": in_domain("match_status", vocab.MATCH_STATUSES),
            "similarity_range": in_range("similarity", 0, 1),
            "one_source": F.col("source_ocr_result_id").isNull() | F.col("source_llm_result_id").isNull(),
        },
        "checklist_items": lambda: {
            "check_type_known": in_domain("check_type", vocab.CHECK_TYPES),
            "verdict_known": in_domain("verdict", ("PASS", "REVIEW", "FAIL", "NA")),
        },
    }[table]()


def row_predicates() -> dict[str, Column]:
    """The cross-column rules of a submission."""
    decided = F.col("status") == "DECIDED"
    both = F.col("disposition").isNotNull() & F.col("decided_at").isNotNull()
    neither = F.col("disposition").isNull() & F.col("decided_at").isNull()
    return {
        "decided_iff_disposition": (decided & both) | (~decided & neither),
        "due_only_for_correction": F.col("correction_due_at").isNull()
        | F.coalesce(F.col("disposition") == "NEEDS_CORRECTION", F.lit(False)),
    }


def check_domains(df: DataFrame, constraints: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """One row per violation: the keys and the constraint's name.  One pass over
    the table serves all constraints."""
    broken = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in constraints.items()])
    )
    return df.select(*keys, F.explode(broken).alias("constraint"))


check_rows = check_domains


def violation_counts(df: DataFrame, constraints: Mapping[str, Column]) -> DataFrame:
    return check_domains(df, constraints, ()).groupBy("constraint").agg(F.count(F.lit(1)).alias("n"))


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_fk(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose reference is set but not found."""
    refs = parent.select(F.col(parent_key).alias(child_key))
    return child.filter(F.col(child_key).isNotNull()).join(refs, child_key, "left_anti")


def cascade(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """The child rows that survive when unmatched rows are deleted."""
    refs = parent.select(F.col(parent_key).alias(child_key))
    return child.join(refs, child_key, "left_semi")


def set_null(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """All child rows, with references that are not found set to NULL."""
    refs = parent.select(F.col(parent_key).alias(child_key), F.lit(True).alias("_found")).distinct()
    cols = child.columns
    return (
        left_join_spread(child, refs, child_key)
        .withColumn(child_key, F.when(F.col("_found"), F.col(child_key)))
        .select(*cols)
    )


def quarantine(df: DataFrame, domains: Mapping[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """Rows inside every vocabulary, and the rest."""
    ok = F.lit(True)
    for col, allowed in domains.items():
        ok = ok & in_domain(col, allowed)
    return df.filter(ok), df.filter(~ok)


def check_dispositions(df: DataFrame) -> DataFrame:
    """Adds ``problem`` for unknown dispositions and missing notes."""
    d = F.col("disposition")
    known = F.coalesce(d.isin(*vocab.DISPOSITIONS), F.lit(False))
    needs = d.isin(*vocab.DISPOSITIONS_NEEDING_NOTES) & ~has_value("notes")
    return df.withColumn(
        "problem",
        F.when(~known, "unknown disposition").when(needs, "notes are required"),
    )


def extra_fields_wide(eav: DataFrame, keys: Sequence[str], id_col: str = "submission_id") -> DataFrame:
    """Key-value rows as one row per submission with a column per wanted key."""
    return (
        eav.filter(F.col("field_key").isin(*keys))
        .groupBy(id_col)
        .agg(*[F.max(F.when(F.col("field_key") == k, F.col("value_text"))).alias(k) for k in keys])
    )
