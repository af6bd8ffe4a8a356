"""Verdict roll-up, source agreement and the summaries built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.vocab import FAIL, NA, PASS, REVIEW


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rollup_verdict(col: Column | str, present: Column | None = None) -> Column:
    """Aggregate: the gravest verdict, with everything unknown read as REVIEW.

    ``present`` marks the rows that are checks at all (needed after an outer
    join, where a missing check and a NULL verdict look alike).
    """
    v = _as_col(col)
    here = F.lit(True) if present is None else present
    scored = here & (v.isNull() | (v != NA))
    counted = F.count_if(scored)
    failed = F.count_if(scored & (v == FAIL))
    passed = F.count_if(scored & (v == PASS))
    return (
        F.when(counted == 0, F.lit(REVIEW))
        .when(failed > 0, F.lit(FAIL))
        .when(passed < counted, F.lit(REVIEW))
        .otherwise(F.lit(PASS))
    )


def agree(col: Column | str) -> Column:
    """Aggregate: PASS and FAIL are opinions; they must be unanimous to count."""
    v = _as_col(col)
    yes, no = F.count_if(v == PASS), F.count_if(v == FAIL)
    return (
        F.when((yes > 0) & (no == 0), F.lit(PASS))
        .when((no > 0) & (yes == 0), F.lit(FAIL))
        .otherwise(F.lit(REVIEW))
    )


def agree_columns(verdicts: Sequence[Column]) -> Column:
    """The same rule over verdict columns of one row (NULL has no opinion)."""
    flags = lambda want: [F.coalesce((v == want).cast("int"), F.lit(0)) for v in verdicts]
    yes, no = sum(flags(PASS), F.lit(0)), sum(flags(FAIL), F.lit(0))
    return (
        F.when((yes > 0) & (no == 0), F.lit(PASS))
        .when((no > 0) & (yes == 0), F.lit(FAIL))
        .otherwise(F.lit(REVIEW))
    )


def rollup_verdicts(checks: DataFrame, subs: DataFrame | None = None, key: str = "submission_id") -> DataFrame:
    """One verdict per submission; submissions without checks get REVIEW.

    The checks are aggregated before they meet the submissions, so the join
    carries one short row per key.
    """
    rolled = checks.groupBy(key).agg(rollup_verdict("verdict").alias("engine_verdict"))
    if subs is None:
        return rolled
    ids = subs.select(F.col("id").alias(key))
    return ids.join(rolled, key, "left").select(
        key, F.coalesce("engine_verdict", F.lit(REVIEW)).alias("engine_verdict")
    )


def agree_sources(results: DataFrame, keys: Sequence[str] = ("submission_id", "check_key")) -> DataFrame:
    return results.groupBy(*keys).agg(agree("verdict").alias("verdict"))


def suggested_summary(checks: DataFrame, key: str = "submission_id") -> DataFrame:
    """Roll-up with its counts and sentence; NULL verdicts are dropped first."""
    v = F.col("verdict")
    total = F.count_if(v.isNotNull() & (v != NA))
    out = checks.groupBy(key).agg(
        rollup_verdict("verdict", present=v.isNotNull()).alias("verdict"),
        total.alias("total"),
        F.count_if(v == PASS).alias("passed"),
    )
    out = out.withColumn("needs_review", F.col("total") - F.col("passed"))
    # The three sentences shown.
    sentence = (
        F.when(F.col("total") == 0, F.lit("Nothing was auto-verified — your call. You decide."))
        .when(
            F.col("needs_review") == 0,
            F.format_string("All %d checks passed automatically. You decide.", "total"),
        )
        .otherwise(
            F.format_string(
                "%d of %d passed automatically; %d need your review. You decide.",
                "passed", "total", "needs_review",
            )
        )
    )
    return out.withColumn("summary", sentence)


def verdict_mix(subs: DataFrame, by: str = "beverage_type", verdict: str = "engine_verdict") -> DataFrame:
    """Submission counts per type and verdict with their subtotals."""
    return subs.rollup(by, verdict).agg(F.count(F.lit(1)).alias("n"))
