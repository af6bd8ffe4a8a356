"""Work-queue reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

READY = "READY_FOR_REVIEW"


def waiting(subs: DataFrame, kind: str | None = None) -> DataFrame:
    df = subs.filter(F.col("status") == READY)
    if kind is not None:
        df = df.filter(F.col("beverage_type") == kind)
    return df.agg(F.count(F.lit(1)).alias("waiting"))


def waiting_by_type(subs: DataFrame) -> DataFrame:
    """Waiting count of every type with the total (type NULL, is_total 1)."""
    return (
        subs.filter(F.col("status") == READY)
        .cube("beverage_type")
        .agg(F.count(F.lit(1)).alias("waiting"), F.grouping("beverage_type").cast("int").alias("is_total"))
    )


def oldest_ready(subs: DataFrame, kind: str | None = None) -> DataFrame:
    df = subs.filter(F.col("status") == READY)
    if kind is not None:
        df = df.filter(F.col("beverage_type") == kind)
    return df.orderBy("submitted_at", "id").limit(1)


def oldest_ready_per_type(subs: DataFrame) -> DataFrame:
    """The next submission of every type at once.

    A minimum with partial aggregation: a type that holds most of the queue is
    reduced before the shuffle.
    """
    return (
        subs.filter(F.col("status") == READY)
        .groupBy("beverage_type")
        .agg(F.min(F.struct("submitted_at", "id")).alias("n"))
        .select("beverage_type", "n.id", "n.submitted_at")
    )


def intake_batch(subs: DataFrame, n: int) -> DataFrame:
    """The n oldest unprocessed submissions: a top-n, not a full sort."""
    return subs.filter(F.col("status") == "RECEIVED").orderBy("submitted_at", "id").limit(n)


def ordered(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*keys)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the predicate reaches the scan."""
    return df.filter(F.col(key) == F.lit(value))
