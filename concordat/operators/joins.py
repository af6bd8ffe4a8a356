"""Joins whose keys are often NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_spread(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` joined with ``right`` on a column of both, keeping every row of ``left``.

    Rows without a key match nothing, yet a plain join would send them all to one task.  Here they
    are dealt by their number instead, in the same join; ``left`` is read once.
    """
    deal = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("bigint"))
    dealt = left.withColumn("_deal", deal)
    # Always 0, but no literal: the optimizer would take a literal out of the join's keys.
    same = F.pmod(F.xxhash64(key), F.lit(1).cast("bigint"))
    return dealt.join(right.withColumn("_deal", same), [key, "_deal"], "left").drop("_deal")
