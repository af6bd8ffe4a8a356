"""Keyed updates as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest_per_key(updates: DataFrame, key: str, columns: Sequence[str], ts: str) -> DataFrame:
    """Several updates of a key reduced to its newest non-NULL value per column."""
    return updates.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(c) for c in columns],
        F.max(ts).alias(ts),
    )


def upsert(target: DataFrame, updates: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key; columns that no update names, or that it leaves NULL,
    keep their value; ``ts`` moves to the newest update."""
    named = [c for c in updates.columns if c not in (key, ts)]
    new = newest_per_key(updates, key, named, ts).select(
        key, *[F.col(c).alias(f"_new_{c}") for c in (*named, ts)]
    )
    joined = target.join(new, key, "full_outer")
    out = []
    for c in target.columns:
        if c in named or c == ts:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return joined.select(*out)


def update_columns(
    target: DataFrame, updates: DataFrame, key: str, ts: str | None = None, sets: str | None = None
) -> DataFrame:
    """Existing rows with new values; an update of an unknown key does nothing.

    ``sets`` names an array column that lists the columns which an update sets, also to
    NULL; without it an update sets the columns it has a value for.  ``ts`` orders several
    updates of a key: per column the newest that sets it counts, the largest value among
    those without an order.
    """
    named = [c for c in updates.columns if c not in (key, ts, sets)]
    chosen = {c: F.array_contains(sets, c) if sets else F.col(c).isNotNull() for c in named}
    order = (F.col(ts),) if ts else ()
    new = updates.groupBy(key).agg(
        *[F.max(F.when(chosen[c], F.struct(*order, F.col(c).alias("value")))).alias(f"_new_{c}") for c in named]
    )
    return target.join(new, key, "left").select(
        *[
            F.when(F.col(f"_new_{c}").isNotNull(), F.col(f"_new_{c}")["value"]).otherwise(F.col(c)).alias(c) if c in named else F.col(c)
            for c in target.columns
        ]
    )


def compare_and_swap(
    target: DataFrame, requests: DataFrame, key: str, state: str, expected: str, changes: dict[str, Column],
    order: Sequence[str] = ("requested_at", "request_id"),
) -> tuple[DataFrame, DataFrame]:
    """``(new target, outcome per request)``.

    The first request of a key wins if the row is in the expected state; the
    others, and requests for absent or other-state rows, lose.  ``changes`` are
    expressions over the row and the winning request's columns.
    """
    first = requests.groupBy(key).agg(
        F.min_by(F.struct(*[c for c in requests.columns if c != key]), F.struct(*order)).alias("_w")
    )
    winner_cols = [c for c in requests.columns if c != key]
    open_rows = target.filter(F.col(state) == expected).select(key)
    winners = first.join(open_rows, key, "left_semi").select(
        key, *[F.col("_w")[c].alias(c) for c in winner_cols]
    )
    marked = winners.withColumn("_won", F.lit(True))
    joined = target.join(marked, key, "left")
    new = joined.select(
        *[
            F.when(F.col("_won"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
            for c in target.columns
        ]
    )
    won = winners.select(*[F.col(c).alias(f"_{c}") for c in (key, *order)], F.lit(True).alias("won"))
    same = F.col(key) == F.col(f"_{key}")
    for c in order:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    outcome = requests.join(won, same, "left").drop(*[f"_{c}" for c in (key, *order)])
    outcome = outcome.withColumn("won", F.coalesce("won", F.lit(False)))
    return new, outcome


def overwrite_keys(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of keys that are not written again, plus all new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)

