"""The comparison report: accuracy beside speed and cost."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions import display


def all_keys(acc: DataFrame, cost: DataFrame, keys: Sequence[str]) -> DataFrame:
    return acc.select(*keys).union(cost.select(*keys)).distinct()


def report_join(acc: DataFrame, cost: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of either side with NULL figures where a side has none."""
    right = cost.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in cost.columns if c not in keys])
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    # A side's marker tells an absent row from one with NULL keys.
    joined = acc.withColumn("_here", F.lit(True)).join(right, same, "full_outer")
    named = [F.when(F.col("_here"), F.col(k)).otherwise(F.col(f"_{k}")).alias(k) for k in keys]
    return joined.select(*named, *[c for c in acc.columns if c not in keys], *[c for c in cost.columns if c not in keys])


def flag_best(df: DataFrame, rate: str, keys: Sequence[str]) -> DataFrame:
    """Adds ``is_best`` on the row with the highest rate; lowest key on a tie.

    The best key is one aggregated row, joined back on the key.
    """
    scored = df.filter(F.col(rate).isNotNull())
    top = scored.groupBy().agg(
        F.min_by(F.struct(*keys), F.struct((-F.col(rate)).alias("_r"), *keys)).alias("_k")
    )
    best = top.filter(F.col("_k").isNotNull()).select(
        *[F.col("_k")[k].alias(k) for k in keys], F.lit(True).alias("is_best")
    )
    return df.join(F.broadcast(best), list(keys), "left").withColumn(
        "is_best", F.coalesce("is_best", F.lit(False))
    )


def engine_report(acc: DataFrame, cost: DataFrame) -> DataFrame:
    """Display rows of the OCR engines."""
    keys = ("engine_name", "image_variant")
    joined = flag_best(report_join(acc, cost, keys), "field_match_rate", keys)
    return joined.select(
        *keys,
        display.label_or_raw("engine_name", vocab.ENGINE_LABELS).alias("name"),
        display.variant_label("image_variant").alias("variant"),
        display.fmt_percent("field_match_rate").alias("accuracy"),
        display.fmt_ms("mean_ms").alias("latency"),
        display.fmt_cost("cost_per_1000").alias("cost"),
        F.coalesce("cost_basis", F.lit("")).alias("cost_basis"),
        "cpu_only",
        "is_best",
    )


def model_report(acc: DataFrame, cost: DataFrame) -> DataFrame:
    joined = flag_best(report_join(acc, cost, ("model_id",)), "field_match_rate", ("model_id",))
    return joined.select(
        "model_id",
        F.when(F.col("model_id") == "", display.DASH).otherwise(F.col("model_id")).alias("name"),
        display.fmt_percent("field_match_rate").alias("accuracy"),
        display.fmt_ms("mean_ms").alias("latency"),
        display.fmt_cost("cost_per_1000").alias("cost"),
        F.coalesce("cost_basis", F.lit("")).alias("cost_basis"),
        "is_best",
    )
