"""Latency, token and cost figures."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat.operators.readings import cost_rows

LOCAL_BASIS = "local — $0 marginal API cost"


def exact_ranks(df: DataFrame, by: Sequence[str], value: str, shares: dict[str, float], median: str | None = None) -> DataFrame:
    """Exact nearest-rank percentiles per group, without gathering a group.

    ``shares`` maps an output name to a share: the result is the value at rank
    ``ceil(share * n)``.  ``median`` names the interpolated median, if wanted.

    Values are counted per group first, which spreads a group of any size over
    all tasks.  Cumulative counts over a few thousand logarithmic bins find the
    bin of each rank; only the values of those bins are then ranked.
    """
    v = F.col(value)
    hist = (
        df.filter(v.isNotNull())
        .groupBy(*by, v.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", (F.signum("_v") * F.floor(F.log2(F.abs("_v") + 1) * 256)).cast("int"))
    )
    bins = hist.groupBy(*by, "_bin").agg(F.sum("_n").alias("_n"))
    run = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = bins.withColumn("_upto", F.sum("_n").over(run)).withColumn(
        "_total", F.sum("_n").over(W.partitionBy(*by))
    )
    total = F.col("_total")
    wanted = [
        F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.lit(_exact(share)) * total)).cast("bigint").alias("rank"))
        for name, share in shares.items()
    ]
    if median:
        wanted += [
            F.struct(F.lit("_lo").alias("name"), F.floor((total + 1) / 2).cast("bigint").alias("rank")),
            F.struct(F.lit("_hi").alias("name"), F.ceil((total + 1) / 2).cast("bigint").alias("rank")),
        ]
    hit = bins.select(*by, "_bin", (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", F.inline(F.array(*wanted)))
    hit = hit.filter((F.col("rank") > F.col("_before")) & (F.col("rank") <= F.col("_upto")))
    inside = hist.join(hit.drop("_upto"), [*by, "_bin"])
    step = W.partitionBy(*by, "name").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = inside.withColumn("_at", F.col("_before") + F.sum("_n").over(step)).filter(
        F.col("_at") >= F.col("rank")
    )
    # The first value whose running count reaches the rank.
    out = found.groupBy(*by).agg(
        *[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in shares],
        *(
            [((F.min(F.when(F.col("name") == "_lo", F.col("_v"))) + F.min(F.when(F.col("name") == "_hi", F.col("_v")))) / 2).alias(median)]
            if median
            else []
        ),
    )
    return out


def _exact(share: float):
    from decimal import Decimal

    return Decimal(str(share))


def latency_stats(df: DataFrame, by: Sequence[str], ms: str = "latency_ms") -> DataFrame:
    """``n, mean_ms, median_ms, p95_ms`` per group; a group without samples keeps
    a zero count and NULL figures."""
    base = df.groupBy(*by).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean_ms"))
    ranks = exact_ranks(df, by, ms, {"p95_ms": 0.95}, median="median_ms")
    return _join_groups(base, ranks, by)


def _join_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on group keys that may be NULL."""
    r = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], *[c for c in right.columns if c not in by])
    cond = F.lit(True)
    for i, k in enumerate(by):
        cond = cond & left[k].eqNullSafe(F.col(f"_k{i}"))
    return left.join(r, cond, "left").drop(*[f"_k{i}" for i in range(len(by))])


def processing_summary(subs: DataFrame, ms: str = "processing_ms", by: Sequence[str] = ()) -> DataFrame:
    """Count, minimum, median, mean, p95 and maximum of the pre-compute time."""
    keys = list(by) or ["_all"]
    df = subs if by else subs.withColumn("_all", F.lit(1))
    base = df.groupBy(*keys).agg(
        F.count(ms).alias("n"), F.min(ms).alias("min_ms"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms")
    )
    out = _join_groups(base, exact_ranks(df, keys, ms, {"p95_ms": 0.95}, median="median_ms"), keys)
    return out if by else out.drop("_all")


def latency_percentiles(df: DataFrame, by: Sequence[str], ms: str, shares: Sequence[float]) -> DataFrame:
    names = {f"p{s * 100:g}".replace(".", "_"): s for s in shares}
    return exact_ranks(df, by, ms, names)


def cpu_only(ocr: DataFrame, by: Sequence[str]) -> DataFrame:
    return ocr.groupBy(*by).agg(F.bool_and("ran_on_cpu").alias("cpu_only"))


def mean_tokens(llm: DataFrame, by: Sequence[str]) -> DataFrame:
    return llm.groupBy(*by).agg(
        F.avg("prompt_tokens").alias("mean_prompt_tokens"),
        F.avg("completion_tokens").alias("mean_completion_tokens"),
    )


def is_local(llm: DataFrame, by: Sequence[str]) -> DataFrame:
    return llm.groupBy(*by).agg(
        F.bool_and(F.coalesce("provider", F.lit("")) == "local").alias("is_local")
    )


def with_price(costs: DataFrame, prices: DataFrame) -> DataFrame:
    """Price columns by model, NULL where a model has no price."""
    return costs.join(prices, "model_id", "left")


def _money(mean: Column) -> Column:
    """A mean as a decimal through its text form, free of binary noise."""
    return mean.cast("string").cast("decimal(24,8)")


def token_cost(mean_prompt: Column, mean_completion: Column, in_price: Column, out_price: Column) -> Column:
    """Cost of one verification, half-even to six places."""
    thousand = F.lit(1000).cast("decimal(4,0)")
    spent = _money(mean_prompt) * in_price + _money(mean_completion) * out_price
    return F.bround((spent / thousand).cast("decimal(38,14)"), 6)


def cost_per_1000(llm: DataFrame, prices: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    """Token means and the cost of one and of a thousand verifications."""
    stats = llm.groupBy(*by).agg(
        F.avg("prompt_tokens").alias("mean_prompt_tokens"),
        F.avg("completion_tokens").alias("mean_completion_tokens"),
        F.bool_and(F.coalesce("provider", F.lit("")) == "local").alias("is_local"),
    )
    df = with_price(stats, prices)
    one = token_cost(
        F.col("mean_prompt_tokens"), F.col("mean_completion_tokens"),
        F.col("input_price_per_1k"), F.col("output_price_per_1k"),
    )
    zero = F.lit(0).cast("decimal(24,6)")
    per = F.when(F.col("is_local"), zero).otherwise(one.cast("decimal(24,6)"))
    df = df.withColumn("cost_per_verification", per)
    df = df.withColumn(
        "cost_per_1000", (F.col("cost_per_verification") * 1000).cast("decimal(27,6)")
    )
    basis = F.when(F.col("is_local"), F.lit(LOCAL_BASIS)).when(
        F.col("cost_per_1000").isNotNull(),
        F.concat(F.col("source"), F.lit(" (as of "), F.col("as_of"), F.lit(")")),
    )
    return df.withColumn("cost_basis", basis).drop(
        "input_price_per_1k", "output_price_per_1k", "source", "as_of"
    )


def cost_report(ocr: DataFrame, llm: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Speed and cost per (engine, variant) and per model."""
    ocr_rows, llm_rows = cost_rows(ocr, llm)
    by = ("engine_name", "image_variant")
    engines = _join_groups(latency_stats(ocr_rows, by), cpu_only(ocr_rows, by), by)
    engines = engines.withColumn("cost_per_1000", F.lit(0).cast("decimal(27,6)")).withColumn(
        "cost_basis", F.lit(LOCAL_BASIS)
    )
    models = _join_groups(latency_stats(llm_rows, ("model_id",)), cost_per_1000(llm_rows, prices), ("model_id",))
    return engines, models


def verification_count(subs: DataFrame) -> DataFrame:
    return subs.agg(F.count(F.lit(1)).alias("verification_count"))


def compute_cost(subs: DataFrame, rate_per_ms: float, ms: str = "processing_ms", by: Sequence[str] = ()) -> DataFrame:
    """A stand-in for compute spend: mean time of a thousand runs at a rate."""
    return subs.groupBy(*by).agg((F.avg(ms) * 1000 * rate_per_ms).alias("compute_cost_per_1000"))
