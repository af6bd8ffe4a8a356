"""Shaping and choosing extractor readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions.jsonfields import json_scalars
from concordat.functions.text import has_value, nullify_blank, once



def tokens_to_text(
    tokens: DataFrame, key: str, line_keys: Sequence[str], pos: str = "pos", text: str = "text"
) -> DataFrame:
    """Word tokens to reading text: words join into lines, lines join by newline.

    Lines keep the order in which their first word appears.  Two groupings, so a
    very long document is spread over its lines before they meet.
    """
    word = nullify_blank(text)
    lines = (
        tokens.select(key, *line_keys, pos, word.alias("_word"))
        .filter(F.col("_word").isNotNull())
        .groupBy(key, *line_keys)
        .agg(
            F.min(pos).alias("_first"),
            F.expr(f"listagg(_word, ' ') within group (order by `{pos}`)").alias("_line"),
        )
    )
    return lines.groupBy(key).agg(
        F.expr("listagg(_line, '\n') within group (order by _first)").alias("text")
    )


def zip_lines(df: DataFrame, key: Sequence[str], texts: str, scores: str, boxes: str) -> DataFrame:
    """Parallel detector arrays to one row per line; a short score array reads
    as 0.0 and a short box array as NULL."""
    return df.select(
        *key, F.posexplode(texts).alias("pos", "text"), F.col(scores).alias("_s"), F.col(boxes).alias("_b")
    ).select(
        *key,
        "pos",
        "text",
        F.coalesce(F.get("_s", F.col("pos")).cast("double"), F.lit(0.0)).alias("score"),
        F.get("_b", F.col("pos")).alias("box"),
    )


def ok_text(ocr: DataFrame) -> DataFrame:
    """OCR rows that were read and hold more than spaces."""
    return ocr.filter(
        (F.col("status") == "OK")
        & F.col("extracted_text").isNotNull()
        & (F.trim("extracted_text") != "")
    )


def scoring_rows(ocr: DataFrame, llm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows and columns the accuracy score reads, per kind of extractor."""
    return (
        ocr.filter(F.col("status") == "OK").select(
            "submission_id", "id", "engine_name", "image_variant", "extracted_text"
        ),
        llm.filter((F.col("status") == "OK") & (F.col("task") == "extract_fields")).select(
            "submission_id", "id", F.coalesce("model_id", F.lit("")).alias("model_id"), "result_text"
        ),
    )


def cost_rows(ocr: DataFrame, llm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows and columns the speed and cost report reads."""
    return (
        ocr.filter(F.col("status") == "OK").select(
            "engine_name", "image_variant", "latency_ms", "ran_on_cpu"
        ),
        llm.filter((F.col("status") == "OK") & (F.col("task") == "extract_fields")).select(
            F.coalesce("model_id", F.lit("")).alias("model_id"),
            "provider", "latency_ms", "prompt_tokens", "completion_tokens",
        ),
    )


def processed(subs: DataFrame) -> DataFrame:
    return subs.filter(F.col("processing_ms").isNotNull())


def with_total_tokens(llm: DataFrame) -> DataFrame:
    return llm.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))


def telemetry(llm: DataFrame) -> DataFrame:
    """Identity, timing and token columns of a call; never its text."""
    return with_total_tokens(llm).select(
        "model_name", "model_id", "model_full_id", "provider", "task", "status",
        "requested_at", "responded_at", "latency_ms",
        "prompt_tokens", "completion_tokens", "total_tokens",
    )


def reading_tasks(
    images: DataFrame, engines: Sequence[str], run_variants: bool = True,
    prefs: dict[str, str] = vocab.PREFERRED_VARIANT,
) -> DataFrame:
    """One row per reading to make: the original of every image for every
    enabled engine, plus the engine's preferred variant where one was produced."""
    options = []
    for engine in engines:
        options.append(_task(engine, "ORIGINAL", F.col("filename")))
        variant = prefs.get(engine)
        if run_variants and variant is not None:
            options.append(_task(engine, variant, F.col(f"{variant.lower()}_path")))
    tasks = F.filter(F.array(*options), lambda t: F.coalesce(t["path"], F.lit("")) != "")
    return images.select("id", "submission_id", F.inline(tasks))


def _task(engine: str, variant: str, path: Column) -> Column:
    return F.struct(
        F.lit(engine).alias("engine_name"), F.lit(variant).alias("image_variant"), path.alias("path")
    )


def mean_confidence(words: DataFrame, by: Sequence[str], conf: str = "conf") -> DataFrame:
    """Mean of the valid word confidences on a 0-1 scale; NULL when none is."""
    c = F.col(conf).try_cast("double")
    return words.groupBy(*by).agg(F.avg(F.when(c >= 0, c / 100)).alias("confidence"))


def mean_score_clamped(lines: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    mean = F.avg(score)
    return lines.groupBy(*by).agg(
        F.when(mean.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))).alias("confidence")
    )


def best_ocr(ocr: DataFrame, key: str = "submission_id", order_id: Sequence[str] = ("id",)) -> DataFrame:
    """The most confident readable row per submission; lowest id on a tie."""
    rank = W.partitionBy(key).orderBy(F.col("confidence").desc_nulls_last(), *order_id)
    return (
        ocr.filter(F.col("status") == "OK")
        .withColumn("_rank", F.row_number().over(rank))
        .filter("_rank = 1")
        .drop("_rank")
    )


def latest_extraction(
    llm: DataFrame, key: str = "submission_id", order_id: Sequence[str] = ("id",)
) -> DataFrame:
    """The newest displayed extraction per submission."""
    shown = llm.filter(
        (F.col("task") == "extract_fields")
        & (F.col("status") == "OK")
        & ~F.col("is_benchmark_only")
        & F.col("result_text").isNotNull()
    )
    rank = W.partitionBy(key).orderBy(*[F.col(c).desc() for c in order_id])
    return shown.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")


def extraction_degraded(subs: DataFrame, llm: DataFrame) -> DataFrame:
    """Each submission with a flag: a displayed extraction ended in an error."""
    failed = (
        llm.filter(
            (F.col("task") == "extract_fields")
            & (F.col("status") == "ERROR")
            & ~F.col("is_benchmark_only")
        )
        .select(F.col("submission_id").alias("id"))
        .distinct()
        .withColumn("_failed", F.lit(True))
    )
    return subs.join(failed, "id", "left").withColumn(
        "degraded", F.coalesce("_failed", F.lit(False))
    ).drop("_failed")


def joined_text(
    ocr: DataFrame, key: str = "submission_id", order_id: Sequence[str] = ("id",), text: str = "extracted_text"
) -> DataFrame:
    """``(key, text)``: a key's texts joined by newline in order, one row per key.

    One scan and one exchange.  The joined text is the unit that every check reads, so it is
    whole at every size: a phrase may straddle any two readings.
    """
    order = ", ".join(f"`{c}`" for c in order_id)
    return ocr.groupBy(key).agg(F.expr(f"listagg(`{text}`, '\n') within group (order by {order})").alias("text"))


def submission_text(subs: DataFrame, ocr: DataFrame) -> DataFrame:
    """Every submission with its readable OCR text; empty where there is none."""
    texts = joined_text(ok_text(ocr)).withColumnRenamed("submission_id", "id")
    return subs.join(texts, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def extracted_values(llm: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The newest extraction's fields, one column each (NULL where unusable).

    A statement's transcription is text; a number there is none.
    """
    read = json_scalars("result_text", tuple(fields), ("government_warning",))
    return once(latest_extraction(llm), {"_read": read}).select(
        "submission_id", F.col("id").alias("llm_id"), *[F.col("_read")[f].alias(f) for f in fields]
    )


def union_readings(ocr_values: DataFrame, llm_values: DataFrame) -> DataFrame:
    """OCR and model readings in one frame, ordered OCR first.

    Inputs: ``(submission_id, field_key, value, source_id[, confidence])``.
    """
    a = ocr_values.withColumn("source", F.lit("ocr")).withColumn("source_order", F.lit(0))
    b = llm_values.withColumn("source", F.lit("llm")).withColumn("source_order", F.lit(1))
    return a.unionByName(b, allowMissingColumns=True).filter(has_value("value"))


def filed_values(subs: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """One row per submission and field with the value as filed."""
    return subs.select(key, *fields).unpivot(key, list(fields), "field_key", "filed")


def pair_readings(filed: DataFrame, ocr_values: DataFrame, llm_values: DataFrame) -> DataFrame:
    """Filed value against each available reading; one empty row when none is."""
    readings = union_readings(ocr_values, llm_values)
    return filed.withColumnRenamed("id", "submission_id").join(
        readings, ["submission_id", "field_key"], "left"
    )


def primary_image(images: DataFrame) -> DataFrame:
    """First image by position; a blank file name counts as none."""
    rank = W.partitionBy("submission_id").orderBy(F.col("position").asc_nulls_last(), "id")
    return (
        images.withColumn("_rank", F.row_number().over(rank))
        .filter("_rank = 1")
        .select("submission_id", "id", F.when(has_value("filename"), F.col("filename")).alias("filename"))
    )
