"""Extractor accuracy against gold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions.jsonfields import json_scalars, statement_text
from concordat.functions.measures import measures_by_line, parse_numeric
from concordat.functions.similarity import (
    best_similarities, levenshtein_similarity, pairwise_similarities,
)
from concordat.functions.text import edit_rate_normalized, has_value, let, normalize_text, once
from concordat.operators.compare import closest, located, within
from concordat.operators.readings import scoring_rows
from concordat.vocab import MATCH, MISMATCH, MISSING, UNVERIFIABLE

TEXT_SCORED = tuple(f for f in vocab.SCORED_FIELDS if f not in vocab.NUMERIC_FIELDS)


def _score(status: Column, similarity: Column) -> Column:
    return F.struct(status.alias("match_status"), similarity.cast("double").alias("similarity"))


def _status(name: str, similarity) -> Column:
    return _score(F.lit(name), similarity if isinstance(similarity, Column) else F.lit(similarity))


def score_text(gold_norm: Column, extracted_norm: Column, similarity: Column) -> Column:
    """Contained, or close enough, is a match."""
    return let(
        lambda found, s: F.when(found, _status(MATCH, 1.0))
        .when(s >= vocab.SIMILARITY_FLOOR, _status(MATCH, s))
        .otherwise(_status(MISMATCH, s)),
        found=located(gold_norm, extracted_norm),
        s=F.coalesce(similarity, F.lit(0.0)),
    )


def score_numeric(gold: Column, near: Column, tolerance) -> Column:
    """A measure of another unit counts as not found here."""
    return let(
        lambda gold, near: F.when(gold.isNull(), _status(UNVERIFIABLE, None))
        .when(near.isNull(), _status(MISSING, None))
        .when(within(near, tolerance), _status(MATCH, 1.0))
        .otherwise(_status(MISMATCH, 0.0)),
        gold=gold, near=near,
    )


def score_guard(gold: Column, extracted: Column, judged: Column) -> Column:
    return (
        F.when(~has_value(gold), _status(UNVERIFIABLE, None))
        .when(~has_value(extracted), _status(MISSING, None))
        .otherwise(judged)
    )


def with_gold(rows: DataFrame, gold: DataFrame, key: str = "ttb_id") -> DataFrame:
    """Rows that have gold; the join strategy is left to the optimizer because
    gold grows with the corpus."""
    return rows.join(gold, key)


def scored_count(subs: DataFrame, gold: DataFrame, key: str = "ttb_id") -> DataFrame:
    return subs.join(gold.select(key), key, "left_semi").agg(
        F.countDistinct(key).alias("scored_submissions")
    )


def common_keys(subs: DataFrame, gold: DataFrame, key: str = "ttb_id") -> DataFrame:
    return subs.select(key).intersect(gold.select(key))


def statement_score(extracted: Column, gold: Column, extracted_norm: Column, gold_norm: Column) -> Column:
    """``struct<present, exact, cer>``; the rate is NULL where gold is missing."""
    present = has_value(extracted)
    known = has_value(gold)
    return F.struct(
        present.alias("present"),
        (present & known & located(gold_norm, extracted_norm)).alias("exact"),
        F.when(known, edit_rate_normalized(extracted_norm, gold_norm)).alias("cer"),
    )


def score_fields(
    rows: DataFrame, text: str, structured: bool = False, method: str = "sequence",
    fields: Sequence[str] = vocab.SCORED_FIELDS, gold_prefix: str = "gt_",
) -> DataFrame:
    """Scores every field of each reading in one pass.

    ``rows`` carries gold columns ``gt_<field>``.  OCR text (``structured`` false)
    is the candidate of every field and is folded once; a model payload yields
    one value per field.  Adds ``scores: map<field, struct>``.
    """
    g = lambda f: F.col(f"{gold_prefix}{f}")
    texts = [f for f in fields if f not in vocab.NUMERIC_FIELDS]
    numbers = [f for f in fields if f in vocab.NUMERIC_FIELDS]
    df = rows
    if structured:
        df = once(df, {"_x": F.when(has_value(text), json_scalars(text, tuple(fields)))})
        df = df.withColumns({f"_x_{f}": F.col("_x")[f] for f in fields})
        step = {f"_n_{f}": normalize_text(f"_x_{f}") for f in texts}
    else:
        step = {"_n": normalize_text(text), "_m": measures_by_line(text)}
    step |= {f"_g_{f}": normalize_text(g(f)) for f in texts}
    step |= {f"_p_{f}": parse_numeric(g(f), f) for f in numbers}
    df = once(df, step)
    value = lambda f: F.col(f"_x_{f}") if structured else F.col(text)
    norm = lambda f: F.col(f"_n_{f}") if structured else F.col("_n")
    needles = [
        F.when(
            (F.col(f"_g_{f}") != "") & has_value(value(f)) & ~F.contains(norm(f), F.col(f"_g_{f}")),
            F.col(f"_g_{f}"),
        )
        for f in texts
    ]
    if method == "levenshtein" or not texts:
        similarity = {f: levenshtein_similarity(a, norm(f)) for a, f in zip(needles, texts)}
    else:
        if structured:
            found = pairwise_similarities(F.array(*needles), F.array(*[norm(f) for f in texts]))
        else:
            df = df.withColumn("_needles", F.array(*needles))
            is_open = F.exists("_needles", lambda n: n.isNotNull())
            found = best_similarities(F.when(is_open, F.col("_needles")), F.when(is_open, F.col("_n")))
        df = df.withColumn("_s", found)
        similarity = {f: F.get("_s", i) for i, f in enumerate(texts)}
    entries = []
    for f in fields:
        if f in vocab.NUMERIC_FIELDS:
            tokens = measures_by_line(f"_x_{f}") if structured else F.col("_m")
            judged = score_numeric(F.col(f"_p_{f}"), closest(F.col(f"_p_{f}"), tokens), vocab.TOLERANCE[f])
        else:
            judged = score_text(F.col(f"_g_{f}"), norm(f), similarity[f])
        entry = lambda r: F.struct(
            F.lit(f).alias("field_key"),
            r["match_status"].alias("match_status"),
            r["similarity"].alias("similarity"),
        )
        entries.append(let(entry, r=score_guard(g(f), value(f), judged)))
    return df.select(*rows.columns, F.array(*entries).alias("scores"))


def score_readings(
    rows: DataFrame, text: str, by: Sequence[str], structured: bool, method: str = "sequence"
) -> DataFrame:
    """Field scores and the statement score of every reading.

    Readings of one label repeat, so each distinct text is scored once against its gold, in whichever
    rows it stands.
    """
    keys = [text, *[c for c in rows.columns if c.startswith("gt_")]]
    each = rows.select(*by, *keys)
    df = score_fields(each.select(*keys).distinct(), text, structured, method)
    df = df.withColumn("_st", statement_text(text))
    df = df.withColumn("_sn", normalize_text("_st")).withColumn(
        "_gn", normalize_text("gt_government_warning")
    )
    df = df.withColumn(
        "statement",
        statement_score(F.col("_st"), F.col("gt_government_warning"), F.col("_sn"), F.col("_gn")),
    )
    rated = df.select(*[F.col(c).alias(f"_of_{c}") for c in keys], "scores", "statement")
    # Gold is often NULL, and so may a text be.
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys])
    return each.join(rated, same).select(*by, "scores", "statement")


def field_outcomes(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """Outcome counts per extractor and field from ``(*by, field_key, match_status)``."""
    s = F.col("match_status")
    return scores.groupBy(*by, "field_key").agg(
        *[F.count_if(s == name).alias(name.lower()) for name in vocab.MATCH_STATUSES]
    )


def rate(match: Column, mismatch: Column, missing: Column) -> Column:
    """Matches over what could be verified; NULL where nothing could."""
    return F.try_divide(match, match + mismatch + missing)


def match_rate(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn(
        "match_rate", rate(F.col("match"), F.col("mismatch"), F.col("missing"))
    )


def overall_rate(outcomes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Micro average over the fields of one extractor."""
    return outcomes.groupBy(*by).agg(
        rate(F.sum("match"), F.sum("mismatch"), F.sum("missing")).alias("field_match_rate"),
        F.sum("unverifiable").alias("unverifiable"),
    )


def statement_rates(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Presence, exactness and mean edit rate per extractor from ``statement``."""
    s = F.col("statement")
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("readings"),
        F.avg(s["present"].cast("double")).alias("presence_rate"),
        F.avg(s["exact"].cast("double")).alias("exactness_rate"),
        F.avg(s["cer"]).alias("mean_cer"),
    )


def accuracy(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """The whole accuracy figure of each extractor in one aggregation.

    Field outcomes are counted inside the row first, so the shuffle carries one
    partial row per extractor and task.
    """
    def count(scores):
        hits = lambda name: F.size(F.filter(scores, lambda x: x["match_status"] == name))
        return F.struct(*[hits(name).alias(name.lower()) for name in vocab.MATCH_STATUSES])

    counted = scored.select(*by, let(count, scores=F.col("scores")).alias("_h"), "statement")
    aggs = [F.sum(f"_h.{name.lower()}").alias(name.lower()) for name in vocab.MATCH_STATUSES]
    s = F.col("statement")
    out = counted.groupBy(*by).agg(
        *aggs,
        F.count(F.lit(1)).alias("readings"),
        F.avg(s["present"].cast("double")).alias("presence_rate"),
        F.avg(s["exact"].cast("double")).alias("exactness_rate"),
        F.avg(s["cer"]).alias("mean_cer"),
    )
    return out.withColumn("field_match_rate", rate(F.col("match"), F.col("mismatch"), F.col("missing")))


def score_corpus(
    subs: DataFrame, ocr: DataFrame, llm: DataFrame, gold: DataFrame, method: str = "sequence"
) -> tuple[DataFrame, DataFrame]:
    """Accuracy per (engine, variant) and per model over all scored readings."""
    keyed = with_gold(subs.select(F.col("id").alias("submission_id"), "ttb_id"), gold)
    ocr_rows, llm_rows = scoring_rows(ocr, llm)
    engines = score_readings(
        ocr_rows.join(keyed, "submission_id"), "extracted_text", ("engine_name", "image_variant"), False, method
    )
    models = score_readings(
        llm_rows.join(keyed, "submission_id"), "result_text", ("model_id",), True, method
    )
    return (
        accuracy(engines, ("engine_name", "image_variant")),
        accuracy(models, ("model_id",)),
    )


def win_rate(scores: DataFrame, case: Sequence[str], extractor: str = "extractor") -> DataFrame:
    """Per field, how often each extractor had the best matching similarity.

    All extractors that share the best similarity of a case are counted.
    """
    good = scores.filter(F.col("match_status") == MATCH)
    top = F.rank().over(W.partitionBy(*case, "field_key").orderBy(F.col("similarity").desc()))
    return (
        good.withColumn("_rank", top)
        .filter("_rank = 1")
        .groupBy("field_key", extractor)
        .agg(F.count(F.lit(1)).alias("wins"))
    )
