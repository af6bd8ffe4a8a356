"""Filed-against-observed comparison.

The rules are Column expressions over one row, so a job that has the filed and
observed values side by side needs no further shuffle to judge them, but for the
sequence similarity, which is joined per distinct pair of texts.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions import exact
from concordat.functions.measures import measures_by_line, parse_numeric, shown_number
from concordat.functions.nearest import nearest_measure
from concordat.functions.similarity import best_similarity, levenshtein_similarity
from concordat.functions.text import has_value, let, normalize_text
from concordat.operators.joins import left_join_spread
from concordat.operators.rollup import agree
from concordat.vocab import FAIL, MATCH, MISMATCH, MISSING, PASS, REVIEW, UNVERIFIABLE

#: A difference of two values of decimal(30,10).
GAP_TYPE = "decimal(31,10)"
OUTCOME = "struct<match_status:string,similarity:double,verdict:string,detail:string>"


def outcome(status: str, similarity, verdict: str, detail) -> Column:
    sim = similarity if isinstance(similarity, Column) else F.lit(similarity)
    text = detail if isinstance(detail, Column) else F.lit(detail)
    return F.struct(
        F.lit(status).alias("match_status"),
        sim.cast("double").alias("similarity"),
        F.lit(verdict).alias("verdict"),
        text.alias("detail"),
    )


def guard(filed: Column, observed: Column, judged: Column) -> Column:
    """Nothing filed, or nothing observed, leaves nothing to judge."""
    return (
        F.when(~has_value(filed), outcome(UNVERIFIABLE, None, REVIEW, "nothing was filed for this field"))
        .when(~has_value(observed), outcome(MISSING, None, REVIEW, "not found on the label"))
        .otherwise(judged)
    )


def located(filed_norm: Column, observed_norm: Column) -> Column:
    """Equal or contained; containment covers equality."""
    return (filed_norm != "") & F.contains(observed_norm, filed_norm)


def text_outcome(filed_norm: Column, observed_norm: Column, similarity: Column) -> Column:
    """Three bands; ``similarity`` is read only where containment failed."""
    def judge(filed, found, score):
        shown = F.format_string("%.3f", score)
        return (
            F.when(found, outcome(MATCH, 1.0, PASS, F.concat(F.lit("found: "), filed)))
            .when(
                score >= vocab.SIMILARITY_FLOOR,
                outcome(MISMATCH, score, REVIEW, F.concat(F.lit("close but not equal: "), shown)),
            )
            .otherwise(outcome(MISMATCH, score, FAIL, F.concat(F.lit("different: "), shown)))
        )

    return let(
        judge, filed=filed_norm, found=located(filed_norm, observed_norm),
        score=F.coalesce(similarity, F.lit(0.0)),
    )


def closest(filed: Column, tokens: Column) -> Column:
    """The same-unit measure nearest to the filed one, with its ``gap``; the first of equals.

    Where every number fits Spark's decimals, gaps are decimals.  Where one does not, gaps are
    worked out on digit strings and ``far`` orders them.
    """
    def nearest(filed, same):
        def ranked(gap, far):
            return F.array_min(F.transform(
                same, lambda t, i: F.struct(gap(t).alias("gap"), far(t).alias("far"), i.alias("at"), t["value"].alias("value"), t["digits"].alias("digits"))
            ))

        wide = filed["digits"].isNotNull() | F.exists(same, lambda t: t["digits"].isNotNull())
        by_digits = lambda t: exact.magnitude_key(exact.gap(shown_number(t), shown_number(filed)))
        return F.when(wide, ranked(lambda t: F.lit(None).cast(GAP_TYPE), by_digits)).otherwise(
            ranked(lambda t: F.abs(t["value"] - filed["value"]).cast(GAP_TYPE), lambda t: F.lit(None).cast("string"))
        )

    return let(
        lambda filed, tokens: let(nearest, filed=filed, same=F.filter(tokens, lambda t: t["unit"] == filed["unit"])), filed=filed, tokens=tokens
    )


def within(near: Column, tolerance) -> Column:
    """Whether the result of :func:`closest` is no farther off than ``tolerance``."""
    return F.when(near["far"].isNotNull(), near["far"] <= exact.literal_key(tolerance)).otherwise(near["gap"] <= F.lit(tolerance))


def numeric_outcome(filed: Column, near: Column, tolerance) -> Column:
    """``filed`` is a measure, ``near`` the result of :func:`closest`."""
    return let(
        lambda filed, near: _numeric_bands(
            filed.isNull(), near.isNull(), within(near, tolerance), shown_number(filed), filed["unit"], shown_number(near), tolerance
        ),
        filed=filed, near=near,
    )


def found_outcome(found: Column, tolerance) -> Column:
    """``found`` is the result of :func:`nearest_measure` for that tolerance."""
    return _numeric_bands(found["filed"].isNull(), found["near"].isNull(), found["fits"], found["filed"], found["unit"], found["near"], tolerance)


def _numeric_bands(unfiled: Column, unread: Column, fits: Column, filed: Column, unit: Column, near: Column, tolerance) -> Column:
    def pair(word: str) -> Column:
        return F.concat(filed, unit, F.lit(f" {word} "), near, unit, F.lit(f" (±{tolerance})"))

    return (
        F.when(unfiled, outcome(UNVERIFIABLE, None, REVIEW, "the filed value is not a measure"))
        .when(unread, outcome(UNVERIFIABLE, None, REVIEW, "no number of that unit on the label"))
        .when(fits, outcome(MATCH, 1.0, PASS, pair("is")))
        .otherwise(outcome(MISMATCH, 0.0, FAIL, pair("is not")))
    )


def _as_review(result: Column, detail: Column) -> Column:
    return F.struct(
        result["match_status"].alias("match_status"),
        result["similarity"].alias("similarity"),
        F.lit(REVIEW).alias("verdict"),
        detail.alias("detail"),
    )


def confidence_valve(
    result: Column, is_llm: Column, confidence: Column, floor: float = vocab.CONFIDENCE_FLOOR
) -> Column:
    """A weak OCR reading supports neither PASS nor FAIL."""
    def judge(r, weak, confidence):
        note = F.format_string(" | reading confidence %.2f is low", confidence)
        return F.when(weak & (r["verdict"] != REVIEW), _as_review(r, F.concat(r["detail"], note))).otherwise(r)

    weak = F.coalesce(~is_llm & (confidence < floor), F.lit(False))
    return let(judge, r=result, weak=weak, confidence=confidence)


def soften(result: Column, note: str | Column) -> Column:
    """FAIL becomes REVIEW with a note; anything else is unchanged."""
    text = note if isinstance(note, Column) else F.lit(note)

    def judge(r, note):
        softened = _as_review(r, F.concat(r["detail"], F.lit(" — "), note))
        return F.when(r["verdict"] == FAIL, softened).otherwise(r)

    return let(judge, r=result, note=text)


# --- narrow form: one row per filed/observed pair ---------------------------


def _similarity(df: DataFrame, filed: str, observed: str, method: str, out: str) -> DataFrame:
    """Add a similarity that is computed only for unresolved rows.

    The sequence similarity takes most of a job's time, and readings repeat, so each distinct pair of
    texts is rated once, in whichever rows it stands.
    """
    a, b = F.col(filed), F.col(observed)
    open_row = (a != "") & (b != "") & ~F.contains(b, a)
    if method == "levenshtein":
        return df.withColumn(out, levenshtein_similarity(F.when(open_row, a), F.when(open_row, b)))
    df = df.withColumn("_pair", F.when(open_row, F.struct(a.alias("a"), b.alias("b"))))
    pairs = df.select("_pair").filter("_pair is not null").distinct()
    rated = pairs.select("_pair", best_similarity("_pair.a", "_pair.b").alias(out))
    return left_join_spread(df, rated, "_pair").drop("_pair")


def compare_text(df: DataFrame, filed: str = "filed", observed: str = "value", method: str = "sequence") -> DataFrame:
    """Adds ``result`` for text pairs."""
    df = df.withColumn("_fn", normalize_text(filed)).withColumn("_on", normalize_text(observed))
    df = _similarity(df, "_fn", "_on", method, "_sim")
    judged = guard(
        F.col(filed), F.col(observed), text_outcome(F.col("_fn"), F.col("_on"), F.col("_sim"))
    )
    return df.withColumn("result", judged).drop("_fn", "_on", "_sim")


def compare_numeric(
    df: DataFrame, field_key: str, filed: str = "filed", observed: str = "value", tolerance=None
) -> DataFrame:
    """Adds ``result`` for pairs of one measured field."""
    limit = vocab.TOLERANCE[field_key] if tolerance is None else tolerance
    # Other fields hold no measure.
    measured = F.col(filed) if field_key in vocab.NUMERIC_FIELDS else F.lit(None).cast("string")
    df = df.withColumn("_found", nearest_measure(Decimal(str(limit)))(measured, F.col(observed)))
    judged = guard(F.col(filed), F.col(observed), found_outcome(F.col("_found"), limit))
    return df.withColumn("result", judged).drop("_found")


def compare_pairs(pairs: DataFrame, method: str = "sequence") -> DataFrame:
    """Adds ``match_status, similarity, verdict, detail`` to rows of
    ``(submission_id, field_key, filed, value, source, confidence)``.

    Both kinds of field are judged in one pass over the pairs: the branch is
    chosen per row, and only open text rows reach the similarity UDF.
    """
    measured = F.col("field_key").isin(*vocab.NUMERIC_FIELDS)
    df = (
        pairs.withColumn("_fn", normalize_text(F.when(~measured, F.col("filed"))))
        .withColumn("_on", normalize_text(F.when(~measured, F.col("value"))))
        .withColumn("_f", parse_numeric(F.when(measured, F.col("filed")), "net_contents"))
        .withColumn("_tokens", measures_by_line(F.when(measured, F.col("value"))))
    )
    df = _similarity(df, "_fn", "_on", method, "_sim")
    near = closest(F.col("_f"), F.col("_tokens"))
    df = df.withColumn("_near", near)
    numeric = None
    for key, limit in vocab.TOLERANCE.items():
        branch = numeric_outcome(F.col("_f"), F.col("_near"), limit)
        numeric = (
            F.when(F.col("field_key") == key, branch)
            if numeric is None
            else numeric.when(F.col("field_key") == key, branch)
        )
    text = text_outcome(F.col("_fn"), F.col("_on"), F.col("_sim"))
    df = df.withColumn(
        "_r", guard(F.col("filed"), F.col("value"), F.when(measured, numeric).otherwise(text))
    )
    is_llm = F.coalesce(F.col("source") == "llm", F.lit(False))
    df = df.withColumn("_r", confidence_valve(F.col("_r"), is_llm, F.col("confidence")))
    note = None
    for key, words in vocab.SOFT_FIELDS.items():
        note = F.when(F.col("field_key") == key, words) if note is None else note.when(F.col("field_key") == key, words)
    df = df.withColumn(
        "_r", F.when(F.col("field_key").isin(*vocab.SOFT_FIELDS), soften(F.col("_r"), note)).otherwise(F.col("_r"))
    )
    kept = [c for c in pairs.columns]
    return df.select(*kept, "_r.match_status", "_r.similarity", "_r.verdict", "_r.detail")


def field_match(pairs: DataFrame, method: str = "sequence") -> tuple[DataFrame, DataFrame]:
    """``(comparisons, checks)``: every pair judged, then agreement per field."""
    comparisons = compare_pairs(pairs, method)
    checks = comparisons.groupBy("submission_id", "field_key").agg(
        agree("verdict").alias("verdict"),
        F.coalesce(F.max(F.when(F.col("source") == "llm", F.lit("llm"))), F.max("source")).alias("primary_source"),
    )
    return comparisons, checks


def country_of_origin(pairs: DataFrame, method: str = "sequence") -> DataFrame:
    """Origin check over pairs that carry ``source_of_product``.

    A domestic product passes without being read; the rest is compared softly.
    """
    domestic = F.coalesce(F.upper("source_of_product") == "DOMESTIC", F.lit(False))
    passed = (
        pairs.filter(domestic)
        .select("submission_id")
        .distinct()
        .select(
            "submission_id",
            F.lit(MATCH).alias("match_status"),
            F.lit(1.0).alias("similarity"),
            F.lit(PASS).alias("verdict"),
            F.lit("Not imported").alias("observed"),
        )
    )
    compared = compare_pairs(pairs.filter(~domestic), method)
    best = compared.groupBy("submission_id").agg(
        F.max_by(
            F.struct("match_status", "similarity", F.col("value").alias("observed")),
            F.struct(F.col("source") == "llm", F.coalesce("similarity", F.lit(-1.0))),
        ).alias("shown"),
        agree("verdict").alias("verdict"),
    )
    return passed.unionByName(
        best.select("submission_id", "shown.match_status", "shown.similarity", "verdict", "shown.observed")
    )


def primary_comparison(comparisons: DataFrame) -> DataFrame:
    """The comparison a check points to: the model's row, else the OCR row."""
    rank = W.partitionBy("submission_id", "field_key").orderBy(
        F.col("source_llm_result_id").isNull(), "id"
    )
    return (
        comparisons.withColumn("_rank", F.row_number().over(rank)).filter("_rank = 1").drop("_rank")
    )
