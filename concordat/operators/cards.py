"""The review read models: comparison cards, statement card and checklist."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions import display
from concordat.functions.jsonfields import string_list, string_map
from concordat.functions.measures import numeric_line
from concordat.functions.similarity import best_window
from concordat.functions.text import has_value, lookup, normalize_text
from concordat.operators.joins import left_join_spread
from concordat.vocab import FAIL, MATCH, MISMATCH, MISSING, NA, PASS, REVIEW, UNVERIFIABLE

# Notes shown with each card state and statement outcome.
STATE_NOTES = {
    "soft": "Capitalization differs; the text otherwise matches.",
    "near_miss": "The values are close but not identical — please verify by eye.",
    "not_found": "Not found on label",
    "unreadable": "Couldn't read this field reliably from the photo — please verify by eye.",
    "blank_application": "No value submitted in the application for this field.",
    "error": "This check couldn't be completed — please verify by eye.",
}
STATEMENT_NOTES = {
    "pass": "On-label warning matches the required statement — exact wording and casing.",
    "absent": "Required Government Warning not found on the submitted images",
    "couldnt_verify": "Couldn't confirm the bold/visual styling from a photo — please verify by eye.",
}
STATEMENT_PAYLOAD = (
    "outcome string, deviation string, expected string, found string, message string, "
    "cfr_citation string"
)


def comparison_view(cmp: DataFrame, ocr: DataFrame, llm: DataFrame) -> DataFrame:
    """Comparisons with ``extracted_source``: ``ocr:<engine>``, ``llm:<model>`` or NULL."""
    o = ocr.select(F.col("id").alias("source_ocr_result_id"), F.col("engine_name").alias("_e"))
    m = llm.select(F.col("id").alias("source_llm_result_id"), F.col("model_id").alias("_m"))
    # A comparison has one source at most, so most rows lack one id or the other.
    joined = left_join_spread(left_join_spread(cmp, o, "source_ocr_result_id"), m, "source_llm_result_id")
    source = F.when(
        F.col("source_ocr_result_id").isNotNull(), F.concat(F.lit("ocr:"), F.col("_e"))
    ).when(F.col("source_llm_result_id").isNotNull(), F.concat(F.lit("llm:"), F.col("_m")))
    return joined.select(*cmp.columns, source.alias("extracted_source"))


def is_blank(col: Column | str) -> Column:
    return ~has_value(col)


def card_state(verdict: Column, status: Column, filed: Column, observed: Column) -> Column:
    same = filed.eqNullSafe(observed)
    matched_review = (status == MATCH) & (verdict == REVIEW)
    return (
        F.when(is_blank(filed) & ~is_blank(observed), "blank_application")
        .when(status == UNVERIFIABLE, "unreadable")
        .when(status == MISSING, "not_found")
        .when(matched_review & ~same, "soft")
        .when(matched_review, "unreadable")
        .when((status == MISMATCH) & F.coalesce(verdict == FAIL, F.lit(False)), "mismatch")
        .when(status == MISMATCH, "near_miss")
        .otherwise("match")
    )


def snippet(field_key: Column, filed: Column, text: Column) -> Column:
    """The part of a whole-label text that belongs to one field."""
    numeric = None
    for key in vocab.NUMERIC_FIELDS:
        line = F.when(has_value(filed), numeric_line(text, filed, key)).otherwise(
            numeric_line(text, None, key)
        )
        numeric = F.when(field_key == key, line) if numeric is None else numeric.when(field_key == key, line)
    measured = field_key.isin(*vocab.NUMERIC_FIELDS)
    wants_window = ~measured & has_value(filed) & has_value(text)
    window = best_window(
        F.when(wants_window, normalize_text(filed)), F.when(wants_window, text)
    )["window"]
    return (
        F.when(~has_value(text), text)
        .when(measured, numeric)
        .when(has_value(filed), F.coalesce(window, text))
    )


def displayed_value(cmp: DataFrame) -> DataFrame:
    """Adds ``shown``: the snippet for OCR-sourced rows, else the stored value."""
    from_ocr = F.col("source_llm_result_id").isNull() & F.col("source_ocr_result_id").isNotNull()
    cut = snippet(
        F.col("field_key"), F.col("application_value"), F.when(from_ocr, F.col("extracted_value"))
    )
    return cmp.withColumn("shown", F.when(from_ocr, cut).otherwise(F.col("extracted_value")))


def cards_base(items: DataFrame, cmp: DataFrame) -> DataFrame:
    """Items that point to a comparison, with it, and whether it is there."""
    c = cmp.select(
        F.col("id").alias("field_comparison_id"),
        "field_key", "application_value", "extracted_value", "extracted_source", "match_status",
        *[x for x in ("shown",) if x in cmp.columns],
        F.lit(True).alias("_found"),
    )
    return items.filter(F.col("field_comparison_id").isNotNull()).join(
        c, "field_comparison_id", "left"
    ).withColumn("is_error", F.col("_found").isNull()).drop("_found")


def readings_by_field(cmp: DataFrame, value: str = "extracted_value") -> DataFrame:
    """All readings of a field, OCR before AI.  A field has one row per source."""
    source = F.coalesce("extracted_source", F.lit(""))
    entry = F.struct(
        F.when(source.startswith("ocr:"), 0).otherwise(1).alias("rank"),
        F.col("id").alias("id"),
        display.source_label("extracted_source").alias("source_label"),
        F.col(value).alias("value"),
        F.col("match_status").alias("match_status"),
        display.indicator("match_status").alias("indicator"),
    )
    return cmp.groupBy("submission_id", "field_key").agg(
        F.array_sort(F.collect_list(entry)).alias("readings")
    )


def decision_flags(verdict: Column, explicit: Column) -> Column:
    """``struct<decision, decided>``: an explicit call wins; a clean check starts
    as passed; anything else is open."""
    call = F.when(explicit.isin("pass", "fail"), explicit).when(
        verdict.isin(PASS, NA), F.lit("pass")
    )
    return F.struct(F.coalesce(call, F.lit("")).alias("decision"), call.isNotNull().alias("decided"))


def read_progress(progress: DataFrame, subs: DataFrame | None = None) -> DataFrame:
    """Progress columns as typed values; a submission without a row is empty."""
    base = progress
    if subs is not None:
        base = subs.select(F.col("id").alias("submission_id")).join(progress, "submission_id", "left")
    return base.select(
        "submission_id",
        string_list("ticked_check_keys").alias("ticked_check_keys"),
        string_map("decisions").alias("decisions"),
        "draft_notes",
    )


def overlay_decisions(items: DataFrame, progress: DataFrame) -> DataFrame:
    """Items with the person's call on each check; ``progress`` has a typed
    ``decisions`` map per submission."""
    p = progress.select("submission_id", F.col("decisions").alias("_d"))
    df = items.join(p, "submission_id", "left").withColumn(
        "_f", decision_flags(F.col("verdict"), F.try_element_at("_d", F.col("check_key")))
    )
    return df.withColumn("decision", F.col("_f.decision")).withColumn(
        "decided", F.col("_f.decided")
    ).drop("_d", "_f")


def checklist_tally(items: DataFrame, progress: DataFrame) -> DataFrame:
    return overlay_decisions(items, progress).groupBy("submission_id").agg(
        F.count_if("decided").alias("done"),
        F.count(F.lit(1)).alias("total"),
        (F.count_if("decided") < F.count(F.lit(1))).alias("has_open"),
    )


def steps(items: DataFrame, step_map: Mapping[str, str] = vocab.STEP_OF_CHECK) -> DataFrame:
    """Visible steps per submission, numbered; the conditional step appears only
    where a manual check outside the map exists."""
    outside = ~F.col("check_key").isin(*step_map) & F.coalesce(
        F.col("check_type") == "MANUAL", F.lit(False)
    )
    flags = items.groupBy("submission_id").agg(F.bool_or(outside).alias("conditional"))
    names = F.array_compact(
        F.array(
            F.lit("Identity"), F.lit("Mandatory text"), F.lit("Gov. Warning"),
            F.when(F.col("conditional"), F.lit("Conditional")), F.lit("Decide"),
        )
    )
    return flags.select("submission_id", F.posexplode(names).alias("_p", "label")).select(
        "submission_id", (F.col("_p") + 1).alias("number"), "label"
    )


def item_group(check_key: Column | str, step_map: Mapping[str, str] = vocab.STEP_OF_CHECK) -> Column:
    key = F.col(check_key) if isinstance(check_key, str) else check_key
    return F.coalesce(lookup(key, step_map), F.lit("Conditional"))


def severity(verdict: Column | str) -> Column:
    v = F.col(verdict) if isinstance(verdict, str) else verdict
    return F.when(v == FAIL, 0).when(v == PASS, 2).otherwise(1)


def problems_first(cards: DataFrame, *tie_break: str) -> DataFrame:
    return cards.orderBy(severity("verdict"), *tie_break)


def review_cards(items: DataFrame, cmp: DataFrame, progress: DataFrame) -> DataFrame:
    """One card per item that points to a comparison, written as a table.

    ``sort_rank`` and ``id`` give the display order inside a submission; the
    table itself is not sorted globally.
    """
    shown = "shown" if "shown" in cmp.columns else "extracted_value"
    df = cards_base(items, cmp)
    verdict = F.when(F.col("is_error"), F.lit(REVIEW)).otherwise(F.coalesce("verdict", F.lit(REVIEW)))
    state = F.when(F.col("is_error"), F.lit("error")).otherwise(
        card_state(F.col("verdict"), F.col("match_status"), F.col("application_value"), F.col("extracted_value"))
    )
    df = df.withColumn("state", state).withColumn("verdict", verdict)
    df = overlay_decisions(df, progress)
    gathered = readings_by_field(cmp, shown)
    df = df.join(gathered, ["submission_id", "field_key"], "left")
    title = lambda c: F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))
    return df.select(
        "submission_id", "id",
        F.coalesce("field_key", "check_key").alias("field_key"),
        F.coalesce("label", title(F.coalesce("field_key", "check_key"))).alias("field_label"),
        "cfr_citation", "verdict", "state", "application_value",
        F.col(shown).alias("extracted_value"),
        "extracted_source", "detail",
        lookup(F.col("state"), STATE_NOTES).alias("note"),
        "readings", "decision", "decided",
        (F.col("verdict") != PASS).alias("is_problem"),
        severity("verdict").alias("sort_rank"),
    )


def statement_card(items: DataFrame, check_key: str = "government_warning") -> DataFrame:
    """The statement card of each submission from its stored JSON detail."""
    p = F.from_json("detail", STATEMENT_PAYLOAD)
    rows = items.filter(F.col("check_key") == check_key).withColumn("_p", p)
    known = F.coalesce(
        F.col("_p.outcome").isin("pass", "reworded", "absent", "couldnt_verify"), F.lit(False)
    )
    outcome = F.when(known, F.col("_p.outcome")).otherwise(F.lit("couldnt_verify"))
    has_found = F.coalesce(F.col("_p.found"), F.lit("")) != ""
    unclear = F.lit(STATEMENT_NOTES["couldnt_verify"])
    note = (
        F.when(outcome == "pass", STATEMENT_NOTES["pass"])
        .when(outcome == "absent", STATEMENT_NOTES["absent"])
        .when(outcome == "reworded", F.lit(None))
        .when(known & has_found, F.coalesce(F.nullif(F.col("_p.message"), F.lit("")), unclear))
        .otherwise(unclear)
    )
    shows_found = known & (
        (outcome == "reworded") | ((outcome == "couldnt_verify") & has_found)
    )
    return rows.select(
        "submission_id",
        outcome.alias("outcome"),
        F.when(known, F.coalesce("verdict", F.lit(REVIEW))).otherwise(F.lit(REVIEW)).alias("verdict"),
        F.coalesce("cfr_citation", "_p.cfr_citation").alias("cfr_citation"),
        F.when(outcome == "reworded", F.upper(F.nullif(F.col("_p.expected"), F.lit("")))).alias("required_text"),
        F.when(shows_found, F.col("_p.found")).alias("onlabel_text"),
        F.when(outcome == "reworded", F.col("_p.deviation")).alias("deviation"),
        note.alias("note"),
    )
