"""Executor, scoring, keyed updates, sources and streams on small frames."""

import json
import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from concordat import schemas
from concordat.operators import cost as co
from concordat.operators import keyed as ky
from concordat.operators import lifecycle as lc
from concordat.operators import readings as rd
from concordat.operators import report as rp
from concordat.operators import scoring as sc
from concordat.plans import engine
from concordat.rules import RULES, Rule, rules_frame
from concordat.session import work_dir
from concordat.sources import cleaning as cl
from concordat.sources import files as fs
from concordat.streaming import intake as si
from concordat.streaming.lifecycle import lifecycle_stream

SUB = (
    "id bigint, beverage_type string, source_of_product string, brand_name string, class_type_designation string, "
    "alcohol_content string, net_contents string, applicant_name_address string, country_of_origin string"
)
OCR = "submission_id bigint, id bigint, status string, confidence double, extracted_text string"
LLM = "submission_id bigint, id bigint, task string, status string, is_benchmark_only boolean, result_text string"


def frames(spark, n=6):
    subs, ocr, llm = [], [], []
    for i in range(n):
        kind = ("DISTILLED_SPIRITS", "WINE", "CIDER")[i % 3]
        subs.append((i, kind, "IMPORTED" if i % 2 else "DOMESTIC", "Old Tom", "Bourbon", "45%", "750 ml", "Tom, KY", "Scotland"))
        if i != 4:
            ocr.append((i, 10 * i + 1, "OK", 0.9, f"OLD TOM\n{'700' if i == 3 else '750'} ML"))
            ocr.append((i, 10 * i + 2, "OK", 0.8, "45% alc bourbon\nTom, KY Scotland"))
            ocr.append((i, 10 * i + 3, "ERROR", 0.99, "750 ml"))
        llm.append((i, i, "extract_fields", "OK", False, json.dumps({"brand_name": "Old Tom", "net_contents": "750 ml"})))
    return (
        spark.createDataFrame(subs, SUB), spark.createDataFrame(ocr, OCR), spark.createDataFrame(llm, LLM),
    )


def as_dict(judged):
    return {
        (r.submission_id, r.check_key): r.verdict for r in engine.checks_of(judged).select("submission_id", "check_key", "verdict").collect()
    }


def test_run_rules(spark):
    subs, ocr, llm = frames(spark)
    judged = engine.run_rules(subs, ocr, llm).persist()
    got = as_dict(judged)
    assert len(got) == 4 * 7  # the two submissions of an unknown type have no rule
    assert got[(0, "brand_name")] == "PASS" and got[(0, "country_of_origin")] == "PASS"
    assert got[(3, "net_contents")] == "REVIEW"  # the sources disagree
    assert got[(4, "alcohol_content")] == "REVIEW" and got[(4, "net_contents")] == "PASS"
    assert got[(1, "government_warning")] == "FAIL"
    verdicts = {r.submission_id: r.engine_verdict for r in engine.verdicts_of(judged).collect()}
    assert verdicts == {0: "FAIL", 1: "FAIL", 2: "REVIEW", 3: "FAIL", 4: "FAIL", 5: "REVIEW"}
    rows = engine.comparisons_of(judged).filter("submission_id = 0 and check_key = 'brand_name'").collect()
    assert [(r.source, r.source_id) for r in rows] == [("ocr", "1"), ("llm", "0")]
    judged.unpersist()


def test_a_phrase_may_straddle_readings_at_any_size(spark):
    """Brand, measure and statement verdicts do not depend on how many readings there are."""
    subs, ocr, llm = frames(spark, 1)
    first = ocr.filter("submission_id = 0")
    filler = spark.range(1000, 2500).select(
        *[F.col("id").cast(t).alias("id") if c == "id" else F.lit(0).cast(t).alias(c) if c == "submission_id"
          else F.lit("filler").alias(c) if c == "extracted_text" else F.lit("OK").alias(c) if c == "status"
          else F.lit(0.99).cast(t).alias(c) if c == "confidence" else F.lit(None).cast(t).alias(c) for c, t in ocr.dtypes]
    )
    whole = as_dict(engine.run_rules(subs, first, llm))
    assert as_dict(engine.run_rules(subs, first.unionByName(filler), llm)) == whole
    texts = rd.joined_text(first.unionByName(filler))
    assert texts.count() == 1 and texts.filter(F.contains("text", F.lit("filler\nfiller"))).count() == 1


def test_unknown_and_broken_strategies_review(spark):
    subs, ocr, llm = frames(spark, 1)

    def broken(rule, ev):
        raise ValueError("no")

    engine.register_strategy("broken_for_test", broken)
    rules = [
        Rule("DISTILLED_SPIRITS", key, key, "MANUAL", "c", "2026-01-01", strategy, None)
        for key, strategy in (("a", "broken_for_test"), ("b", "not_registered"), ("abv_format", "format_checks"), ("same_field_of_vision", "positional"))
    ]
    got = as_dict(engine.run_rules(subs, ocr, llm, rules))
    assert got == {(0, "a"): "REVIEW", (0, "b"): "REVIEW", (0, "abv_format"): "PASS", (0, "same_field_of_vision"): "REVIEW"}


def test_rules_table(spark):
    rules = rules_frame(spark)
    assert rules.count() == 21 and rules.select("beverage_type").distinct().count() == 3
    assert {r.cfr_citation for r in RULES if r.check_key == "country_of_origin"} == {"27 CFR 5.69", "19 CFR 134.11", "27 CFR 7.69"}


def test_percentiles_match_their_definition(spark):
    rng = random.Random(1)
    groups = {"a": [rng.randint(0, 5) for _ in range(301)], "b": [7], "c": [rng.uniform(-50, 1e6) for _ in range(100)], "d": list(range(21))}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in co.latency_stats(df, ("g",), "v").collect()}
    from math import ceil
    from statistics import median

    for g, vs in groups.items():
        s = sorted(float(v) for v in vs)
        assert got[g].n == len(s) and got[g].median_ms == median(s)
        assert got[g].p95_ms == s[ceil(0.95 * len(s)) - 1]
    assert got["e"].n == 0 and got["e"].median_ms is None


def test_cost(spark):
    llm = spark.createDataFrame(
        [("m", "api", 65000, 184), ("l", "local", 1, 1), ("u", "api", 5, 5), ("x", "local", 5, 5), ("x", None, 5, 5)],
        "model_id string, provider string, prompt_tokens int, completion_tokens int",
    )
    prices = spark.createDataFrame([("m", Decimal("0.00015"), Decimal("0.0006"), "list", "2026")], schemas.PRICES)
    got = {r.model_id: r.cost_per_1000 for r in co.cost_per_1000(llm, prices).collect()}
    assert got == {"m": Decimal("9.860000"), "l": Decimal(0), "u": None, "x": None}


def test_scoring_differs_from_checking(spark):
    cols = "text string, " + ", ".join(f"gt_{f} string" for f in ("alcohol_content", "applicant_name_address", "brand_name", "class_type_designation", "net_contents"))
    df = spark.createDataFrame(
        [("Old Tom Distilery 45%", "45%", None, "Old Tom Distillery", "Vodka", "750 ml"), (" ", "45%", None, "x", "y", "z")], cols
    )
    rows = sc.score_fields(df, "text").collect()
    first = {s.field_key: s.match_status for s in rows[0].scores}
    assert first == {
        "alcohol_content": "MATCH", "applicant_name_address": "UNVERIFIABLE", "brand_name": "MATCH",
        "class_type_designation": "MISMATCH", "net_contents": "MISSING",
    }
    assert {s.match_status for s in rows[1].scores} == {"MISSING", "UNVERIFIABLE"}


def test_flag_best_ties_and_nulls(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", 0.5), ("c", None)], "k string, r double")
    assert {r.k: r.is_best for r in rp.flag_best(df, "r", ("k",)).collect()} == {"a": True, "b": False, "c": False}
    assert rp.flag_best(df.filter("r is null"), "r", ("k",)).collect()[0].is_best is False


def test_mint_keys_uses_the_lowest_free_numbers(spark, monkeypatch):
    monkeypatch.setattr(fs, "RANK_SLICE", 2)
    new = spark.createDataFrame([(i, "S") for i in range(6)] + [(9, " ")], "n bigint, ttb_id string")
    taken = spark.createDataFrame([("S-ENQ2",), ("S-ENQ3",), ("S-ENQ7",), ("S-ENQ02",), ("T-ENQ1",)], "ttb_id string")
    got = {r.n: r.ttb_id for r in fs.mint_keys(new, taken, "n").collect()}
    assert [got[i] for i in range(6)] == [f"S-ENQ{n}" for n in (1, 4, 5, 6, 8, 9)]
    assert got[9] == "ENQUEUED-ENQ1"


def test_manifest(spark):
    rows = [
        ("a", '[{"filename": "x", "position": 2}]'), ("b", "[{"), ("c", '{"filename": "x"}'), ("d", '[{"role": "BACK"}]'),
        ("e", json.dumps([{"filename": str(i)} for i in range(11)])), ("f", None), ("g", '["x"]'),
    ]
    good, bad = fs.explode_manifest(spark.createDataFrame(rows, "ttb_id string, images string"))
    assert [(r.ttb_id, r.filename, r.position) for r in good.collect()] == [("a", "x", 2)]
    assert {r.ttb_id for r in bad.collect()} == {"b", "c", "d", "e", "g"}


def test_sidecars(spark, tmp_path):
    record = {"ttb_id": "1", "product_type": "Wine", "images": [{"file": "a.jpg", "role": "Back"}]}
    files = {
        "1.json": json.dumps(record), "2.json": "{broken", "3.json": "[]", "4.json": json.dumps({**record, "product_type": "tea"}),
        "5.json": json.dumps({**record, "images": [{"file": "gone.jpg"}]}), "harvest_metadata.json": "{}",
    }
    for name, body in files.items():
        (tmp_path / name).write_text(body)
    listing = spark.createDataFrame([("a.jpg",)], "file string")
    good, bad = fs.read_sidecars(spark, str(tmp_path), listing)
    assert [(r.ttb_id, r.has_back) for r in good.collect()] == [("1", True)] and bad.count() == 2


def test_class_cleaning(spark):
    cases = {"TABLE RED WINE": "Red Wine", "VODKA 80-89 PROOF FB": "Vodka", "RUM FLAVORED": "Flavored Rum", "DESSERT /PORT/SHERRY WINE (COOKING)": "Dessert Wine"}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(cl.clean_class("c")).collect()] == list(cases.values())


def test_upsert_keeps_unnamed_columns(spark):
    target = spark.createDataFrame([(1, "a", "x", 1)], "k int, t string, n string, ts int")
    updates = spark.createDataFrame([(1, None, 5), (1, "c", 3), (2, "d", 4)], "k int, t string, ts int")
    got = {r.k: (r.t, r.n, r.ts) for r in ky.upsert(target, updates, "k", "ts").collect()}
    assert got == {1: ("c", "x", 5), 2: ("d", None, 4)}


def events_frame(spark):
    rng = random.Random(2)
    kinds = [("SEEDED", "RECEIVED"), ("OCR_STARTED", "PROCESSING"), ("READY", "READY_FOR_REVIEW"), ("OPENED", "IN_REVIEW"),
             ("DECIDED", "DECIDED"), ("UNDONE", "READY_FOR_REVIEW"), ("ANALYSIS_COMPLETED", None), ("ODD", None)]
    rows = [(rng.randint(1, 5), i, 1_700_000_000 + i * 60, *rng.choice(kinds)) for i in range(400)]
    df = spark.createDataFrame(rows, "submission_id bigint, event_id bigint, t bigint, event_type string, to_status string")
    return df.select("submission_id", "event_id", F.timestamp_seconds("t").alias("occurred_at"), "event_type", "to_status")


def test_lifecycle_slices_and_stream_agree(spark):
    events = events_frame(spark)
    shape = lambda df: sorted((r.event_id, r.accepted, r.from_status or "") for r in df.collect())
    whole = shape(lc.lifecycle(events))
    assert shape(lc.lifecycle(events, slice_rows=50)) == whole
    path = work_dir(spark, "events")
    events.coalesce(1).write.parquet(path)
    out = si.run_to_end(lifecycle_stream(si.read_files(spark, path, events.schema)), work_dir(spark, "out"))
    assert shape(spark.read.parquet(out)) == whole


def test_stuck_submissions_are_rescued_on_the_stream(spark):
    rows = [
        [(1, 1, 0, "SEEDED", "RECEIVED"), (1, 2, 60, "OCR_STARTED", "PROCESSING")],
        [(2, 3, 86_400, "SEEDED", "RECEIVED")],
        [(3, 4, 90_000, "SEEDED", "RECEIVED")],
    ]
    path = work_dir(spark, "stuck")
    schema = None
    for batch in rows:
        df = spark.createDataFrame(batch, "submission_id bigint, event_id bigint, t bigint, event_type string, to_status string")
        df = df.select("submission_id", "event_id", F.timestamp_seconds(F.col("t") + 1_700_000_000).alias("occurred_at"), "event_type", "to_status")
        df.coalesce(1).write.mode("append").parquet(path)
        schema = df.schema
        time.sleep(1.1)  # files are read in the order of their times
    source = si.read_files(spark, path, schema, files_per_trigger=1)
    out = si.run_to_end(lifecycle_stream(source, delay="1 minute", rescue_after_ms=3_600_000), work_dir(spark, "rescued"))
    got = spark.read.parquet(out).filter("event_id = -1").collect()
    assert [(r.submission_id, r.from_status, r.to_status) for r in got] == [(1, "PROCESSING", "READY_FOR_REVIEW")]


def test_rules_fold_a_text_once(spark):
    """No expression of the executor folds a submission's text again for each of its readers."""
    subs, ocr, llm = frames(spark)
    plan = engine.verdicts_of(engine.run_rules(subs, ocr, llm, method="levenshtein"))._jdf.queryExecution().optimizedPlan()
    nodes = [plan]
    for node in nodes:
        children = node.children()
        nodes += [children.apply(i) for i in range(children.length())]
    lines = [node.simpleString(1_000_000) for node in nodes]
    assert all("levenshtein(" not in line or line.count("regexp_replace(text") == 0 for line in lines)
    assert max(line.count("rtrim(lower(trim(") for line in lines) <= 8


def test_json_members_are_read_as_one_by_one(spark):
    from concordat.functions.jsonfields import json_scalar, json_scalars

    bodies = ['{"a": "x", "b": 1.50, "a": "y"}', '{"a": [1], "b": "2"}', "not json", '{"a": null}', "[]", None, '{"a": 1} x', '{"a": " ", "b": 12345678901234567890123}']
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    both = df.select("id", json_scalars("body", ("a", "b"), ("b",)).alias("s")).select("id", "s.a", "s.b")
    single = df.select("id", json_scalar("body", "a").alias("a"), json_scalar("body", "b", numbers=False).alias("b"))
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, single.collect()))
    assert [r.a for r in both.sort("id").collect()] == ["y", None, None, None, None, None, None, None]


def test_repeated_lines_change_no_nearest_measure(spark):
    from concordat.functions.measures import measures_by_line
    from concordat.functions.text import distinct_lines

    text = "net 1,500\n750 ml | 12%\r\n750 ml | 12%\n5 l\n750 ml | 12%\n5 l,\n1,000"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    rows = df.select(F.array_distinct(measures_by_line("t")).alias("a"), F.array_distinct(measures_by_line(distinct_lines("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in rows) and len(rows[0].a) == 3


def test_repeated_readings_are_scored_once_and_all_kept(spark, monkeypatch):
    rows = [("e", "Old Tom 750 ml", "Old Tom", "750 ml")] * 3 + [("f", "Old Tom 750 ml", "Old Tom", "750 ml"), ("f", None, "Old Tom", None), ("f", None, "Old Tom", None), ("e", "Old Tim", None, None)]
    df = spark.createDataFrame(rows, "engine string, t string, gt_brand_name string, gt_net_contents string")
    for f in ("alcohol_content", "class_type_designation", "applicant_name_address", "government_warning"):
        df = df.withColumn(f"gt_{f}", F.lit(None).cast("string"))
    seen = []
    score = sc.score_fields
    monkeypatch.setattr(sc, "score_fields", lambda rows, *a, **b: seen.append(rows.count()) or score(rows, *a, **b))
    got = [(r.engine, {s.field_key: s.match_status for s in r.scores}["brand_name"], r.statement.present) for r in sc.score_readings(df, "t", ("engine",), False).collect()]
    assert seen == [3]
    assert sorted(got) == sorted([("e", "MATCH", True)] * 3 + [("f", "MATCH", True)] + [("f", "MISSING", False)] * 2 + [("e", "UNVERIFIABLE", True)])
