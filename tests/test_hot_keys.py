"""Jobs whose rows lie on one key: the same results, in parts of a bounded size."""

import random

import pytest
from pyspark.sql import functions as F

MARKS = ".,;:!?…'\" "


@pytest.mark.parametrize("size", [1000, 8])
def test_positions_in_blocks(spark, monkeypatch, size):
    """Nine of ten readings belong to one submission; needles reach over readings and blocks."""
    from concordat.operators import blocks as bl

    monkeypatch.setattr(bl, "BLOCK_READINGS", size)
    r = random.Random(size)
    pieces = ["Old Tom", "GIN.", "12 %", "x", "Straße!", "a, b", "tom  gin", "é."]
    rows = [(0 if i % 10 else 1 + i % 3, i // 2, i % 2, r.choice(pieces)) for i in range(400)]
    joined = {}
    for key, *_, text in sorted(rows):
        joined.setdefault(key, []).append(" ".join(text.split()).casefold())
    joined = {k: " ".join(v).rstrip(MARKS) for k, v in joined.items()}
    needles = ["tom gin", "gin. old", "x x", "strasse", "é. x", "absent", "", "x", "12 % 12 %"]
    wanted = [(k, n) for k in range(5) for n in needles]
    df = spark.createDataFrame(rows, "submission_id long, id long, part int, extracted_text string")
    blocks = bl.text_blocks(df, 16, ties=("part",))
    out = bl.positions(blocks, spark.createDataFrame(wanted, "submission_id long, needle string"), key="submission_id").collect()
    want = set()
    for k, n in wanted:
        text = joined.get(k, "")
        want.add((k, n, text.index(n) + 1 if n and n in text else None))
    assert {(x.submission_id, x.needle, x.first) for x in out} == want and len(out) == len(wanted)
    assert blocks.agg(F.max(F.length("text"))).first()[0] <= size * 9
    with pytest.raises(ValueError):
        bl.text_blocks(df, 2 * size + 1)


def test_transitions_of_one_submission_in_slices(spark):
    from concordat.operators import lifecycle as lc

    r = random.Random(3)
    states = ["RECEIVED", "PROCESSING", "READY_FOR_REVIEW", None]
    keys = [7] * 18 + [8, None]
    rows = [(r.choice(keys), i, f"2024-01-{1 + i % 28:02d} 00:00:{i % 60:02d}", r.choice(states)) for i in range(600)]
    df = spark.createDataFrame(rows, "submission_id long, id long, at string, to_status string").withColumn("occurred_at", F.to_timestamp("at"))
    whole = sorted(map(str, lc.with_transitions(df).collect()))
    sliced = lc.with_transitions(df, slice_rows=40)
    assert sorted(map(str, sliced.collect())) == whole
    last = {}
    for key, i, at, status in sorted(rows, key=lambda x: (x[2], x[1])):
        last.setdefault(key, []).append((i, status))
    want = {i: before for events in last.values() for (_, before), (i, _) in zip([(None, None), *events], events)}
    assert {x.id: x.from_status for x in sliced.collect()} == want


def test_slices_are_found_by_search(spark):
    """A row does not look at every cut: there are as many cuts as there are slices."""
    from concordat.operators import lifecycle as lc

    cuts = [float(c) for c in range(1_000_000, 900_000_000, 300_000)]
    df = spark.createDataFrame([(0,), (1,), (2,), (899,), (None,)], "s long").withColumn("at", F.timestamp_seconds("s"))
    placed = df.select("s", lc._slice_of(cuts, "at").alias("n"))
    assert {r.s: r.n for r in placed.collect()} == {s: None if s is None else sum(c <= s * 1e6 for c in cuts) for s in (0, 1, 2, 899, None)}
    assert {r.n for r in df.select(lc._slice_of([], "at").alias("n")).collect()} == {0, None}
    plan = lc.with_transitions(df.selectExpr("s submission_id", "s id", "at occurred_at", "'READY' to_status"), slice_rows=1)._jdf.queryExecution().toString()
    assert "lambdafunction" not in plan


def test_lifecycle_folds_along_sorted_rows(spark):
    """No frame per submission and slice; events without a time or a submission are folded as well."""
    from concordat.operators import lifecycle as lc

    r = random.Random(5)
    kinds = [("SEEDED", "RECEIVED"), ("OCR_STARTED", "PROCESSING"), ("READY", "READY_FOR_REVIEW"), ("OPENED", "IN_REVIEW"), ("DECIDED", "DECIDED"),
             ("UNDONE", "READY_FOR_REVIEW"), ("BROKEN", None), ("ANALYSIS_COMPLETED", None)]
    rows = [(r.choice([2**53 + 1, 2**53 + 2, None]), i, r.choice([None, *range(40)]), *r.choice(kinds)) for i in range(400)]
    df = spark.createDataFrame(rows, "submission_id long, event_id long, s long, event_type string, to_status string").withColumn("occurred_at", F.timestamp_seconds("s"))
    want, state = {}, {}
    for key, i, at, kind, target in sorted(rows, key=lambda x: (x[2] is None, x[2], x[1])):
        before = state.get(key)
        state[key], _, reason = lc.judge(before, kind, target)
        want[i] = (key, before, reason)
    for size in (1_000_000, 20, 1):
        out = lc.lifecycle(df, slice_rows=size)
        assert {x.event_id: (x.submission_id, x.from_status, x.reason) for x in out.collect()} == want
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()


def test_rows_without_a_key_are_dealt_evenly(spark):
    from concordat.operators import cards, quality
    from concordat.operators.joins import left_join_spread

    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for k, v in zip(saved, ("-1", "false", "16")):
        spark.conf.set(k, v)
    try:
        # Nine of ten rows have no key.
        rows = spark.range(20_000).select(F.col("id").alias("n"), F.when(F.col("id") % 10 == 0, F.col("id") % 400).alias("k"))
        right = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        joined = left_join_spread(rows, right, "k")
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * 20_000 / 16
        want = {(r.n, r.k, 2 * r.k if r.k is not None and r.k < 300 else None) for r in rows.collect()}
        assert {(r.n, r.k, r.v) for r in joined.collect()} == want and joined.columns == ["k", "n", "v"]
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)
    parents = spark.createDataFrame([(1,), (1,), (2,)], "p long")
    children = spark.createDataFrame([(1, 1), (2, 3), (3, None), (3, None)], "id long, p long")
    assert sorted(map(tuple, quality.set_null(children, parents, "p", "p").collect()), key=str) == [(1, 1), (2, None), (3, None), (3, None)]
    cmp = spark.createDataFrame([(1, 5, None), (2, None, 6), (3, None, None), (4, 9, None)], "id long, source_ocr_result_id long, source_llm_result_id long")
    ocr, llm = spark.createDataFrame([(5, "e")], "id long, engine_name string"), spark.createDataFrame([(6, "m")], "id long, model_id string")
    assert {r.id: r.extracted_source for r in cards.comparison_view(cmp, ocr, llm).collect()} == {1: "ocr:e", 2: "llm:m", 3: None, 4: None}
