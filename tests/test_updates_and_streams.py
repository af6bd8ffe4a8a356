"""Keyed updates with NULLs and repeats, and streams that are run twice."""

from pyspark.sql import functions as F

from concordat.operators import keyed, report
from concordat.session import work_dir
from concordat.streaming import intake as si


def test_update_columns_clears_and_reduces_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "id long, s string, t string")
    updates = spark.createDataFrame(
        [(1, None, "q", 1, ["s"]), (2, "n", None, 1, ["s"]), (2, "m", None, 2, ["s", "t"]), (9, "k", "k", 1, ["s", "t"])],
        "id long, s string, t string, ts int, sets array<string>",
    )
    got = {r.id: (r.s, r.t) for r in keyed.update_columns(target, updates, "id", "ts", "sets").collect()}
    assert got == {1: (None, "x"), 2: ("m", None), 3: ("c", "z")}


def test_compare_and_swap_reports_a_request_without_a_time(spark):
    target = spark.createDataFrame([(1, "OPEN")], "id long, status string")
    requests = spark.createDataFrame([(1, None, 7)], "id long, requested_at timestamp, request_id long")
    new, outcome = keyed.compare_and_swap(target, requests, "id", "status", "OPEN", {"status": F.lit("DONE")})
    assert [r.status for r in new.collect()] == ["DONE"] and [r.won for r in outcome.collect()] == [True]


def test_report_join_matches_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, rate int")
    b = spark.createDataFrame([(None, 3), ("y", 4)], "k string, ms int")
    got = {(r.k, r.rate, r.ms) for r in report.report_join(a, b, ("k",)).collect()}
    assert got == {(None, 1, 3), ("x", 2, None), ("y", None, 4)}


def ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).select("id").collect())


def test_a_second_run_appends(spark):
    source, out = work_dir(spark, "source"), work_dir(spark, "out")
    frame = lambda *rows: spark.createDataFrame([(i,) for i in rows], "id long")
    frame(1, 2).write.parquet(source)
    si.append_audit(si.read_files(spark, source, frame(1).schema), out)
    frame(3).write.mode("append").parquet(source)
    si.append_audit(si.read_files(spark, source, frame(1).schema), out)
    assert ids(spark, out) == [1, 2, 3]


def test_batches_of_a_second_run_keep_those_of_the_first(spark):
    source, out = work_dir(spark, "source"), work_dir(spark, "out")
    frame = lambda *rows: spark.createDataFrame([(i,) for i in rows], "id long")
    frame(1, 2).write.parquet(source)
    si.run_to_end(si.read_files(spark, source, frame(1).schema), out, each=si.batch_sink(out))
    frame(3).write.mode("append").parquet(source)
    si.run_to_end(si.read_files(spark, source, frame(1).schema), out, each=si.batch_sink(out))
    assert ids(spark, out) == [1, 2, 3]


def test_queue_views_count_an_id_once(spark):
    source, rows, out = (work_dir(spark, n) for n in ("source", "rows", "out"))
    schema = "id long, beverage_type string, status string, submitted_at timestamp"

    def put(*values):
        df = spark.createDataFrame(values, schema)
        df.write.mode("append").parquet(source)
        si.serve_queue(si.read_files(spark, source, df.schema), rows, out)

    put((1, "WINE", "READY_FOR_REVIEW", None), (2, "WINE", "READY_FOR_REVIEW", None))
    assert [r.id for r in spark.read.parquet(f"{out}/next").collect()] == [1]
    put((1, "WINE", "DECIDED", None))
    assert [r.id for r in spark.read.parquet(f"{out}/next").collect()] == [2]


def test_queue_views_follow_changes_over_many_batches(spark):
    import random

    source, rows, out = (work_dir(spark, n) for n in ("source", "rows", "out"))
    schema = "id long, beverage_type string, status string, submitted_at timestamp, updated_at timestamp"
    r, current = random.Random(4), {}
    for batch in range(4):
        values = []
        for n in range(30):
            i = r.randrange(25)
            row = (i, r.choice(["WINE", "BEER", None]), r.choice(["READY_FOR_REVIEW", "READY_FOR_REVIEW", "DECIDED", None]), f"2024-01-0{r.randint(1, 4)} 0{r.randint(0, 9)}:00:00", f"2024-02-01 00:{batch:02d}:{n:02d}")
            values.append(row)
            current[i] = row
        r.shuffle(values)
        df = spark.createDataFrame(values, schema.replace("timestamp", "string"))
        df = df.withColumns({c: F.to_timestamp(c) for c in ("submitted_at", "updated_at")})
        df.write.mode("append").parquet(source)
        si.serve_queue(si.read_files(spark, source, df.schema), rows, out)
        ready = [x for x in current.values() if x[2] == "READY_FOR_REVIEW"]
        kinds = {x[1] for x in ready}
        want = {k: min((x[3], x[0]) for x in ready if x[1] == k) for k in kinds}
        assert {x.beverage_type: (str(x.submitted_at), x.id) for x in spark.read.parquet(f"{out}/next").collect()} == want
        counts = {(x.beverage_type, x.is_total): x.waiting for x in spark.read.parquet(f"{out}/waiting").collect()}
        assert counts == {(k, 0): sum(x[1] == k for x in ready) for k in kinds} | {(None, 1): len(ready)}


def test_timed_lifecycle_folds_late_events_in_order_and_rescues(spark):
    from concordat.streaming.timed import STORE, timed_lifecycle

    source, out = work_dir(spark, "source"), work_dir(spark, "out")
    schema = "submission_id long, event_id long, occurred_at timestamp, event_type string, to_status string"

    def put(*rows):
        df = spark.createDataFrame([(*r[:2], f"2024-01-01 {r[2]}", *r[3:]) for r in rows], schema.replace("timestamp", "string"))
        df = df.withColumn("occurred_at", F.to_timestamp("occurred_at"))
        df.write.mode("append").parquet(source)
        si.run_to_end(timed_lifecycle(si.read_files(spark, source, df.schema), "1 hour", 1_800_000), out, store=STORE)
        return sorted((r.submission_id, str(r.occurred_at)[11:], r.event_id, r.accepted, r.from_status) for r in spark.read.schema(df.schema.add("accepted", "boolean").add("from_status", "string")).parquet(out).collect())

    assert put((1, 1, "00:00:00", "SEEDED", "RECEIVED"), (1, 3, "00:10:00", "READY", "READY_FOR_REVIEW")) == []
    # Event 2 comes after its successor; submission 2 stays in PROCESSING until its timer fires.
    got = put(
        (1, 2, "00:05:00", "OCR_STARTED", "PROCESSING"), (2, 4, "00:00:00", "SEEDED", "RECEIVED"), (2, 5, "00:01:00", "OCR_STARTED", "PROCESSING"),
        (3, 6, "00:00:00", "SEEDED", "RECEIVED"), (3, 7, "00:20:00", "OCR_STARTED", "PROCESSING"), (3, 8, "00:50:00", "READY", "READY_FOR_REVIEW"), (9, 9, "02:00:00", "SEEDED", "RECEIVED"),
    )
    assert got == [
        (1, "00:00:00", 1, True, None), (1, "00:05:00", 2, True, "RECEIVED"), (1, "00:10:00", 3, True, "PROCESSING"),
        (2, "00:00:00", 4, True, None), (2, "00:01:00", 5, True, "RECEIVED"), (2, "00:31:00", -1, True, "PROCESSING"),
        (3, "00:00:00", 6, True, None), (3, "00:20:00", 7, True, "RECEIVED"), (3, "00:50:00", 8, True, "PROCESSING"),
    ]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_submissions_are_verified_once_ever(spark):
    source, out = work_dir(spark, "source"), work_dir(spark, "out")
    fields = ("brand_name", "class_type_designation", "alcohol_content", "net_contents", "applicant_name_address", "country_of_origin")
    schema = "id long, beverage_type string, source_of_product string, " + ", ".join(f"{f} string" for f in fields)
    row = lambda i, brand: (i, "WINE", "DOMESTIC", brand, "Table Wine", "12%", "750 ml", "Works", "France")
    ocr = spark.createDataFrame([(i, i, "OLD TOM 750 ml", 0.9, "OK") for i in range(6)], "submission_id long, id long, extracted_text string, confidence double, status string")
    llm = spark.createDataFrame([], "submission_id long, id long, task string, status string, is_benchmark_only boolean, result_text string")

    def put(*rows):
        df = spark.createDataFrame(list(rows), schema)
        df.write.mode("append").parquet(source)
        si.stream_verify(si.read_files(spark, source, df.schema), ocr, llm, out)
        return sorted((r.submission_id, r.batch_id) for r in spark.read.parquet(out).select("submission_id", "batch_id").collect())

    assert put(row(1, "Old Tom"), row(2, "Old Tom"), row(1, "Old Tom")) == [(1, 0), (2, 0)]
    # The first batch's results are not needed any more to know what is done.
    assert put(row(2, "Other"), row(3, "Old Tom")) == [(1, 0), (2, 0), (3, 1)]


def test_ids_of_a_block_share_a_state(spark):
    source, progress = work_dir(spark, "source"), work_dir(spark, "progress")
    schema = "id bigint, beverage_type string, status string, submitted_at timestamp"
    big = 2**60
    ids = [*range(-300, 1000), big, big + 1, None]
    spark.createDataFrame([(i, "WINE", "READY_FOR_REVIEW", None) for i in ids], schema).write.parquet(source)
    stream = si.ready_changes(si.read_files(spark, source, spark.read.parquet(source).schema))
    seen = []
    writer = stream.writeStream.option("checkpointLocation", progress).trigger(availableNow=True)
    query = writer.foreachBatch(lambda df, _: seen.extend((r.id, r.sign) for r in df.collect())).start()
    query.awaitTermination()
    assert sorted(seen, key=str) == sorted(((i, 1) for i in ids), key=str)
    assert sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress) <= 10
