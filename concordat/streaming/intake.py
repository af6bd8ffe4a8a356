"""Streaming intake, claims, audit trail and serving views."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concordat.operators.queue import READY
from concordat.plans.engine import run_rules
from concordat.rules import RULES, Rule


def read_files(
    spark: SparkSession, directory: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 8
) -> DataFrame:
    """A stream over the Parquet files that arrive in a folder."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(directory)
    )


def run_to_end(
    stream: DataFrame, out: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None,
    progress: str | None = None, store: str | None = None,
) -> str:
    """Process everything that is available, then stop.  Returns ``out``.

    ``store`` is the class of the state store that this stream needs, if not the session's.

    Progress and state are kept in ``progress``, by default beside ``out``, so a further run
    to the same output goes on where the last one ended.
    """
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", progress or f"{out.rstrip('/')}.progress")
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    try:
        if store:
            conf.set(key, store)
        query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(out)
        query.awaitTermination()
    finally:
        conf.set(key, before)
    return out


def batch_sink(out: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated batch replaces instead of doubling."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return write


#: The store for states that outgrow memory: it keeps them on disk, with Bloom filters before them.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_verify(
    stream: DataFrame, ocr: DataFrame, llm: DataFrame, out: str,
    rules: Sequence[Rule] = RULES, method: str = "sequence", ocr_order: Sequence[str] = ("id",),
) -> str:
    """Verify each arriving submission once ever; a batch is a bounded set of files.

    Ids are claimed in the stream's state: a batch looks up the ids that arrive in it, and neither
    reads nor counts what earlier batches have written.  A repeated batch meets the state as it was
    before, so it claims the same ids again and replaces its results.  The readings of a batch are
    cut down to its submissions before they are joined, and its results land as a whole.
    """
    sink = batch_sink(out)

    def verify(once: DataFrame, batch_id: int) -> None:
        # Which of equal ids is kept may not differ between the uses below.
        once = once.persist()
        keys = once.select(F.col("id").alias("submission_id"))
        judged = run_rules(
            once,
            ocr.join(keys, "submission_id", "left_semi"),
            llm.join(keys, "submission_id", "left_semi"),
            rules, method, ocr_order=ocr_order,
        )
        sink(judged, batch_id)
        once.unpersist()

    return run_to_end(stream.dropDuplicates(["id"]), out, each=verify, store=STORE)


def claim_once(stream: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """The first claim of each key within the watermark; later ones are dropped."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def append_audit(stream: DataFrame, out: str) -> str:
    return run_to_end(stream, out)


def throughput(events: DataFrame, width: str, delay: str, ts: str = "occurred_at", by: Sequence[str] = ()) -> DataFrame:
    """Events per tumbling window; on a stream, late rows beyond the delay drop."""
    df = events.withWatermark(ts, delay) if events.isStreaming else events
    return (
        df.groupBy(F.window(ts, width).alias("_w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("_w.start").alias("window_start"), *by, "n")
    )


#: What a change of the queue is: an id enters (1) or leaves (-1) the ready rows of its type.
CHANGE = "id bigint, beverage_type string, submitted bigint, sign int"
#: Width of a slice of submission times: 32 days.  Slice of rows without a time, which come first.
_SLICE = 32 * 86_400_000_000
_NO_TIME = -1_000_000
#: Files of a slice that a batch writes at most.
_FILES = 8
#: Low bits of an id within its block of state.
_BLOCK_BITS = 8


def ready_changes(stream: DataFrame) -> DataFrame:
    """Signed changes of the set of ready rows, from the newest row of every id.

    The state of an id is its ready row or none.  Ids that differ in their last bits only share a
    state, so that a group costs one call for many ids; a batch looks up the blocks of the ids that
    arrive in it, and a block never holds more than its ids.
    Of several rows of an id in a batch the one of the last ``updated_at`` counts, where rows have it.
    """
    updated = F.unix_micros(F.col("updated_at").cast("timestamp")) if "updated_at" in stream.columns else F.lit(0).cast("bigint")
    rows = stream.select(
        F.col("id").cast("bigint").alias("id"), "beverage_type", F.unix_micros(F.col("submitted_at").cast("timestamp")).alias("submitted"),
        F.coalesce(F.col("status") == READY, F.lit(False)).alias("ready"), updated.alias("updated"),
        F.shiftright(F.col("id").cast("bigint"), _BLOCK_BITS).alias("block"),
    )

    def follow(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Plain values cost far less than frames of a few rows.
        newest: dict = {}
        for pdf in batches:
            for i, *row in zip(*(pdf[c].tolist() for c in ("id", "updated", "beverage_type", "submitted", "ready"))):
                # The rows without an id are one block and one id.
                i, row = None if i != i else i, tuple(None if x is None or x != x else x for x in row)
                last = newest.get(i)
                if last is None or (row[0] is not None and (last[0] is None or row[0] >= last[0])):
                    newest[i] = row
        held = {i: (kind, at) for i, kind, at in zip(*state.get)} if state.exists else {}
        signed = []
        for i, (_, kind, at, ready) in newest.items():
            was, now = held.get(i), (kind, None if at is None else int(at)) if ready else None
            if was == now:
                continue
            signed += [(i, *row, sign) for row, sign in ((was, -1), (now, 1)) if row is not None]
            if now is None:
                del held[i]
            else:
                held[i] = now
        if not signed:
            return
        if held:
            state.update((list(held), [kind for kind, _ in held.values()], [at for _, at in held.values()]))
        else:
            state.remove()
        yield pd.DataFrame(signed, columns=["id", "beverage_type", "submitted", "sign"], dtype=object)

    return rows.groupBy("block").applyInPandasWithState(
        follow, CHANGE, "id array<bigint>, beverage_type array<string>, submitted array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def serve_queue(stream: DataFrame, table: str, out: str) -> str:
    """Refresh the waiting counts and next items after every batch.

    A batch adds its signed changes to running counts by type and slice of submission times, and
    to a log by slice in ``table``.  The next item of a type lies in the first slice that has a ready
    row, so of the log only those slices are read.  What a batch costs does not grow with the history; a
    repeated batch starts from the counts of the one before it and replaces what it wrote.
    """
    slices = F.coalesce(F.floor(F.col("submitted") / _SLICE), F.lit(_NO_TIME)).cast("bigint")

    def refresh(changes: DataFrame, batch_id: int) -> None:
        spark = changes.sparkSession
        changes = changes.withColumns({"slice": slices, "batch_id": F.lit(batch_id)}).persist()
        log = changes.select("id", "beverage_type", "submitted", "sign", "slice", "batch_id")
        log = log.repartition("slice", F.pmod(F.xxhash64("id"), F.lit(_FILES))).write.mode("overwrite")
        log.option("partitionOverwriteMode", "dynamic").partitionBy("slice", "batch_id").parquet(table)
        counts = changes.groupBy("beverage_type", "slice").agg(F.sum("sign").alias("n"))
        if batch_id:
            counts = counts.unionByName(spark.read.parquet(f"{out}/counts/batch_id={batch_id - 1}"))
        counts = counts.groupBy("beverage_type", "slice").agg(F.sum("n").alias("n")).filter("n <> 0")
        counts.write.mode("overwrite").parquet(f"{out}/counts/batch_id={batch_id}")
        changes.unpersist()

        counts = spark.read.schema("beverage_type string, slice bigint, n bigint").parquet(f"{out}/counts/batch_id={batch_id}")
        total = counts.cube("beverage_type").agg(F.sum("n").alias("waiting"), F.grouping("beverage_type").cast("int").alias("is_total"))
        total.write.mode("overwrite").parquet(f"{out}/waiting")
        heads = counts.groupBy("beverage_type").agg(F.min("slice").alias("slice"))
        wanted = sorted({r.slice for r in heads.collect()})  # one row per type
        if wanted:
            rows = spark.read.option("basePath", table).schema(f"{CHANGE}, slice bigint, batch_id bigint").parquet(*[f"{table}/slice={d}" for d in wanted])
            same = rows["beverage_type"].eqNullSafe(heads["beverage_type"]) & (rows["slice"] == heads["slice"])
            rows = rows.filter(F.col("batch_id") <= batch_id).join(F.broadcast(heads), same, "left_semi")
            ready = rows.groupBy("id", "beverage_type", "submitted").agg(F.sum("sign").alias("n")).filter("n > 0")
            first = ready.groupBy("beverage_type").agg(F.min(F.struct("submitted", "id")).alias("n"))
            first = first.select("beverage_type", "n.id", F.timestamp_micros("n.submitted").alias("submitted_at"))
        else:
            first = spark.createDataFrame([], "beverage_type string, id bigint, submitted_at timestamp")
        first.write.mode("overwrite").parquet(f"{out}/next")

    return run_to_end(ready_changes(stream), out, each=refresh)
