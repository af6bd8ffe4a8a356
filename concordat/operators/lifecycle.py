"""The submission lifecycle as an ordered fold over its events."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from concordat import vocab
from concordat.functions.text import lookup

RESULT = (
    "submission_id bigint, event_id bigint, occurred_at timestamp, event_type string, "
    "from_status string, to_status string, accepted boolean, reason string"
)
_ORDER = {name: i for i, name in enumerate(vocab.STATUSES)}
_STATES = (None, *vocab.STATUSES)


def status_index(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return lookup(c, {s: str(i) for i, s in enumerate(vocab.STATUSES)}).cast("int")


def with_transitions(events: DataFrame, status: str = "to_status", key: str = "submission_id",
                     order: tuple[str, ...] = ("occurred_at", "id"), slice_rows: int = 1_000_000) -> DataFrame:
    """Adds the status before each event and whether the event moves forward.

    Events are cut into slices by the first column of ``order``, a time.  A row looks back inside
    its slice; the first row of a key in a slice takes the last status of the key's slice before.
    So a submission with most of the events is shared by as many tasks as it has slices.
    """
    cuts = _slices(events, slice_rows, order[0])
    # Rows without a time come first.
    df = events.withColumn("_slice", F.coalesce(_slice_of(cuts, order[0]), F.lit(0)))
    inside = W.partitionBy(key, "_slice").orderBy(*order)
    df = df.withColumns({"_before": F.lag(status).over(inside), "_first": F.row_number().over(inside) == 1})
    last = df.groupBy(key, "_slice").agg(F.max_by(status, F.struct(*order)).alias("_last"))
    carried = last.select(
        F.col(key).alias("_key"), F.col("_slice").alias("_of"), F.lag("_last").over(W.partitionBy(key).orderBy("_slice")).alias("_carried")
    )
    # NULL-safe, so that events without a key follow each other too.
    df = df.join(carried, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_of")))
    df = df.select(*events.columns, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_before")).alias("from_status"))
    now, before = status_index(status), status_index("from_status")
    return df.withColumn("is_forward", F.coalesce(now > before, F.col("from_status").isNull()))


def step(state: str | None, event_type: str, target: str | None) -> tuple[str | None, str | None]:
    """``(new state, reason)``; a reason means that the event is rejected."""
    if event_type not in vocab.EVENT_TYPES:
        return state, "unknown event"
    if target is not None and target not in _ORDER:
        return state, "unknown status"
    if state is None:
        return ("RECEIVED", None) if event_type == "SEEDED" else (None, "not found")
    if target is None:
        return state, None
    if event_type == "UNDONE":
        ok = state == "DECIDED" and target == "READY_FOR_REVIEW"
        return ("READY_FOR_REVIEW", None) if ok else (state, "not decided")
    if event_type == "DECIDED":
        return ("DECIDED", None) if state == "IN_REVIEW" else (state, "not open")
    if _ORDER[target] > _ORDER[state]:
        return target, None
    return state, "not forward"


def judge(state: str | None, event_type: str, target: str | None) -> tuple[str | None, str | None, str | None]:
    """``(new state, status shown as the event's target, reason)``."""
    new, reason = step(state, event_type, target)
    if reason is not None:
        return new, target, reason
    return new, None if target is None and state is not None else new, None


def _replay(pdf: pd.DataFrame, state: str | None) -> pd.DataFrame:
    pdf = pdf.sort_values(["occurred_at", "event_id"], kind="stable")
    before, reasons, after = [], [], []
    for kind, target in zip(pdf["event_type"], pdf["to_status"]):
        target = None if pd.isna(target) else target
        before.append(state)
        state, shown, reason = judge(state, kind, target)
        after.append(shown)
        reasons.append(reason)
    return pd.DataFrame(
        {
            "submission_id": pdf["submission_id"].to_numpy(),
            "event_id": pdf["event_id"].to_numpy(),
            "occurred_at": pdf["occurred_at"].to_numpy(),
            "event_type": pdf["event_type"].to_numpy(),
            "from_status": pd.Series(before, dtype="object"),
            "to_status": pd.Series(after, dtype="object"),
            "accepted": [r is None for r in reasons],
            "reason": pd.Series(reasons, dtype="object"),
        }
    )


def _micros(time: str = "occurred_at") -> Column:
    return F.unix_micros(F.col(time).cast("timestamp")).cast("double")


def _slices(events: DataFrame, slice_rows: int, time: str = "occurred_at") -> list:
    """Cut points in time so that a slice holds about ``slice_rows`` events."""
    wanted = max(1, events.count() // slice_rows)
    if wanted == 1:
        return []
    shares = [i / wanted for i in range(1, wanted)]
    micros = events.select(_micros(time).alias("t"))
    return sorted(set(micros.approxQuantile("t", shares, 0.1 / wanted)))


def _slice_of(cuts: list, time: str = "occurred_at") -> Column:
    """How many of the sorted ``cuts`` are not after the row's time; NULL without a time.

    A binary search, as there is a cut for every ``slice_rows`` events.
    """
    if not cuts:
        return F.when(F.col(time).isNotNull(), F.lit(0))
    ends = np.array(cuts)

    @F.pandas_udf("int")
    def place(micros: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, micros.to_numpy(), side="right"))

    return F.when(F.col(time).isNotNull(), place(_micros(time)))


def _in_order(rows: DataFrame, keys: list[str], order: list, fold: Callable, schema: str) -> DataFrame:
    """``fold`` over the batches of each task, whose rows come sorted by ``keys``, then by ``order``.

    All rows of a key are in one task, one key after the other, so a key costs no frame of its own.
    """
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(fold, schema)


_EXITS = "submission_id bigint, slice int, exits array<int>"
_ENTRIES = "submission_id bigint, slice int, entry string"


def _charts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each submission and slice the exit state of every entry state."""
    exits = functools.lru_cache(4096)(lambda kind, target: tuple(_STATES.index(step(s, kind, target)[0]) for s in _STATES))
    at, ends = None, None

    def rows(done: list) -> pa.RecordBatch:
        ids, slices, tables = zip(*done)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(slices, pa.int32()), pa.array(tables, pa.list_(pa.int32()))], ["submission_id", "slice", "exits"]
        )

    for batch in batches:
        done = []
        columns = (batch.column(c).to_pylist() for c in ("submission_id", "slice", "event_type", "to_status"))
        for submission, slice_, kind, target in zip(*columns):
            moves = exits(kind, target)
            if (submission, slice_) == at:
                ends = [moves[s] for s in ends]
            else:
                if at is not None:
                    done.append((*at, ends))
                at, ends = (submission, slice_), list(moves)
        if done:
            yield rows(done)
    if at is not None:
        yield rows([(*at, ends)])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each submission enters each of its slices."""
    at, state = (), 0
    for batch in batches:
        entries = []
        for submission, exits in zip(batch.column("submission_id").to_pylist(), batch.column("exits").to_pylist()):
            if (submission,) != at:
                at, state = (submission,), 0
            entries.append(_STATES[state])
            state = exits[state]
        yield pa.RecordBatch.from_arrays([batch.column("submission_id"), batch.column("slice"), pa.array(entries, pa.string())], ["submission_id", "slice", "entry"])


def _replay_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events judged in order; a row with ``is_entry`` sets the state that its slice is entered in."""
    judged = functools.lru_cache(4096)(judge)
    at, state = (), None
    for batch in batches:
        before, after, reasons = [], [], []
        columns = (batch.column(c).to_pylist() for c in ("submission_id", "slice", "is_entry", "event_type", "to_status"))
        for submission, slice_, is_entry, kind, target in zip(*columns):
            if (submission, slice_) != at:
                at, state = (submission, slice_), None
            if is_entry:
                state = target
                continue
            before.append(state)
            state, shown, reason = judged(state, kind, target)
            after.append(shown)
            reasons.append(reason)
        events = batch.filter(pa.compute.invert(batch.column("is_entry")))
        if events.num_rows:
            text = lambda values: pa.array(values, pa.string())
            kept = [events.column(c) for c in ("submission_id", "event_id", "occurred_at", "event_type")]
            yield pa.RecordBatch.from_arrays(
                [*kept, text(before), text(after), pa.array([r is None for r in reasons], pa.bool_()), text(reasons)],
                ["submission_id", "event_id", "occurred_at", "event_type", "from_status", "to_status", "accepted", "reason"],
            )


def lifecycle(events: DataFrame, slice_rows: int = 1_000_000) -> DataFrame:
    """Every event with the state it met and whether it was accepted.

    ``events``: ``submission_id, event_id, occurred_at, event_type, to_status``.

    A rejected event leaves the state alone, so the fold needs the true previous
    state, not the previous row.  The events are cut into time slices; what one task must hold
    together is one submission in one slice, whatever share of all events that submission has.
    A first pass reduces each of them to a table from any entry state to its exit state; those
    tables chain per submission; a second pass replays the events from the then known entry
    states.  All passes run along sorted rows.
    """
    e = events.select(
        F.col("submission_id").cast("bigint").alias("submission_id"), F.col("event_id").cast("bigint").alias("event_id"),
        F.col("occurred_at").cast("timestamp").alias("occurred_at"), "event_type", "to_status",
    )
    cuts = _slices(e, slice_rows)
    # Rows without a time come last.
    e = e.withColumns({"slice": F.coalesce(_slice_of(cuts), F.lit(len(cuts))), "is_entry": F.lit(False)})
    keys, order = ["submission_id", "slice"], [F.col("occurred_at").asc_nulls_last(), F.col("event_id").asc_nulls_last()]
    if cuts:
        charts = _in_order(e.drop("is_entry"), keys, order, _charts, _EXITS)
        entries = _in_order(charts, ["submission_id"], ["slice"], _chain, _ENTRIES)
        e = e.unionByName(entries.select(*keys, F.col("entry").alias("to_status"), F.lit(True).alias("is_entry")), allowMissingColumns=True)
    return _in_order(e, keys, [F.col("is_entry").desc(), *order], _replay_sorted, RESULT)


def audit_rows(folded: DataFrame) -> DataFrame:
    """Accepted events as audit rows with their from and to status."""
    moved = F.col("to_status").isNotNull()
    return folded.filter("accepted").select(
        "submission_id", "event_id", "occurred_at", "event_type",
        F.when(moved, F.col("from_status")).alias("from_status"), "to_status",
    )


def current_status(folded: DataFrame) -> DataFrame:
    moved = folded.filter(F.col("accepted") & F.col("to_status").isNotNull())
    return moved.groupBy("submission_id").agg(
        F.max_by("to_status", F.struct("occurred_at", "event_id")).alias("status")
    )


def stuck(events: DataFrame, timeout: str, now: Column | None = None) -> DataFrame:
    """Submissions whose last event left them in PROCESSING for longer than
    ``timeout``, with the rescue row to append."""
    moved = F.when(F.col("to_status").isNotNull(), F.struct("occurred_at", "event_id"))
    last = events.groupBy("submission_id").agg(
        F.max_by("to_status", moved).alias("status"),
        F.max("occurred_at").alias("since"),
    )
    clock = F.current_timestamp() if now is None else now
    late = last.filter(
        (F.col("status") == "PROCESSING") & (F.col("since") + F.expr(f"interval {timeout}") <= clock)
    )
    return late.select(
        "submission_id", F.lit("READY").alias("event_type"), F.lit("PROCESSING").alias("from_status"),
        F.lit("READY_FOR_REVIEW").alias("to_status"), F.lit("finalized after worker failure").alias("note"), "since",
    )


def collect_errors(stages: DataFrame, key: str = "submission_id", order: str = "stage_no") -> DataFrame:
    """Stage failures of a submission as one note; NULL where all went well.

    The stages of one submission are few and fixed, so the list stays short.
    """
    failed = F.when(
        F.col("error").isNotNull(),
        F.struct(F.col(order).alias("o"), F.concat(F.lit("stage="), F.col("stage"), F.lit(" failed: "), F.col("error")).alias("t")),
    )
    notes = F.transform(F.array_sort(F.collect_list(failed)), lambda x: x["t"])
    return stages.groupBy(key).agg(F.nullif(F.array_join(notes, "; "), F.lit("")).alias("note"))


def time_to_decision(events: DataFrame) -> DataFrame:
    """Seconds from the first intake to the last decision of each submission."""
    t = F.col("occurred_at")
    out = events.groupBy("submission_id").agg(
        F.min(F.when(F.col("event_type") == "SEEDED", t)).alias("submitted_at"),
        F.max(F.when(F.col("event_type") == "DECIDED", t)).alias("decided_at"),
    )
    return out.withColumn(
        "seconds", (F.unix_micros("decided_at") - F.unix_micros("submitted_at")) / 1e6
    )
