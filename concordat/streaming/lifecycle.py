"""The lifecycle state machine on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from concordat.operators.lifecycle import RESULT, _replay, step

RESCUE_NOTE = "finalized after worker failure"


def lifecycle_stream(events: DataFrame, delay: str | None = None, rescue_after_ms: int | None = None) -> DataFrame:
    """Every event with the state it met and whether it was accepted.

    The state of a submission is its status.  A batch is replayed in event
    order; an event that arrives in a later batch than its successor is judged
    against the later state.  With ``rescue_after_ms``, a submission that stays
    in PROCESSING for that long in event time is finished by a synthetic row.
    """
    timed = rescue_after_ms is not None
    source = events.withWatermark("occurred_at", delay) if delay else events

    def fold(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, since = state.get
            if status == "PROCESSING":
                at = pd.Timestamp(since + rescue_after_ms, unit="ms")
                yield _replay(
                    pd.DataFrame(
                        {"submission_id": [key[0]], "event_id": [-1], "occurred_at": [at],
                         "event_type": ["READY"], "to_status": ["READY_FOR_REVIEW"]}
                    ),
                    status,
                )
                state.update(("READY_FOR_REVIEW", since + rescue_after_ms))
            return
        rows = pd.concat(list(batches))
        status, since = state.get if state.exists else (None, 0)
        done = _replay(rows, status)
        for kind, target in zip(done["event_type"][done["accepted"]], done["to_status"][done["accepted"]]):
            status = step(status, kind, None if pd.isna(target) else target)[0]
        since = max(since, int(done["occurred_at"].max().timestamp() * 1000))
        state.update((status, since))
        if timed and status == "PROCESSING":
            state.setTimeoutTimestamp(since + rescue_after_ms)
        yield done

    return source.groupBy("submission_id").applyInPandasWithState(
        fold,
        RESULT,
        "status string, since bigint",
        "append",
        GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout,
    )
