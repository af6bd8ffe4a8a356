"""The lifecycle on a stream in the order of event time, with rescue timers.

Events wait in a list state until the watermark has passed them and are then folded in order, so an
event that arrives up to the delay late is still judged where it belongs, in whichever batch it came.
One timer per submission is armed: for its earliest waiting event, or for the time at which it will
have been in PROCESSING for too long.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from concordat.operators.lifecycle import RESULT, _replay, step
from concordat.streaming.intake import STORE  # noqa: F401  the store that this stream needs

#: Event id of a rescue.
RESCUE = -1
#: Times are whole microseconds inside, so that no time zone has a say in what is due.
_OUT = RESULT.replace("occurred_at timestamp", "occurred_at bigint")
_COLUMNS = ["submission_id", "event_id", "occurred_at", "event_type", "to_status"]


class TimedLifecycle(StatefulProcessor):
    """State of a submission: its status, the time of its last event, its armed timer, what waits."""

    def __init__(self, rescue_after_ms: int):
        self.rescue_after_ms = rescue_after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "status string, since bigint, armed bigint")
        self.waiting = handle.getListState("waiting", "event_id bigint, micros bigint, event_type string, to_status string")

    def _get(self) -> tuple[str | None, int, int | None]:
        return self.place.get() if self.place.exists() else (None, 0, None)

    def _arm(self, due: int | None) -> int | None:
        """Leaves one timer, the one that is due first."""
        armed = self._get()[2]
        if armed is not None and armed != due:
            self.handle.deleteTimer(armed)
        if due is not None and armed != due:
            self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, since, armed = self._get()
        first = armed
        for pdf in rows:
            kinds, targets = (pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("event_type", "to_status"))
            # A chunk at a time: the list is never held whole here.
            self.waiting.appendList(list(zip(pdf["event_id"].tolist(), pdf["micros"].tolist(), kinds, targets)))
            due = int(pdf["micros"].min() // 1000)
            first = due if first is None else min(first, due)
        self.place.update((status, since, self._arm(first)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, since, armed = self._get()
        passed = timerValues.getCurrentWatermarkInMs()
        events = sorted(((m, i, k, t) for i, m, k, t in self.waiting.get()), key=lambda e: e[:2])
        ready = [e for e in events if e[0] // 1000 <= passed]
        left = events[len(ready) :]
        done = []
        for micros, event, kind, target in [*ready, (None, None, None, None)]:
            due = since + self.rescue_after_ms * 1000
            # An event at the very time comes before the rescue.
            if status == "PROCESSING" and (due < micros if micros is not None else due // 1000 <= passed and not (left and left[0][0] <= due)):
                done.append((RESCUE, due, "READY", "READY_FOR_REVIEW"))
                status, since = "READY_FOR_REVIEW", due
            if micros is not None:
                done.append((event, micros, kind, target))
                status, since = step(status, kind, target)[0], micros
        if done:
            ids, micros, kinds, targets = zip(*done)
            entry = self._get()[0]
            pdf = pd.DataFrame(dict(zip(_COLUMNS, ([key[0]] * len(done), ids, micros, kinds, targets))))
            out = _replay(pdf, entry)
        if ready:
            self.waiting.clear()
            if left:
                self.waiting.put([(i, m, k, t) for m, i, k, t in left])
        due = [e[0] // 1000 for e in left[:1]]
        if status == "PROCESSING":
            due.append((since + self.rescue_after_ms * 1000) // 1000)
        # The timer that has fired is gone.
        self.place.update((status, since, None))
        self.place.update((status, since, self._arm(max(min(due), passed + 1) if due else None)))
        return iter((out,) if done else ())

    def close(self) -> None:
        pass


def timed_lifecycle(events: DataFrame, delay: str, rescue_after_ms: int) -> DataFrame:
    """Every event with the state it met and whether it was accepted, and a row of event id -1 for
    every submission that was in PROCESSING for ``rescue_after_ms`` after its last event.

    Rows come once the watermark has passed them; later ones than ``delay`` are dropped by Spark.
    Run it with ``STORE`` (`run_to_end(..., store=STORE)`), which keeps lists and timers.
    """
    rows = events.select(*_COLUMNS, F.unix_micros("occurred_at").alias("micros")).withWatermark("occurred_at", delay)
    out = rows.groupBy("submission_id").transformWithStateInPandas(
        statefulProcessor=TimedLifecycle(rescue_after_ms), outputStructType=_OUT, outputMode="append", timeMode="eventTime"
    )
    return out.withColumn("occurred_at", F.timestamp_micros("occurred_at"))
