"""Reading activity as streams: windowed counts under a watermark, and learner status as keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = "lexeme long, status string, encounters long, lookups long"
_STATE = "status string, encounters long, lookups long"


def activity(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n) per tumbling window. On a stream give `late`, the watermark: rows later than that
    are left out, and state older than it is dropped."""
    if late:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, n) of runs of events with no gap of `gap` or more."""
    if late:
        events = events.withWatermark("ts", late)
    s = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream without repeated event ids within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def advance(status: str | None, encounters: int, lookups: int, kind: str, promote_after: int) -> tuple[str, int, int]:
    """One event's transition; the batch form is operators.learner.word_status."""
    if kind == "read":
        encounters += 1
        if status is None:
            return "new", encounters, lookups
        if promote_after and status != "known" and encounters - 2 * lookups >= promote_after:
            status = "known"
    else:
        lookups += 1
        status = {None: "seen", "new": "seen", "known": "recognizing"}.get(status, status)
    return status, encounters, lookups


def status_stream(events: DataFrame, promote_after: int = 6) -> DataFrame:
    """Learner status per lexeme of a stream (lexeme, at, event_id, kind), updated with every micro-batch.

    Events of a batch are applied in their order; a batch must not hold events older than the one before."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, enc, looks = state.get if state.exists else (None, 0, 0)
        for kind in pd.concat(list(frames)).sort_values(["at", "event_id"])["kind"]:
            status, enc, looks = advance(status, enc, looks, kind, promote_after)
        state.update((status, enc, looks))
        yield pd.DataFrame([(key[0], status, enc, looks)], columns=["lexeme", "status", "encounters", "lookups"])

    return events.groupBy("lexeme").applyInPandasWithState(fold, STATUS, _STATE, "update", "NoTimeout")


_LATE_STATE = "status string, encounters long, lookups long, pending string"


def ordered_status_stream(events: DataFrame, late: str | None = "1 hour", promote_after: int = 6) -> DataFrame:
    """Learner status per lexeme of a stream (lexeme, at, event_id, kind) whose events come up to `late` out of order; None for
    a stream that has its watermark already, such as that of `once`.

    An event waits in its lexeme's state until the watermark has passed it, and is then applied in the order of (at, event_id),
    so that the result is the batch result whatever the order of arrival. A timer in event time wakes a lexeme that gets no more
    events. What waits is bounded by the events of one lexeme within `late`; events older than the watermark are left out."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, enc, looks, held = state.get if state.exists else (None, 0, 0, "[]")
        passed = state.getCurrentWatermarkMs()
        pending = [tuple(x) for x in json.loads(held)]
        for frame in frames:
            pending += [(int(at), int(i), kind) for at, i, kind in zip(frame["at_ms"], frame["event_id"], frame["kind"], strict=True)]
        pending.sort()
        ready = [x for x in pending if x[0] <= passed]
        for _, _, kind in ready:
            status, enc, looks = advance(status, enc, looks, kind, promote_after)
        pending = pending[len(ready) :]
        state.update((status, enc, looks, json.dumps(pending)))
        if pending:
            state.setTimeoutTimestamp(max(pending[0][0], passed + 1))
        if ready:
            yield pd.DataFrame([(key[0], status, enc, looks)], columns=["lexeme", "status", "encounters", "lookups"])

    timed = (events.withWatermark("at", late) if late else events).select("lexeme", "at", F.unix_millis("at").alias("at_ms"), "event_id", "kind")
    return timed.groupBy("lexeme").applyInPandasWithState(fold, STATUS, _LATE_STATE, "update", "EventTimeTimeout")
