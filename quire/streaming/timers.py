"""Streams that keep state by key with timers: events are answered in the order of their times, whatever order they come in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quire.streaming.stateful import Batches

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "key long, event long, ok boolean"

#: (until, at, marks) to (until, ok): what an event changes and how it is answered; until is 0 while nothing is kept.
Step = Callable[[int, int, bool], tuple[int, bool]]


def revocation(ttl: int) -> Step:
    """An event that marks revokes its key for `ttl` milliseconds; ok: the key is revoked as the event comes."""

    def step(until: int, at: int, marks: bool) -> tuple[int, bool]:
        until = max(until, at + ttl) if marks else until
        return until, at < until

    return step


def in_flight(ttl: int) -> Step:
    """A request is let through (ok) unless one of its key was, less than `ttl` milliseconds before; marks play no part."""
    return lambda until, at, marks: (until, False) if at < until else (at + ttl, True)


class InOrder(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then answers them in order of (time, event).

    A timer stands at the key's next waiting event or, if none waits, where what it keeps runs out; then it is forgotten,
    so a key that is idle takes no room. An event that comes after the watermark has passed its time is dropped by Spark.
    """

    def __init__(self, step: Step):
        self.step = step

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event long, marks boolean")
        self.kept = handle.getValueState("kept", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        values = [v for new in rows for v in zip(new["ms"].tolist(), new["event"].tolist(), new["marks"].tolist(), strict=True)]
        self.waiting.appendList(values)
        self.handle.registerTimer(min(v[0] for v in values))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get())
        due = [r for r in rows if r[0] <= now]
        before = self.kept.get()  # each call of the state is a round trip, so none is asked for twice
        until = before[0] if before else 0
        events, found = [], []
        for at, event, marks in due:
            until, ok = self.step(until, at, marks)
            events.append(event)
            found.append(ok)
        if due:
            rest = rows[len(due) :]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0])
            else:
                self.waiting.clear()
        if until > now:
            self.kept.update((until,))
            self.handle.registerTimer(until)
        elif before:
            self.kept.clear()
        if events:
            yield pd.DataFrame({"key": pd.Series(key[0], range(len(events)), "int64"), "event": events, "ok": found})


def answered(events: DataFrame, key: str, time: str, event: str, marks, step: Step, late: str) -> Batches:
    """(key, event, ok) of a stream of events, each once the watermark, `late` behind the newest event, has passed it.

    Null keys and times have no answer. State lies in the query's checkpoint, so a stream that is started again goes on where
    it was; rows come in any order of files and batches, as long as none is later than `late`.
    """
    spark = events.sparkSession
    rows = events.select(F.col(key).cast("long").alias("key"), F.col(time).cast("timestamp").alias("at"), F.col(event).cast("long").alias("event"), F.coalesce(marks, F.lit(False)).alias("marks"))
    rows = rows.filter("key IS NOT NULL AND at IS NOT NULL").withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    found = rows.groupBy("key").transformWithStateInPandas(InOrder(step), ANSWER, "Append", "eventTime")
    return Batches(found, lambda batch, number, folder: batch, found.schema, {PROVIDER: ROCKS})
