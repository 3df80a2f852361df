"""The admission of requests.admit on a stream, with state for each client:
at once, in the order of arrival, or exactly, in the order of time."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def admit_stream(events: DataFrame, limit: int = 30, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(client, key, ts, admitted) from a stream (client string, key long, ts
    timestamp). State: the admitted times that may still count, at most `limit`
    for a client; it expires when the window has passed."""
    span = pd.Timedelta(seconds=seconds)

    def run(key: tuple[Any, ...], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = [pd.Timestamp(t, unit="us") for t in state.get[0]] if state.exists else []
        rows = pd.concat(list(parts)).sort_values(["ts", "key"])
        admitted = []
        for at in rows["ts"]:
            held = [t for t in held if t > at - span]
            admitted.append(len(held) < limit)
            if admitted[-1]:
                held.append(at)
        state.update(([int(t.value // 1000) for t in held],))
        mark = state.getCurrentWatermarkMs()
        last = int(rows["ts"].max().value // 1_000_000) if len(rows) else mark
        state.setTimeoutTimestamp(max(mark + 1, last + seconds * 1000))
        yield pd.DataFrame({"client": key[0], "key": rows["key"].values, "ts": rows["ts"].values, "admitted": admitted})

    marked = events.withWatermark("ts", late)
    return marked.groupBy("client").applyInPandasWithState(
        run, "client string, key long, ts timestamp, admitted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


class _Admission(StatefulProcessor):
    """List states: events that wait for the watermark, and admitted times of the
    last window. A timer is set for the first event that waits, or else for the
    end of the window, when the client is forgotten."""

    def __init__(self, limit: int, span: int):
        self.limit, self.span = limit, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, key long")
        self.held = handle.getListState("held", "at long")

    def wake(self, at: int) -> None:
        """A timer for the first millisecond from a time on, unless one is earlier."""
        due = -(-at // 1000)
        if not any(t <= due for t in self.handle.listTimers()):
            self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            events = [(int(at), int(k)) for at, k in zip(part["at"], part["key"], strict=True)]
            self.waiting.appendList(events)
            first = min([at for at, _ in events] + ([] if first is None else [first]))
        if first is not None:
            self.wake(max(first, timerValues.getCurrentWatermarkInMs() * 1000 + 1))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        held = deque(sorted(at for (at,) in self.held.get()) if self.held.exists() else [])
        ready, later = [e for e in events if e[0] <= mark], [e for e in events if e[0] > mark]
        admitted = []
        for at, _ in ready:
            while held and held[0] <= at - self.span:
                held.popleft()
            admitted.append(len(held) < self.limit)
            if admitted[-1]:
                held.append(at)
        held = [(at,) for at in held if at > mark - self.span]
        for state, values in ((self.waiting, later), (self.held, held)):
            state.clear()
            if values:
                state.put(values)
        if later or held:
            due = later[0][0] if later else held[-1][0] + self.span
            self.handle.registerTimer(-(-max(due, mark + 1) // 1000))
        if ready:
            yield pd.DataFrame({"client": key[0], "key": [k for _, k in ready], "at": [at for at, _ in ready], "admitted": admitted})

    def close(self) -> None:
        pass


def admit_in_order(events: DataFrame, limit: int = 30, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """As admit_stream, but an event is decided when the watermark has passed it,
    in order of time and key. So the result is that of requests.admit over all
    events that are not later than `late`, however they were cut into batches;
    later ones are dropped. Events of one client within `late` are held in its
    state. Needs the state store that timers and lists are kept in:
    spark.sql.streaming.stateStore.providerClass =
    org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider."""
    rows = events.where("ts is not null").withWatermark("ts", late).select("client", "key", "ts", F.unix_micros("ts").alias("at"))
    decided = rows.groupBy("client").transformWithStateInPandas(
        _Admission(limit, seconds * 1_000_000), "client string, key long, at long, admitted boolean", "Append", "EventTime"
    )
    return decided.select("client", "key", F.timestamp_micros("at").alias("ts"), "admitted")
