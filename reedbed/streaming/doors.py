"""Swinging doors and greedy segments over a stream: two samples and two slopes of state for each signal.

Rows of a signal come in order of ``idx`` from batch to batch; within a batch they are sorted here, and rows at or before the
last place are repeats and left out. A signal ends with a row whose ``idx`` is null, or when no row of it came for ``idle``
of event time: its last sample is let out and its state is removed. Rows that come after that begin it anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import Door

OUT = "signal_id string, idx long, value double"
STATE = "at_idx long, at_value double, last_idx long, last_value double, low double, high double, ends long"
#: State of this operator needs a store with typed columns.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Doors(StatefulProcessor):
    def __init__(self, kind: type[Door], tolerance: float, idle_ms: int):
        self.kind, self.tolerance, self.idle_ms = kind, tolerance, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("door", STATE)

    def _held(self) -> tuple[Door, int | None]:
        if not self.state.exists():
            return self.kind(self.tolerance), None
        at_i, at_v, last_i, last_v, low, high, ends = self.state.get()
        return self.kind(self.tolerance, (at_i, at_v), (last_i, last_v), low, high), ends

    def _end(self, key, door: Door) -> Iterator[Row]:
        if self.state.exists():
            self.state.clear()
        if door.at is not None:
            for place, value in door.rest():
                yield Row(signal_id=key[0], idx=place, value=value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        door, ends = self._held()
        rows, ended, last = list(rows), False, -math.inf
        for r in sorted((r for r in rows if r.idx is not None), key=lambda r: r.idx):
            if door.last is not None and r.idx <= door.last[0]:
                continue
            if (out := door.push(r.idx, r.value)) is not None:
                yield Row(signal_id=key[0], idx=out[0], value=out[1])
        for r in rows:
            ended |= r.idx is None
            if r.ts is not None:
                last = max(last, int(r.ts.timestamp() * 1000))
        if ends is not None:
            self.handle.deleteTimer(ends)
        if ended:
            yield from self._end(key, door)
        elif door.at is not None:
            ends = max(ends or 0, last + self.idle_ms) if last > -math.inf else ends or timerValues.getCurrentWatermarkInMs() + self.idle_ms
            self.handle.registerTimer(ends)
            self.state.update((*door.at, *door.last, door.low, door.high, ends))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._end(key, self._held()[0])

    def close(self) -> None:
        pass


def compressed(stream: DataFrame, kind: type[Door], tolerance: float, idle: timedelta = timedelta(hours=1), late: str = "10 minutes") -> DataFrame:
    """``stream``: signal_id, idx, value, ts. The samples that ``folds.at_tolerance`` stores of each signal; ``late`` is the
    watermark's delay. The session's state store must be ``STORE``."""
    processor = Doors(kind, tolerance, int(idle.total_seconds() * 1000))
    rows = stream.select("signal_id", "idx", "value", "ts").withWatermark("ts", late)
    return rows.groupBy("signal_id").transformWithState(statefulProcessor=processor, outputStructType=OUT, outputMode="Append", timeMode="EventTime")
