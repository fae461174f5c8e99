"""Heartbeats in a stream: gaps between a device's readings, and devices that fall silent.

Readings wait in keyed state until the watermark has passed them, and are then taken
in order of event time, whatever order they came in; so the gaps are those of the batch.
Timers fire at each waiting reading's time, and ``seconds`` after a device's last.
A device's silence is told once, when it has lasted that long, with no reading to
end it; the reading that ends it tells the gap as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "tenant_id string, device_id string, event_id string, previous_at timestamp, timestamp timestamp, gap_seconds bigint, silent boolean"


def due(micros: int) -> int:
    """The first millisecond at which the watermark is behind a time."""
    return micros // 1000 + 1


class Heartbeat(StatefulProcessor):
    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, event_id string")
        self.last = handle.getValueState("last", "at bigint, told boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timers = set()
        for part in rows:
            self.waiting.appendList([(int(at), event_id) for at, event_id in zip(part["at"], part["event_id"], strict=True)])
            timers |= {due(int(at)) for at in part["at"]}
        for at in timers:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # all that it has passed is taken at once, so later timers find it done
        found = sorted((r for r in self.waiting.get()), key=lambda r: (r[0], r[1] or "")) if self.waiting.exists() else []
        ready = [r for r in found if due(r[0]) <= now]
        last, told = self.last.get() if self.last.exists() else (None, False)
        out = []
        for at, event_id in ready:
            if last is not None and (at - last) // 1_000_000 > self.seconds:
                out.append((event_id, last, at, (at - last) // 1_000_000, False))
            last, told = at, False
        if ready:
            if len(ready) < len(found):
                self.waiting.put(found[len(ready) :])
            else:
                self.waiting.clear()
        if last is not None and not told:
            silent_at = due(last + (self.seconds + 1) * 1_000_000 - 1)  # a gap is whole seconds
            if now >= silent_at:
                out.append((None, last, None, None, True))
                told = True
            elif ready:
                self.handle.registerTimer(silent_at)
        if last is not None:
            self.last.update((last, told))
        if out:
            frame = pd.DataFrame(out, columns=["event_id", "previous_at", "timestamp", "gap_seconds", "silent"])
            for c in ("previous_at", "timestamp"):
                frame[c] = pd.to_datetime(frame[c].astype("Int64"), unit="us", utc=True)
            frame["gap_seconds"] = frame["gap_seconds"].astype("Int64")
            frame.insert(0, "tenant_id", key[0])
            frame.insert(1, "device_id", key[1])
            yield frame

    def close(self) -> None:
        pass


def heartbeats(rows: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(tenant_id, device_id, event_id, previous_at, timestamp, gap_seconds, silent) of a stream of table rows.

    Readings later than ``late`` behind the newest are not waited for.  Rows without a time have no place in the order.
    """
    timed = rows.where(F.col("timestamp").isNotNull()).withWatermark("timestamp", late)
    flat = timed.select("tenant_id", "device_id", "event_id", "timestamp", F.unix_micros("timestamp").alias("at"))
    return flat.groupBy("tenant_id", "device_id").transformWithStateInPandas(Heartbeat(seconds), OUTPUT, "append", "eventTime")
