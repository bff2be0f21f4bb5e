"""Rate limits on a stream of requests, in order of event time, with state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: The state store that keeps lists and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Bucket(StatefulProcessor):
    """A token bucket per key. Requests wait in a list until the watermark has passed them, then are decided by time and event_id, whatever order they came in.

    A timer at the oldest waiting request wakes the key; when nothing waits, one at the time at which the bucket is full again removes its state, as a full bucket is
    what a new key has.
    """

    def __init__(self, keys: list[str], capacity: float, per_day: float):
        self.keys, self.capacity, self.per_day = keys, float(capacity), float(per_day)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, micros long")
        self.bucket = handle.getValueState("bucket", "tokens double, micros long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            micros = part["micros"].astype("int64")
            self.waiting.appendList([(int(e), int(m)) for e, m in zip(part["event_id"], micros, strict=True)])
            first = int(micros.min()) if first is None else min(first, int(micros.min()))
        if first is not None:
            self.handle.registerTimer(max(first // 1000, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs()
        due, rest = [], []
        for event_id, micros in self.waiting.get():
            (due if micros // 1000 <= until else rest).append((micros, event_id))
        state = self.bucket.get() if self.bucket.exists() else None
        tokens, last = (float(state[0]), int(state[1])) if state else (self.capacity, None)
        out = []
        for micros, event_id in sorted(due):
            if last is not None:
                tokens = min(self.capacity, tokens + max(0, micros - last) / (1000 * DAY_MS) * self.per_day)
            last = micros if last is None else max(last, micros)
            out.append((*key, event_id, tokens >= 1.0))
            tokens -= tokens >= 1.0
        if due:
            if rest:
                self.waiting.put([(e, m) for m, e in rest])
            else:
                self.waiting.clear()
            self.bucket.update((tokens, last))
        if rest:
            self.handle.registerTimer(max(min(rest)[0] // 1000, until + 1))
        elif last is not None:
            full = last // 1000 + int((self.capacity - tokens) / self.per_day * DAY_MS) + 1
            if full <= until:
                self.bucket.clear()
            else:
                self.handle.registerTimer(full)
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "event_id", "admitted"])

    def close(self) -> None:
        pass


def limited(asked: DataFrame, keys: list[str], capacity: float, per_day: float, late: str = "1 hour") -> DataFrame:
    """keys, event_id, admitted: control.token_bucket() on a stream asked(ts, event_id, keys), equal to it for all requests at most late behind the newest one.

    Decisions come once the watermark has passed a request, later ones are dropped. The session's state store must be one with lists and timers (STORE).
    """
    kinds = ", ".join(f"`{k}` {asked.schema[k].dataType.simpleString()}" for k in keys)
    rows = asked.withWatermark("ts", late).select(*keys, "event_id", "ts", F.unix_micros("ts").alias("micros"))
    return rows.groupBy(*keys).transformWithStateInPandas(Bucket(keys, capacity, per_day), f"{kinds}, event_id long, admitted boolean", "append", "EventTime")
