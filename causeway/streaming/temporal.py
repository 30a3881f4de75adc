"""Streaming forms of the time-driven operators.

Times are event times: a timer fires when the watermark passes it, so at the end of a
finite stream timers later than the last watermark have not fired.  Late events are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.timers import catch_up  # noqa: F401  (the same rule holds for restarts)
from ..operators.temporal import cron_hits


def _one(state):
    return state.get()[0] if state.exists() else None


class _Watchdog(StatefulProcessor):
    """Holds the last event's time; its timer stands at that time + timeout."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("ms", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = sorted({int(t) for pdf in rows for t in pdf["ms"]})
        last, out = _one(self.last), []
        for t in times:
            # a gap inside the batch expires at once
            if last is not None and t > last + self.timeout_ms:
                out.append(last)
            last = t if last is None else max(last, t)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.timeout_ms)
        self.last.update((last,))
        yield self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = _one(self.last)
        self.last.clear()
        yield self._rows(key, [last] if last is not None else [])

    def _rows(self, key, lasts: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"key": [str(key[0])] * len(lasts), "last_ms": lasts, "expired_ms": [x + self.timeout_ms for x in lasts]}).astype(
            {"key": "object", "last_ms": "int64", "expired_ms": "int64"}
        )

    def close(self) -> None:
        pass


def watchdog(events: DataFrame, key: str, ts: str, timeout_ms: int, delay: str = "0 seconds") -> DataFrame:
    """``key, last_ms, expired_ms`` whenever a key has been silent for the timeout."""
    if timeout_ms <= 0:
        raise ValueError("timeout must be positive")
    at = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    rows = at.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.unix_millis("_ts").alias("ms"), "_ts")
    out = StructType([StructField("key", StringType()), StructField("last_ms", LongType()), StructField("expired_ms", LongType())])
    return rows.groupBy("key").transformWithStateInPandas(_Watchdog(timeout_ms), out, "append", "EventTime")


class _Timer(StatefulProcessor):
    """Commands set or cancel a key's timer; each firing sets the next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.plan = handle.getValueState("plan", StructType([StructField("next_ms", LongType()), StructField("interval_ms", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        commands = pd.concat(list(rows)).sort_values("seq")
        for c in commands.itertuples():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if c.action == "cancel":
                self.plan.clear()
                continue
            interval = 0 if pd.isna(c.interval_ms) else int(c.interval_ms)
            self.plan.update((int(c.first_ms), interval))
            self.handle.registerTimer(int(c.first_ms))
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        plan = self.plan.get() if self.plan.exists() else None
        if plan is None:
            yield self._rows(key, [])
            return
        at, interval = plan
        now, fired = timerValues.getCurrentWatermarkInMs(), [at]
        if interval > 0:
            while at + interval <= now:  # ticks the watermark has jumped over
                at += interval
                fired.append(at)
            self.plan.update((at + interval, interval))
            self.handle.registerTimer(at + interval)
        else:
            self.plan.clear()
        yield self._rows(key, fired)

    def _rows(self, key, fired: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"timer": [str(key[0])] * len(fired), "at_ms": fired}).astype({"timer": "object", "at_ms": "int64"})

    def close(self) -> None:
        pass


def timer_stream(commands: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """``timer, at_ms`` of all ticks; commands have ``timer, seq, action, first_ms, interval_ms, ts``."""
    at = commands.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    rows = at.select("timer", "seq", "action", "first_ms", "interval_ms", "_ts")
    out = StructType([StructField("timer", StringType()), StructField("at_ms", LongType())])
    return rows.groupBy("timer").transformWithStateInPandas(_Timer(), out, "append", "EventTime")


class _Once(StatefulProcessor):
    """A flag that is set by the first firing and taken away by a reset."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", StructType([StructField("yes", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events, fired = pd.concat(list(rows)).sort_values("seq"), []
        done = self.done.exists()
        for e in events.itertuples():
            if e.reset:
                done = False
            elif not done:
                done = True
                fired.append(int(e.seq))
        self.done.update((1,)) if done else self.done.clear()
        yield pd.DataFrame({"key": [str(key[0])] * len(fired), "seq": fired}).astype({"key": "object", "seq": "int64"})

    def close(self) -> None:
        pass


def once(events: DataFrame) -> DataFrame:
    """``key, seq`` of the first firing, and of the first after each reset; ``events`` has ``key, seq, reset``."""
    out = StructType([StructField("key", StringType()), StructField("seq", LongType())])
    rows = events.select(F.col("key").cast("string").alias("key"), "seq", "reset")
    return rows.groupBy("key").transformWithStateInPandas(_Once(), out, "append", "None")


def exchange(requests: DataFrame, responses: DataFrame, timeout: str = "30 seconds", delay: str = "0 seconds") -> DataFrame:
    """Requests ``request, req_ts`` with their response, or 504 once the watermark shows none came in time."""
    a = requests.withWatermark("req_ts", delay)
    b = responses.withColumnRenamed("request", "answered").withWatermark("resp_ts", delay)
    on = (F.col("request") == F.col("answered")) & (F.col("resp_ts") >= F.col("req_ts")) & (F.col("resp_ts") <= F.col("req_ts") + F.expr(f"interval {timeout}"))
    return a.join(b, on, "leftOuter").select(
        "request", "req_ts", F.coalesce("status", F.lit(504)).alias("status"), F.coalesce("body", F.lit("Response action not invoked.")).alias("body")
    )


def cron_stream(ticks: DataFrame, specs: dict[str, str], ts: Column | None = None) -> DataFrame:
    """``cron, minute`` for every tick (a stream of times, one a minute) that an entry matches."""
    at = F.date_trunc("minute", ts if ts is not None else F.col("timestamp"))
    return cron_hits(ticks.select(at.alias("minute")), F.col("minute"), specs)
