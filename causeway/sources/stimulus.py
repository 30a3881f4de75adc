"""Calendar entries and timers as a data source, batch and streaming.

    stimulus.register(spark)
    spark.read.format("stimulus").option("cron", '{"daily": "@daily"}').option("start", "2024-01-01T00:00").option("end", ...).load()
    spark.readStream.format("stimulus").option("cron", ...).option("timers", '{"beat": ["2024-01-01T00:00:00", 90]}').load()

Rows are ``kind ("cron" or "timer"), name, at``.  ``start`` is the first minute, ``end`` the
one after the last; a stream without ``end`` goes on with the clock.  A stream's offset is a
minute, so a restart goes on with the minute after the last one committed: each tick once,
those missed while it was down included.  A partition is an entry and a span of days, so
many entries and long spans are spread over tasks; a tick is made from its own entry and
minute alone, and a lost task makes the same ones again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.cron import parse, ticks

#: Minutes of an entry in one partition.
SPAN = 31 * 24 * 60


class Part(InputPartition):
    """The ticks of an entry from a minute up to another."""

    def __init__(self, kind: str, name: str, entry: str | list, first: int, end: int):
        self.kind, self.name, self.entry, self.first, self.end = kind, name, entry, first, end


def minute_of(text: str) -> int:
    """Minutes since 1970 of an ISO-8601 time, in UTC unless it says otherwise."""
    at = datetime.fromisoformat(text)
    return int((at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() // 60)


def time_of(minute: int) -> datetime:
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=minute)


class _Entries:
    """The entries that the options name, dealt to partitions."""

    def __init__(self, options: dict[str, str]):
        self.entries = [("cron", name, entry) for name, entry in json.loads(options.get("cron", "{}")).items()]
        self.entries += [("timer", name, entry) for name, entry in json.loads(options.get("timers", "{}")).items()]
        for kind, _, entry in self.entries:  # wrong ones fail here, not in a task
            if kind == "cron" and entry != "@reboot":
                parse(entry)
            elif kind == "timer" and (minute_of(entry[0]) < 0 or entry[1] is not None and entry[1] <= 0):
                raise ValueError(f"bad timer {entry!r}")
        self.span = int(options.get("span", SPAN))

    def parts(self, first: int, end: int) -> list[Part]:
        return [Part(*e, at, min(end, at + self.span)) for e in self.entries for at in range(first, end, self.span)]

    def rows(self, part: Part) -> Iterator[tuple]:
        first, end = time_of(part.first), time_of(part.end)
        if part.kind == "timer":
            began, interval = datetime.fromisoformat(part.entry[0]), part.entry[1]
            began = began if began.tzinfo else began.replace(tzinfo=timezone.utc)
            if interval is None:
                if first <= began < end:
                    yield part.kind, part.name, began
                return
            step = timedelta(seconds=interval)
            at = began + max(0, -((began - first) // step)) * step  # the first one at or after the span's start
            while at < end:
                if at >= first:
                    yield part.kind, part.name, at
                at += step
        elif part.entry != "@reboot":
            for at in ticks(parse(part.entry), first, end):
                yield part.kind, part.name, at


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if "start" not in options or "end" not in options:
            raise ValueError("a batch needs the options start and end")
        self.entries, self.first, self.end = _Entries(options), minute_of(options["start"]), minute_of(options["end"])

    def partitions(self) -> list[Part]:
        # a source without any tick still needs a partition to read
        return self.entries.parts(self.first, self.end) or [Part("cron", "none", "@reboot", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.entries.rows(partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.entries = _Entries(options)
        self.first = minute_of(options["start"]) if "start" in options else None
        self.end = minute_of(options["end"]) if "end" in options else None

    def _now(self) -> int:
        return int(datetime.now(timezone.utc).timestamp() // 60)

    def initialOffset(self) -> dict:
        return {"minute": self.first if self.first is not None else self._now()}

    def latestOffset(self) -> dict:
        """The minute after the last one that is over."""
        now = self._now()
        return {"minute": now if self.end is None else min(now, self.end)}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.entries.parts(start["minute"], end["minute"])

    def read(self, partition: Part) -> Iterator[tuple]:
        return self.entries.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is held between batches."""


class Stimulus(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stimulus"

    def schema(self) -> str:
        return "kind string, name string, at timestamp"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Stimulus)
