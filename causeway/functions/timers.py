"""Column expressions for timers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def catch_up(behind: Column, interval: Column) -> Column:
    """Seconds to wait when ``behind`` = trigger time - now; null for a missed timer without interval.

    Missed ticks are skipped and the phase is kept: the wait is more than 0, at most an interval.
    """
    missed = F.floor(-behind / interval)
    return F.when(behind >= 0, behind.cast("double")).when(interval.isNotNull(), (behind + interval * (1 + missed)).cast("double"))


def ready_at(now: Column, until: Column, delay: Column) -> Column:
    """Unix seconds at which a sleep ends."""
    return F.coalesce(until, now) + F.coalesce(delay, F.lit(0))


def iso(ts: Column) -> Column:
    """A time as ISO-8601 text in UTC, to the microsecond (the session's time zone is UTC)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
