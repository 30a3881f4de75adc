"""Calendar schedules: parsing of entries, and matching days, hours and minutes as columns."""

from __future__ import annotations

import re
from calendar import monthrange
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Macros and the names of months and days.
MACROS = {
    "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
    "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *",
}
MONTHS = "JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split()
DAYS = "SUN MON TUE WED THU FRI SAT".split()


@dataclass
class Spec:
    """A parsed entry.  ``dom_special``: "L", "LW" or "<n>W"; ``dow_special``: ("L", day) or (n, day)."""

    minutes: list[int]
    hours: list[int]
    days: list[int]
    months: list[int]
    weekdays: list[int]
    any_day: bool = True
    any_weekday: bool = True
    dom_special: list[str] = field(default_factory=list)
    dow_special: list[tuple[str, int]] = field(default_factory=list)


def _value(text: str, names: list[str], first: int, lo: int, hi: int) -> int:
    n = names.index(text) + first if text in names else int(text) if text.isdigit() else -1
    if not lo <= n <= hi:
        raise ValueError(f"{text!r} is not between {lo} and {hi}")
    return n


def _items(text: str, lo: int, hi: int, names: list[str] = [], first: int = 0) -> list[int]:
    out: set[int] = set()
    m = re.fullmatch(r"(\*|[A-Z0-9]+)(?:-([A-Z0-9]+))?(?:/([0-9]+))?", text)
    if not m or int(m[3] or 1) < 1 or m[1] == "*" and m[2]:
        raise ValueError(f"bad field {text!r}")
    if m[1] == "*":
        a, b = lo, hi
    else:
        a = _value(m[1], names, first, lo, hi)
        b = _value(m[2], names, first, lo, hi) if m[2] else a  # a step after a single value keeps that value
    if a > b:
        raise ValueError(f"bad range {text!r}")
    out.update(range(a, b + 1, int(m[3] or 1)))
    return sorted(out)


def parse(entry: str) -> Spec:
    """Five fields or a macro; lists, ranges, steps, names; L, nW, LW for days, nL and n#k for weekdays."""
    fields = MACROS.get(entry.strip(), entry).split()
    if len(fields) != 5:
        raise ValueError(f"{entry!r} does not have five fields")
    minute, hour, dom, month, dow = fields
    lists = [sorted({x for part in f.split(",") for x in _items(part, lo, hi, names, first)}) for f, lo, hi, names, first in (
        (minute, 0, 59, [], 0), (hour, 0, 23, [], 0), (month, 1, 12, MONTHS, 1))]
    days, dom_special, weekdays, dow_special = set(), [], set(), []
    for part in dom.split(","):
        if re.fullmatch(r"L|LW|([1-9]|[12][0-9]|3[01])W", part):
            dom_special.append(part)
        else:
            days.update(_items(part, 1, 31))
    for part in dow.split(","):
        if m := re.fullmatch(r"([0-7]|[A-Z]{3})L", part):
            dow_special.append(("L", _value(m[1], DAYS, 0, 0, 7) % 7))
        elif m := re.fullmatch(r"([0-7]|[A-Z]{3})#([1-5])", part):
            dow_special.append((m[2], _value(m[1], DAYS, 0, 0, 7) % 7))
        else:
            weekdays.update(x % 7 for x in _items(part, 0, 7, DAYS, 0))
    return Spec(lists[0], lists[1], sorted(days), lists[2], sorted(weekdays), dom == "*", dow == "*", dom_special, dow_special)


def on(spec: Spec, day: date) -> bool:
    """What :func:`matches_day` says, for one day."""
    last = monthrange(day.year, day.month)[1]
    weekday = day.isoweekday() % 7

    def nearest(n: int) -> int:
        """The weekday nearest to day ``n`` inside the month."""
        w = day.replace(day=n).weekday()
        return n + (2 if n == 1 else -1) if w == 5 else n + (-2 if n == last else 1) if w == 6 else n

    def special(s: str) -> bool:
        if s == "L":
            return day.day == last
        n = last if s == "LW" else int(s[:-1])
        return n <= last and day.day == nearest(n)

    dom = day.day in spec.days or any(map(special, spec.dom_special))
    dow = weekday in spec.weekdays or any(
        weekday == d and (day.day + 7 > last if k == "L" else (day.day - 1) // 7 + 1 == int(k)) for k, d in spec.dow_special
    )
    both = dom and dow if spec.any_day or spec.any_weekday else dom or dow
    return day.month in spec.months and both


def ticks(spec: Spec, first: datetime, end: datetime) -> Iterator[datetime]:
    """The minutes from ``first`` up to, not including, ``end`` on which a job runs."""
    day = first.date()
    while day <= end.date():
        if on(spec, day):
            for h in spec.hours:
                for m in spec.minutes:
                    at = datetime(day.year, day.month, day.day, h, m, tzinfo=first.tzinfo)
                    if first <= at < end:
                        yield at
        day += timedelta(days=1)


def matches(spec: Spec, at: Column) -> Column:
    """Whether a job runs in the minute of a time."""
    return matches_day(spec, F.to_date(at)) & _in(F.hour(at), spec.hours) & _in(F.minute(at), spec.minutes)


def _in(value: Column, items: list[int]) -> Column:
    return value.isin(items) if items else F.lit(False)


def _nearest_weekday(base: Column, first: Column, last: Column) -> Column:
    """The weekday nearest to ``base`` inside its month."""
    w = F.weekday(base)  # Monday is 0
    saturday = F.when(base == first, F.date_add(base, 2)).otherwise(F.date_sub(base, 1))
    sunday = F.when(base == last, F.date_sub(base, 2)).otherwise(F.date_add(base, 1))
    return F.when(w == 5, saturday).when(w == 6, sunday).otherwise(base)


def matches_day(spec: Spec, day: Column) -> Column:
    """Month, day of month and weekday of a date column; the latter two as "or" when both are given."""
    last = F.last_day(day)
    first = F.date_add(day, 1 - F.dayofmonth(day))
    dom = _in(F.dayofmonth(day), spec.days)
    for s in spec.dom_special:
        if s == "L":
            dom = dom | (day == last)
        else:
            n = F.dayofmonth(last) if s == "LW" else F.lit(int(s[:-1]))
            base = F.date_add(first, n - 1)
            dom = dom | ((n <= F.dayofmonth(last)) & (day == _nearest_weekday(base, first, last)))
    weekday = F.dayofweek(day) - 1
    dow = _in(weekday, spec.weekdays)
    for k, d in spec.dow_special:
        hit = F.date_add(day, 7) > last if k == "L" else F.floor((F.dayofmonth(day) - 1) / 7) + 1 == int(k)
        dow = dow | ((weekday == d) & hit)
    both = dom & dow if spec.any_day or spec.any_weekday else dom | dow
    return _in(F.month(day), spec.months) & both
