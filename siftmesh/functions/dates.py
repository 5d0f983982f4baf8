"""Durations, dates of the crawl's several forms, and hours of last change in 16 bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the units of a duration; a month has 30 days, a year 365.
UNITS = {"s": 1, "M": 60, "h": 3600, "d": 86_400, "m": 2_592_000, "y": 31_536_000}
_MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
DAY_H = 24


def duration(text: Column | str) -> Column:
    """Seconds of ``4h30m``, ``1y6m-15d`` or a bare integer; null for anything else."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.regexp_extract_all(c, F.lit(r"(-?\d+[sMhdmy])"), 1)
    total = F.lit(0).cast("long")
    for unit, seconds in UNITS.items():
        own = F.filter(parts, _ends_with(unit))
        total = total + F.aggregate(F.transform(own, _number), F.lit(0).cast("long"), lambda a, x: a + x) * seconds
    return F.when(c.rlike(r"^-?\d+$"), c.try_cast("long")).when(c.rlike(r"^([+-]?\d+[sMhdmy])+$"), total)


def _ends_with(unit: str):
    return lambda p: F.endswith(p, F.lit(unit))


def _number(part: Column) -> Column:
    return F.regexp_extract(part, r"(-?\d+)", 1).cast("long")


def _utc(text: Column, form: str) -> Column:
    """Seconds of a time in UTC, whatever the session's zone; null if there is no such time."""
    return F.unix_timestamp(F.try_to_timestamp(F.concat(text, F.lit(" +0000")), F.lit(f"{form} Z")))


def day_first(text: Column) -> Column:
    """Seconds of ``dd/mm/yyyy`` in UTC; null if there is no such day."""
    return _utc(F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), text), "d/M/yyyy")


def compact(text: Column) -> Column:
    """Seconds of ``yyyyMMddHHmmss``, as file servers give it, in UTC."""
    return _utc(F.when(text.rlike(r"^\d{14}$"), text), "yyyyMMddHHmmss")


def http_date(text: Column | str) -> Column:
    """Seconds of ``Sun, 06 Nov 1994 08:49:37 GMT``, ``Sunday, 06-Nov-94 08:49:37 GMT`` or ``Sun Nov  6 08:49:37 1994`` in UTC.

    Years of two digits below 70 are 20yy. Anything else, as empty texts or -1, is null.
    """
    c = F.col(text) if isinstance(text, str) else text
    # All forms to day|month|year|time, so there is one date to read.
    for pattern, order in (
        (r"^\w{3}, (\d{1,2}) (\w{3}) (\d{4}) (\d\d:\d\d:\d\d).*$", "$1|$2|$3|$4"),
        (r"^\w+, (\d{1,2})-(\w{3})-([0-6]\d) (\d\d:\d\d:\d\d).*$", "$1|$2|20$3|$4"),
        (r"^\w+, (\d{1,2})-(\w{3})-(\d\d) (\d\d:\d\d:\d\d).*$", "$1|$2|19$3|$4"),
        (r"^\w{3} (\w{3}) +(\d{1,2}) (\d\d:\d\d:\d\d) (\d{4}).*$", "$2|$1|$4|$3"),
    ):
        c = F.regexp_replace(c, pattern, order)
    return _utc(F.when(c.rlike(rf"^\d{{1,2}}\|({_MONTHS})\|\d{{4}}\|"), c), "d|MMM|yyyy|HH:mm:ss")


def hour_origin(newest: int) -> int:
    """The second that hour 0 stands for, if ``newest`` is the newest change: 65535 hours before the hour after it."""
    return (newest // 3600 + 1) * 3600 - 65_535 * 3600


def last_change_hour(seconds: Column, origin: int, now: int) -> Column:
    """0 for none, else hours since the origin within 1 and 65535; changes in the future count as at most a day from now."""
    seen = F.least(seconds, F.lit(now + DAY_H * 3600))
    hour = F.floor((seen - origin) / 3600)
    return F.when(seconds.isNull(), 0).when(seen <= origin + 3600, 1).otherwise(F.least(hour, F.lit(65_535))).cast("long")


def schedule_value(second_of_day: Column, intervals: list[tuple[int, int, int]], default: int = 0) -> Column:
    """The value of the last given interval (from, to, value) that holds the second; intervals may run over midnight."""
    out = F.lit(default)
    for start, end, value in intervals:
        inside = second_of_day.between(start, end) if start <= end else (second_of_day >= start) | (second_of_day <= end)
        out = F.when(inside, value).otherwise(out)
    return out
