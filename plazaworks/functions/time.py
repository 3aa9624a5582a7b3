"""Minutes of the day and windows of time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 1440


def _last_sunday_1am(year: Column, month: int) -> Column:
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.dayofweek(last) - 1).cast("timestamp_ntz") + F.expr("INTERVAL 1 HOUR")


def warsaw_minute(utc: Column) -> Column:
    """Minute of the day in Warsaw of a UTC time: +2 h from the last Sunday of March to that of October at 01:00 UTC, else +1 h."""
    summer = (utc >= _last_sunday_1am(F.year(utc), 3)) & (utc < _last_sunday_1am(F.year(utc), 10))
    return F.pmod(F.hour(utc) * 60 + F.minute(utc) + F.when(summer, 120).otherwise(60), F.lit(DAY))


def _segments(start: Column, end: Column) -> tuple[Column, Column, Column, Column]:
    """Two spans [a, b), [c, d): the whole day if start = end, wrapped if start > end, none beyond the day."""
    bad = (start > DAY) | (end > DAY) | (start < 0) | (end < 0)
    a = F.when(bad | (start == end), F.lit(0)).otherwise(start)
    b = F.when(bad, F.lit(0)).when(start >= end, F.lit(DAY)).otherwise(end)
    d = F.when(~bad & (start > end), end).otherwise(F.lit(0))
    return a, b, F.lit(0), d


def window_contains(start: Column, end: Column, minute: Column) -> Column:
    a, b, c, d = _segments(start, end)
    return ((minute >= a) & (minute < b)) | ((minute >= c) & (minute < d))


def windows_overlap(start1: Column, end1: Column, start2: Column, end2: Column) -> Column:
    a, b, c, d = _segments(start1, end1)
    e, f, g, h = _segments(start2, end2)
    meet = lambda x, y, z, w: F.greatest(x, z) < F.least(y, w)
    return meet(a, b, e, f) | meet(a, b, g, h) | meet(c, d, e, f) | meet(c, d, g, h)


def time_fit(start: Column, end: Column, minute: Column) -> Column:
    """1 in the middle of the window or without one, less towards its ends, 0 outside."""
    size = F.pmod(end - start, F.lit(DAY))
    into = F.pmod(minute - start, F.lit(DAY))
    inside = window_contains(start, end, minute)
    fit = 1 - F.abs(into - size / 2.0) / F.nullif(size.cast("double"), F.lit(0.0))
    return F.when(start.isNull() | end.isNull() | (size == 0), F.lit(1.0)).when(~inside, F.lit(0.0)).otherwise(fit)
