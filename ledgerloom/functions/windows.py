"""Windows over days: report windows are closed, windows between counts are open at their start."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def closed(day: Column, start: date | None = None, end: date | None = None) -> Column:
    """``start <= day <= end``; bounds in the wrong order change places; with no bound a null day is inside."""
    if start and end and start > end:
        start, end = end, start
    out = F.lit(True)
    out = out & (day >= F.lit(start)) if start else out
    return out & (day <= F.lit(end)) if end else out


def between_counts(day: Column, start: date, end: date) -> Column:
    """After the opening count, up to and with the closing one's day."""
    return (day > F.lit(start)) & (day <= F.lit(end))


def last_twelve_months(today: date) -> tuple[date, date]:
    return today - timedelta(days=365), today


def effective_day(occurred: Column, invoiced: Column, typed: Column) -> Column:
    """The day of a movement: when it occurred, else when it was invoiced, else when it was typed in."""
    return F.coalesce(occurred, invoiced, F.to_date(typed))


def business_day(moment: Column, hours: int = 6) -> Column:
    """The day of a service: before ``hours`` in the morning it is still the day before."""
    return F.to_date(moment - F.make_dt_interval(hours=F.lit(hours)))


def easter(year: Column) -> Column:
    """Easter Sunday by the Gregorian computus, in integer columns."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = F.floor((a + 11 * h + 22 * m) / 451)
    shift = h + m - 7 * n + 114
    return F.make_date(year, F.floor(shift / 31).cast("int"), (shift % 31 + 1).cast("int"))


#: Days of the year that are always public holidays, and days after Easter that are.
FIXED_HOLIDAYS = ((1, 1), (5, 1), (5, 8), (7, 14), (8, 15), (11, 1), (11, 11), (12, 25))
AFTER_EASTER = (1, 39, 50)


def holidays(year: Column) -> Column:
    """The eleven public holidays of a year, in order."""
    fixed = [F.make_date(year, F.lit(m), F.lit(d)) for m, d in FIXED_HOLIDAYS]
    return F.array_sort(F.array(*fixed, *(F.date_add(easter(year), n) for n in AFTER_EASTER)))


def instants(first: Column, last: Column, weekdays: Sequence[int], times: Sequence[str], zone: str = "Europe/Paris") -> Column:
    """The moments (UTC) of a weekly rule, Monday 0, at local ``times``, on the days from ``first`` to ``last``. A time that
    the clock skips is the moment it would have been; of one that comes twice the first counts."""
    days = F.filter(F.sequence(first, last), lambda d: F.weekday(d).isin(*weekdays))
    of = lambda d: F.array(*(F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", d.cast("string"), F.lit(t))), zone) for t in times))
    return F.array_sort(F.flatten(F.transform(days, of)))


def last_complete_day(local: Column, night_ends: int | None = 6) -> Column:
    """The last day whose sales are all in: yesterday, or the day before that while the night until ``night_ends`` goes on;
    without a night always yesterday."""
    yesterday = F.date_sub(F.to_date(local), 1)
    return yesterday if night_ends is None else F.when(F.hour(local) >= night_ends, yesterday).otherwise(F.date_sub(yesterday, 1))


def months_before(day: Column, months: int) -> Column:
    """The same day so many months earlier, or the last that the month has."""
    return F.add_months(day, -months)


def month_days(day: Column) -> Column:
    """Every day of a day's month, in order."""
    return F.sequence(F.trunc(day, "MM"), F.last_day(day))
