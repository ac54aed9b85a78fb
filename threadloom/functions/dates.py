"""Dates in ISO notation, cutoffs, and the next run of a schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})?)?$"
DEFAULT_START = "2018-01-01T00:00:00Z"


def parse_iso(c: Column) -> Column:
    """A timestamp from ISO text; without an offset it is UTC, and what isn't a date is null. Needs the session zone UTC."""
    text = F.regexp_replace(F.regexp_replace(c, "Z$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    text = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c).otherwise(F.regexp_replace(text, ",", "."))
    return F.when(c.rlike(ISO), F.try_to_timestamp(text))


def moment(iso: str) -> Column:
    return parse_iso(F.lit(iso))


def days_before(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(F.lit(days))


def start_cutoff(text: Column) -> Column:
    """The start date, or 2018-01-01 where the text is no date."""
    return F.coalesce(parse_iso(text), moment(DEFAULT_START))


def iso_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def second_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1_000_000


def target_today(now: Column, clock: Column) -> Column:
    """Today at HH:MM; null where the text is no time of day."""
    parts = F.split(clock, ":")
    hour, minute = F.get(parts, F.lit(0)).try_cast("int"), F.get(parts, F.lit(1)).try_cast("int")
    fits = (F.size(parts) == 2) & hour.between(0, 23) & minute.between(0, 59)
    return F.when(fits, F.date_trunc("DAY", now) + F.make_dt_interval(F.lit(0), hour, minute))


def days_ahead(now: Column, days: Column) -> Column:
    """How many days on, 1 to 7, the next weekday of the list (0 is Monday) comes; null for an empty list."""
    today = F.weekday(now)
    return F.array_min(F.filter(F.sequence(F.lit(1), F.lit(7)), lambda a: F.array_contains(days, ((today + a) % 7).cast("int"))))


def next_run(now: Column, interval: Column, clock: Column, days: Column) -> Column:
    """When a schedule runs next: in an hour, or today at its time, or, once that has passed, on its next day.

    A time equal to now counts as not yet passed. A weekly schedule's time today stands even where today is none of its days.
    """
    target = target_today(now, clock)
    passed = now > target
    daily = F.when(passed, target + F.make_dt_interval(F.lit(1))).otherwise(target)
    weekly = F.when(passed, target + F.make_dt_interval(days_ahead(now, days))).otherwise(target)
    return F.when(interval == "hourly", now + F.make_dt_interval(F.lit(0), F.lit(1))).when(interval == "daily", daily).when(interval == "weekly", weekly)
