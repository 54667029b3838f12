"""Days, periods and offsets from UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .outcome import _col


def offset_minutes(x: Column | str) -> Column:
    """An offset such as "+05:30", "-0800" or "Z" in minutes; null for anything else or beyond 14 hours."""
    text = F.trim(_col(x))
    part = lambda k: F.regexp_extract(text, r"^([+-])([0-9]{2}):?([0-9]{2})$", k)
    minutes = part(2).try_cast("int") * 60 + part(3).try_cast("int")
    sound = (part(3).try_cast("int") < 60) & (minutes <= 14 * 60)
    return F.when(F.upper(text).isin("Z", "UTC"), F.lit(0)).when(sound, F.when(part(1) == "-", -minutes).otherwise(minutes))


def local_date(instant: Column | str, minutes: Column) -> Column:
    """The day on the wall at an instant of UTC, so many minutes off; the session's time zone plays no part."""
    return F.timestamp_add("MINUTE", minutes, _col(instant).cast("timestamp_ntz")).cast("date")


def next_period(day: Column, unit: str) -> Column:
    """The first day after the day, week (from Monday), month, quarter or year that a day is in."""
    steps = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month", "quarter": "interval 3 months", "year": "interval 1 year"}
    start = day.cast("date") if unit == "day" else F.trunc(day, unit)
    return (start.cast("timestamp_ntz") + F.expr(steps[unit])).cast("date")


def month_end(month: Column | str) -> Column:
    """The last day of a month written as yyyy-MM; null for anything else."""
    return F.last_day(F.try_to_date(F.when(_col(month).rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(_col(month), F.lit("-01"))), "yyyy-MM-dd"))
