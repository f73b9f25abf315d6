"""Date and time columns.  ``now`` is always an explicit argument."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def moment(value: str | date | datetime) -> Column:
    """A zone-free timestamp literal."""
    if isinstance(value, datetime):
        text = value.isoformat(sep=" ")
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def complete_units(unit: str, start: Column, end: Column) -> Column:
    """Whole YEAR / MONTH / WEEK / DAY / SECOND units from start to end, truncated."""
    return F.timestamp_diff(unit, start, end)


def days_between(start: Column, end: Column) -> Column:
    """Calendar days from start to end, clock time ignored."""
    return F.datediff(F.to_date(end), F.to_date(start))


def shift_days(at: Column, days: int) -> Column:
    return at + F.expr(f"INTERVAL '{int(days)}' DAY")


def shift_hours(at: Column, hours: int) -> Column:
    return at + F.expr(f"INTERVAL '{int(hours)}' HOUR")


def second_of_day(at: Column) -> Column:
    return F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)


def readable_datetime(at: Column) -> Column:
    """``Mar 5, 2024 7:30pm``."""
    return F.concat(F.date_format(at, "MMM d, yyyy "), F.lower(F.date_format(at, "h:mma")))


def readable_date(at: Column) -> Column:
    """``5 Mar 2024``."""
    return F.date_format(at, "d MMM yyyy")


def readable_time(at: Column) -> Column:
    """``07:30 PM``."""
    return F.date_format(at, "hh:mm a")


def years_dot_months(birthdate: Column, at: Column) -> Column:
    """Age as the text ``years.months``; 3 years 11 months reads 3.11."""
    return F.concat(
        complete_units("YEAR", birthdate, at).cast("string"),
        F.lit("."),
        (complete_units("MONTH", birthdate, at) % 12).cast("string"),
    )


def day_start(value: str | date) -> datetime:
    """Midnight of a day given as text or date (driver side)."""
    if isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    return datetime.fromisoformat(str(value)[:10])


def next_day(value: str | date) -> datetime:
    return day_start(value) + timedelta(days=1)
