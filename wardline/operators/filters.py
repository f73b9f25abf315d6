"""Row filters and predicates."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.dates import complete_units, day_start, moment, next_day
from wardline.functions.text import ilike_any, is_uuid


def not_voided(df: DataFrame, column: str = "voided") -> DataFrame:
    """Rows that are not soft-deleted."""
    return df.filter(~F.col(column))


def date_range(df: DataFrame, at: str, start=None, end=None) -> DataFrame:
    """Rows from the start day to the end day, both included; either may be None.

    The column stays bare so the bounds reach the scan.
    """
    if start is not None:
        df = df.filter(F.col(at) >= moment(day_start(start)))
    if end is not None:
        df = df.filter(F.col(at) < moment(next_day(end)))
    return df


def in_months(df: DataFrame, start=None, end=None, column: str = "month") -> DataFrame:
    """Rows of a stored table whose month can hold the days; a table without that column stays whole."""
    if column in df.columns:
        if start is not None:
            df = df.filter(F.col(column) >= f"{day_start(start):%Y-%m}")
        if end is not None:
            df = df.filter(F.col(column) <= f"{day_start(end):%Y-%m}")
    return df


def type_in(df: DataFrame, types: Iterable, column: str = "encounter_type") -> DataFrame:
    return df.filter(F.col(column).isin(list(types)))


def on_date_at_location(
    encounters: DataFrame, types: Iterable, day, location,
    type_column: str = "encounter_type", at: str = "encounter_datetime", place: str = "location_id",
) -> DataFrame:
    """Encounters of the types on one day at one place."""
    chosen = date_range(type_in(encounters, types, type_column), at, day, day)
    return chosen.filter(F.col(place) == F.lit(location))


@dataclass(frozen=True)
class Shift:
    """A working shift: morning covers 08:00 the day before to 08:00, evening 08:00 to 20:00."""

    start: datetime
    end: datetime
    end_inclusive: bool

    def covers(self, column: Column) -> Column:
        upper = column <= moment(self.end) if self.end_inclusive else column < moment(self.end)
        return (column >= moment(self.start)) & upper


def shift_window(day: str | date, shift: str, end_inclusive: bool = False) -> Shift:
    midnight = day_start(day)
    if shift == "morning":
        return Shift(midnight - timedelta(hours=16), midnight + timedelta(hours=8), end_inclusive)
    if shift == "evening":
        return Shift(midnight + timedelta(hours=8), midnight + timedelta(hours=20), end_inclusive)
    raise ValueError(f"unknown shift {shift!r}")


def exclude_flagged_persons(
    df: DataFrame, attributes: DataFrame, attribute: str, person: str = "patient_id",
    value: str = "true", include_voided: bool = False,
) -> DataFrame:
    """Drop persons that carry the attribute (test patients).

    ``include_voided`` also honours soft-deleted attribute rows.  The value matches in
    any letter case.
    """
    flagged = attributes.filter((F.col("attribute_type") == attribute) & (F.lower("value") == value.lower()))
    if not include_voided:
        flagged = not_voided(flagged)
    flagged = flagged.select(F.col("person_id").alias(person)).distinct()
    return df.join(flagged, person, "left_anti")


def age_gate(
    df: DataFrame, birthdate: str, place: str, as_of: Column, infant_places: Sequence, adult_years: int = 10,
) -> DataFrame:
    """Adults' places keep ages of at least ``adult_years``, infants' places age 0."""
    age = complete_units("YEAR", F.col(birthdate), as_of)
    infant = F.col(place).isin(list(infant_places))
    return df.filter(F.col(birthdate).isNotNull() & F.when(infant, age <= 0).otherwise(age >= adult_years))


def open_interval(df: DataFrame, stop: str = "date_stopped") -> DataFrame:
    return df.filter(F.col(stop).isNull())


def year_overlap(df: DataFrame, start: str, stop: str, first_year: int, last_year: int) -> DataFrame:
    """Intervals that stop in or after the first year and start in or before the last."""
    return df.filter(
        (F.col(stop) >= moment(datetime(first_year, 1, 1))) & (F.col(start) < moment(datetime(last_year + 1, 1, 1)))
    )


def ilike_class(df: DataFrame, column: str, classes: Sequence[tuple[str, Sequence[str]]], out: str, otherwise: str) -> DataFrame:
    """Label from the first class with a matching pattern."""
    label = F.lit(otherwise)
    for name, patterns in reversed(list(classes)):
        label = F.when(ilike_any(F.col(column), patterns), F.lit(name)).otherwise(label)
    return df.withColumn(out, label)


def uuid_like(df: DataFrame, column: str) -> DataFrame:
    return df.filter(is_uuid(F.col(column)))


def identifier_format(identifiers: DataFrame, types: DataFrame) -> DataFrame:
    """Valid and invalid counts per identifier type; a type without a format accepts all."""
    joined = identifiers.join(types, "identifier_type")
    valid = F.coalesce(F.col("format"), F.lit("")) == ""
    valid = valid | F.coalesce(F.expr("identifier RLIKE format"), F.lit(False))
    return joined.groupBy("identifier_type").agg(
        F.count_if(valid).alias("valid"), F.count_if(~valid).alias("invalid")
    )
