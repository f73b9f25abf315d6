"""Named clinical rules as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.dates import complete_units, days_between, second_of_day

# Labels and limits the results must carry.
LOST = "Lost to followup"
LOST_VISIT_DAYS = 90
LOST_APPOINTMENT_DAYS = 180
CONTROL_LABELS = ("Well controlled", "Partly controlled", "Uncontrolled")
THREE_MONTH_DAYS = 91.2501
SIX_MONTH_DAYS = 182.5
RECENT_VISIT_DAYS = 14
RETROSPECTIVE_SECONDS = 1800


def age_at(birthdate: Column, at: Column) -> Column:
    """Complete years; null without a birthdate."""
    return complete_units("YEAR", birthdate, at)


def gestational_age_weeks(
    lmp: Column, lmp_at: Column, entered: Column, entered_at: Column,
    delivery: Column, delivery_at: Column, enrolled: Column, as_of: Column,
) -> Column:
    """Weeks from the last period, else weeks entered plus weeks since entry.

    Each input counts only when it was recorded on or after the enrolment day.
    """
    def valid(value: Column, at: Column) -> Column:
        return F.when(F.to_date(at) >= F.to_date(enrolled), value)

    end = F.coalesce(valid(delivery, delivery_at), as_of)
    period = valid(lmp, lmp_at)
    weeks = valid(entered, entered_at)
    return F.when(
        period.isNotNull(), complete_units("WEEK", F.to_date(period).cast("timestamp_ntz"), end).cast("double")
    ).otherwise(weeks + complete_units("WEEK", valid(entered_at, entered_at), end))


def first_match(choices: Sequence[tuple[Column, str]]) -> Column:
    """The label of the first true flag, in order."""
    out = None
    for flag, label in choices:
        out = F.when(flag, F.lit(label)) if out is None else out.when(flag, F.lit(label))
    return out


def symptom_control(answers: Sequence[Column], yes: Column) -> Column:
    """Four yes/no answers to a control class; any missing answer gives null."""
    missing = F.lit(False)
    score = F.lit(0)
    for answer in answers:
        missing = missing | answer.isNull()
        score = score + F.when(answer == yes, 1).otherwise(0)
    well, partly, bad = CONTROL_LABELS
    return F.when(~missing, F.when(score >= 3, bad).when(score >= 1, partly).otherwise(well))


def reporting_outcome(
    outcome: Column, outcome_at: Column, last_visit: Column, enrolled: Column,
    appointment: Column, as_of: Column,
) -> Column:
    """The recorded outcome, or lost when visit and appointment are both long past."""
    lost = (
        (days_between(F.coalesce(last_visit, enrolled), as_of) > LOST_VISIT_DAYS)
        & (days_between(appointment, as_of) > LOST_APPOINTMENT_DAYS)
        & outcome_at.isNull()
    )
    return F.when(lost, F.lit(LOST)).otherwise(outcome)


def followup_flags(last_visit: Column, next_visit: Column, as_of: Column, yes: str = "Oui", no: str = "No") -> dict[str, Column]:
    """Time since the last visit, set only for rows that have a scheduled visit.

    A missing last visit is not within 14 days and counts as overdue.
    """
    since = days_between(last_visit, as_of)
    scheduled = next_visit.isNotNull()

    def flag(condition: Column, then: str, otherwise: str) -> Column:
        return F.when(scheduled, F.when(condition, then).otherwise(otherwise))

    return {
        "came_within_14_days": flag(since <= RECENT_VISIT_DAYS, yes, no),
        "over_three_months": flag(since <= THREE_MONTH_DAYS, no, yes),
        "over_six_months": flag(since <= SIX_MONTH_DAYS, no, yes),
    }


def days_in_care(enrolled: Column, completed: Column, as_of: Column) -> Column:
    return days_between(enrolled, F.coalesce(completed, as_of))


def retrospective(created: Column, event: Column, clock_only: bool = False) -> Column:
    """Entered more than half an hour after the event.

    ``clock_only`` compares the time of day alone, so an entry made a day later at
    the same hour looks immediate; the default compares full timestamps.
    """
    if clock_only:
        return second_of_day(created) - second_of_day(event) > RETROSPECTIVE_SECONDS
    return complete_units("SECOND", event, created) > RETROSPECTIVE_SECONDS


def any_dispensed(quantities: Sequence[Column]) -> Column:
    """1 when any quantity is above zero, else 0."""
    found = F.lit(False)
    for quantity in quantities:
        found = found | F.coalesce(quantity > 0, F.lit(False))
    return found.cast("int")


def body_mass_index(weight_kg: Column, height_cm: Column) -> Column:
    """kg over metres squared, one decimal; null without a positive height."""
    metres = height_cm / 100
    return F.when(height_cm > 0, F.round(weight_kg / (metres * metres), 1))


def class_flags(classes: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Flag per drug class over the quantity columns that make up the class."""
    return {name: any_dispensed([F.col(c) for c in columns]) for name, columns in classes.items()}
