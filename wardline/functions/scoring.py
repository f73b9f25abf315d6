"""Vital-sign bands and the priority they add up to."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.  Each band is (low, low_open, high, high_open, score); None is
# unbounded and bands are tried in order.  A value in no band scores 0, also where
# two bands leave a gap (29.5 breaths), and so does a missing value.
INFANT_BANDS: dict[str, list[tuple]] = {
    "heart_rate": [
        (None, False, 79, False, 3),
        (80, False, 99, False, 1),
        (160, False, 174, False, 1),
        (175, False, None, False, 3),
    ],
    "respiratory_rate": [
        (None, False, 25, False, 3),
        (80, False, None, False, 3),
        (26, False, 29, False, 1),
        (60, False, 79, False, 1),
    ],
    "temperature_c": [
        (None, False, 36, False, 3),
        (38, False, None, False, 3),
        (36, False, 36.5, False, 1),
        (37.5, False, 37.9, False, 1),
    ],
    "o2_sat": [
        (None, False, 89, False, 3),
        (90, False, 94, False, 1),
    ],
    "glucose": [
        (None, False, 2.6, True, 3),
        (8.3, True, None, False, 3),
    ],
}

MATERNAL_BANDS: dict[str, list[tuple]] = {
    "bp_systolic": [
        (None, False, 79, False, 3),
        (139, True, 160, True, 1),
        (160, False, None, False, 3),
    ],
    "bp_diastolic": [
        (None, False, 50, False, 3),
        (89, True, 110, True, 1),
        (110, False, None, False, 3),
    ],
    "heart_rate": [
        (None, False, 39, False, 3),
        (None, False, 50, True, 2),
        (119, True, 131, True, 2),
        (131, False, None, False, 3),
    ],
    "respiratory_rate": [
        (None, False, 12, True, 2),
        (26, True, None, False, 2),
    ],
    "temperature_c": [
        (None, False, 34.9, False, 3),
        (40, False, None, False, 3),
        (38, False, 38.2, False, 1),
        (38.2, True, 40, True, 2),
    ],
    "o2_sat": [
        (None, False, 93, False, 3),
        (None, False, 96, True, 2),
    ],
    "fhr": [
        (None, False, 109, False, 3),
        (161, False, None, False, 3),
    ],
    "fhr_second": [
        (None, False, 109, False, 3),
        (161, False, None, False, 3),
    ],
}

# Sum of scores to priority; any larger sum is the last one.
PRIORITIES = ("Normal", "Prompt", "Urgent", "STAT")

PROFILES = {"infant": INFANT_BANDS, "maternal": MATERNAL_BANDS}


def band_score(value: Column, bands: list[tuple]) -> Column:
    """Score of the first band holding the value."""
    out = F.lit(0)
    for low, low_open, high, high_open, score in reversed(bands):
        inside = F.lit(True)
        if low is not None:
            inside = inside & ((value > low) if low_open else (value >= low))
        if high is not None:
            inside = inside & ((value < high) if high_open else (value <= high))
        out = F.when(inside, score).otherwise(out)
    return F.when(value.isNull(), 0).otherwise(out)


def vitals_scores(profile: str, columns: Mapping[str, str] | None = None) -> dict[str, Column]:
    """One score column per vital of the profile."""
    columns = columns or {}
    return {
        f"{vital}_score": band_score(F.col(columns.get(vital, vital)), bands)
        for vital, bands in PROFILES[profile].items()
    }


def vitals_total(profile: str, columns: Mapping[str, str] | None = None) -> Column:
    total = F.lit(0)
    for score in vitals_scores(profile, columns).values():
        total = total + score
    return total


def priority_label(total: Column) -> Column:
    normal, prompt, urgent, stat = PRIORITIES
    return F.when(total == 0, normal).when(total == 1, prompt).when(total == 2, urgent).otherwise(stat)


def vitals_priority(profile: str, columns: Mapping[str, str] | None = None) -> Column:
    return priority_label(vitals_total(profile, columns))
