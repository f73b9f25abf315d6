"""Reference ranges and duplicate-person candidates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.dates import days_between

# Vital ranges as (vital, condition, absolute low, critical low,
# normal low, normal high, critical high, absolute high).
VITAL_RANGES = [
    ("systolic_blood_pressure", "newborn", 30, None, None, None, None, 300),
    ("systolic_blood_pressure", "antenatal", 30, 79, 80, 159, 160, 300),
    ("diastolic_blood_pressure", "newborn", 20, None, None, None, None, 200),
    ("diastolic_blood_pressure", "antenatal", 20, 50, 51, 109, 110, 200),
    ("pulse", "newborn", 0, 79, 80, 174, 175, 300),
    ("pulse", "antenatal", 0, 39, 50, 119, 131, 300),
    ("respiratory_rate", "newborn", 0, 25, 26, 79, 80, 120),
    ("respiratory_rate", "antenatal", 0, None, 12, 26, None, 120),
    ("oxygen_saturation", "newborn", 30, 89, 90, 100, None, 100),
    ("oxygen_saturation", "antenatal", 30, 93, 96, 100, None, 100),
    ("temperature", "newborn", 25, 36, 36.1, 37.9, 38, 43),
    ("temperature", "antenatal", 25, 34.9, 35, 38.2, 40, 43),
    ("fetal_heart_rate", "antenatal", 0, 109, 110, 160, 161, 250),
]

# Fixed value: the newborn condition covers days 0 to 29 of life.
NEWBORN_DAYS = 30


def newborn(birthdate: Column, at: Column) -> Column:
    age = days_between(birthdate, at)
    return F.coalesce((age >= 0) & (age < NEWBORN_DAYS), F.lit(False))


def range_flag(value: Column, bounds: Sequence) -> Column:
    """Where a value lies among six bounds; missing bounds are not tested.

    Worst first: outside the absolute bounds, critical, outside normal, normal.
    """
    absolute_low, critical_low, normal_low, normal_high, critical_high, absolute_high = bounds
    tests = [
        ("below_absolute", absolute_low, lambda b: value < b),
        ("above_absolute", absolute_high, lambda b: value > b),
        ("critical_low", critical_low, lambda b: value <= b),
        ("critical_high", critical_high, lambda b: value >= b),
        ("low", normal_low, lambda b: value < b),
        ("high", normal_high, lambda b: value > b),
    ]
    out = F.lit("normal")
    for name, bound, test in reversed(tests):
        if bound is not None:
            out = F.when(test(F.lit(float(bound))), F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def flag_reference_range(
    obs: DataFrame, concepts: Mapping[str, int], conditions: Mapping[str, Column], ranges=VITAL_RANGES,
) -> DataFrame:
    """Range flag per observation and condition that applies to it.

    ``concepts`` maps vital names to concept ids and ``conditions`` condition names
    to boolean columns.  The ranges are a fixed table, so they become a chain of
    comparisons inside the scan's projection instead of a join.
    """
    flags = {}
    for condition, applies in conditions.items():
        chain = F.lit(None).cast("string")
        for vital, of, *bounds in ranges:
            if of == condition and vital in concepts:
                chain = F.when(
                    F.col("concept_id") == concepts[vital], range_flag(F.col("value_numeric"), bounds)
                ).otherwise(chain)
        flags[f"{condition}_flag"] = F.when(applies, chain)
    known = [concepts[v] for v in dict.fromkeys(r[0] for r in ranges) if v in concepts]
    return obs.filter(F.col("concept_id").isin(known)).withColumns(flags)


# Weight of agreement per field.
SIMILARITY_WEIGHTS = {"village": 1, "section": 1, "mothers_first_name": 3, "phone": 20}


def sufficient_fields(weights: Mapping[str, int], threshold: int) -> list[tuple[str, ...]]:
    """Smallest field sets whose weights reach the threshold.

    Any two persons that reach it agree on all fields of at least one of them.
    """
    found: list[tuple[str, ...]] = []
    for size in range(1, len(weights) + 1):
        for fields in combinations(weights, size):
            if any(set(smaller) <= set(fields) for smaller in found):
                continue
            if sum(weights[f] for f in fields) >= threshold:
                found.append(fields)
    return found


def similar_patients(
    persons: DataFrame, weights: Mapping[str, int] = SIMILARITY_WEIGHTS, threshold: int = 5, person: str = "person_id",
) -> DataFrame:
    """Likely duplicates as (anchor, person, fields agreed on, score).

    Persons that share all fields of a sufficient set form a group whose lowest id
    is the anchor, and every member is linked to the anchor only.  A group of n
    gives n - 1 rows, so a placeholder shared by a third of all persons stays
    linear, and no qualifying pair is lost: both sit in the same group.
    """
    parts = []
    for fields in sufficient_fields(weights, threshold):
        present = persons
        for field in fields:
            present = present.filter(F.col(field).isNotNull())
        heads = present.groupBy(*fields).agg(
            F.min(F.struct(person, *[F.col(f).alias(f"_{f}") for f in weights])).alias("_head"),
            F.count(F.lit(1)).alias("_size"),
        ).filter(F.col("_size") > 1)
        members = present.join(heads, list(fields)).filter(F.col(person) != F.col(f"_head.{person}"))
        score = F.lit(0)
        for field, weight in weights.items():
            equal = F.coalesce(F.col(field) == F.col(f"_head._{field}"), F.lit(False))
            score = score + F.when(equal, weight).otherwise(0)
        parts.append(
            members.select(
                F.col(f"_head.{person}").alias("anchor_id"), F.col(person),
                F.lit("+".join(fields)).alias("agreed_on"), score.alias("score"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

