"""Dashboard selections as tables for all patients."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.filters import not_voided
from wardline.operators.intervals import enrolment_window
from wardline.operators.observations import Want, collect_obs
from wardline.operators.programs import latest_encounter_since, most_recent_enrolment
from wardline.operators.ranking import first_rows, newest_dates
from wardline.functions.dates import readable_date, readable_time
from wardline.functions.text import reword


def _current(enrolments: DataFrame, program) -> DataFrame:
    return most_recent_enrolment(enrolments, program, ["patient_program_id", "date_enrolled", "date_completed"])


def obs_by_encounter(
    obs: DataFrame, encounters: DataFrame, enrolments: DataFrame, program, wants: Sequence[Want], n: int,
    as_of: Column, label_table: DataFrame | None = None,
) -> DataFrame:
    """Chosen columns of the newest n encounters with any of them, inside the current enrolment."""
    inside = enrolment_window(
        _current(enrolments, program), not_voided(encounters).select("patient_id", "encounter_id", "encounter_datetime"), as_of
    )
    wide = collect_obs(not_voided(obs), "encounter_id", wants, label_table)
    rows = inside.select("patient_id", "encounter_id", "encounter_datetime").join(wide, "encounter_id")
    return first_rows(rows, ["patient_id"], [F.col("encounter_datetime").desc(), F.col("encounter_id").desc()], n)


def obs_series(
    obs: DataFrame, enrolments: DataFrame, program, concept, as_of: Column, n: int = 100,
) -> DataFrame:
    """Newest n (time, value) points of one question inside the current enrolment."""
    points = not_voided(obs).filter((F.col("concept_id") == concept) & F.col("value_numeric").isNotNull()).select(
        F.col("person_id").alias("patient_id"), "obs_id", F.col("obs_datetime").alias("encounter_datetime"), "value_numeric"
    )
    inside = enrolment_window(_current(enrolments, program), points, as_of)
    rows = first_rows(inside, ["patient_id"], [F.col("encounter_datetime").desc(), F.col("obs_id").desc()], n)
    return rows.select("patient_id", "obs_id", F.col("encounter_datetime").alias("obs_datetime"), "value_numeric")


def discrete_values(
    obs: DataFrame, encounters: DataFrame, enrolments: DataFrame, program, wants: Sequence[Want], as_of: Column,
) -> DataFrame:
    """Several questions side by side per patient, inside the current enrolment."""
    points = not_voided(obs).withColumnRenamed("person_id", "patient_id")
    points = points.withColumn("encounter_datetime", F.col("obs_datetime"))
    inside = enrolment_window(_current(enrolments, program), points, as_of)
    return collect_obs(inside, "patient_id", wants)


def recent_results(obs: DataFrame, person: str, n: int) -> DataFrame:
    """The newest n results per person."""
    return first_rows(not_voided(obs), [person], [F.col("obs_datetime").desc(), F.col("obs_id").desc()], n)


def recent_dispenses(dispenses: DataFrame, by: str, at: str, n: int) -> DataFrame:
    """All dispenses on the newest n days per patient."""
    return newest_dates(not_voided(dispenses), [by], at, n)


def enrolment_history(enrolments: DataFrame, program) -> DataFrame:
    """Closed enrolments of a program."""
    return not_voided(enrolments).filter((F.col("program_id") == program) & F.col("date_completed").isNotNull())


def doses_received(obs: DataFrame, person: str, vaccines: Mapping[str, object]) -> DataFrame:
    """Number of doses and latest dose per vaccine and person."""
    rows = not_voided(obs).filter(F.col("concept_id").isin(list(vaccines.values())))
    return rows.groupBy(person).agg(
        *[
            column
            for name, concept in vaccines.items()
            for column in (
                F.count_if(F.col("concept_id") == concept).alias(f"{name}_doses"),
                F.max(F.when(F.col("concept_id") == concept, F.col("obs_datetime"))).alias(f"{name}_latest"),
            )
        ]
    )


def delivery_status(
    patients: DataFrame, enrolments: DataFrame, encounters: DataFrame, obs: DataFrame, persons: DataFrame,
    identifiers: DataFrame, wards: DataFrame, label_table: DataFrame, codes: Mapping[str, object],
    program, delivery_types: Sequence, babies: int = 3,
) -> DataFrame:
    """Latest delivery of every patient: date, time, type, live births and the babies.

    ``identifiers`` holds one identifier per person, ``wards`` the current ward name
    per person; both are joined for up to ``babies`` children.
    """
    from wardline.operators.observations import answer_list, tally, when

    start = most_recent_enrolment(enrolments, program).select("patient_id", F.col("date_enrolled").alias("since"))
    latest = latest_encounter_since(encounters, delivery_types, start).select("patient_id", "encounter_id")
    live = not_voided(obs)
    own = live.join(latest.select("encounter_id"), "encounter_id", "left_semi")
    wants = [
        when("delivered_at", codes["delivery_datetime"]),
        answer_list("delivery_type", codes["delivery_type"]),
        tally("number_babies", codes["birth_outcome"], codes["live_birth"]),
    ]
    facts = collect_obs(own, "encounter_id", wants, label_table)
    constructs = first_rows(
        own.filter(F.col("concept_id") == codes["baby_construct"]), ["encounter_id"], [F.col("obs_id")], babies, "_n"
    ).select("encounter_id", F.col("obs_id").alias("obs_group_id"), "_n")
    links = own.filter(F.col("concept_id") == codes["baby_link"]).groupBy("obs_group_id").agg(F.max(F.lower("comments")).alias("uuid"))
    child = (
        constructs.join(links, "obs_group_id")
        .join(persons.select(F.lower("uuid").alias("uuid"), F.col("person_id").alias("baby_id")), "uuid", "left")
        .join(identifiers.select(F.col("person_id").alias("baby_id"), "identifier"), "baby_id", "left")
        .join(wards.select(F.col("person_id").alias("baby_id"), "ward"), "baby_id", "left")
    )
    columns = []
    for i in range(1, babies + 1):
        here = F.col("_n") == i
        columns += [
            F.max(F.when(here, F.col("uuid"))).alias(f"baby{i}_uuid"),
            F.max(F.when(here, F.col("identifier"))).alias(f"baby{i}_identifier"),
            F.max(F.when(here, F.col("ward"))).alias(f"baby{i}_ward"),
        ]
    children = child.groupBy("encounter_id").agg(*columns)
    out = patients.select("patient_id").join(latest, "patient_id", "left").join(facts, "encounter_id", "left").join(
        children, "encounter_id", "left"
    )
    return out.select(
        "patient_id",
        readable_date(F.col("delivered_at")).alias("delivery_date"),
        readable_time(F.col("delivered_at")).alias("delivery_time"),
        F.col("delivered_at").isNotNull().cast("int").alias("were_there_deliveries"),
        F.coalesce(F.col("number_babies"), F.lit(0)).alias("number_babies"),
        reword(F.col("delivery_type"), {" | ": ", "}).alias("delivery_type"),
        *[F.col(c) for i in range(1, babies + 1) for c in (f"baby{i}_uuid", f"baby{i}_identifier", f"baby{i}_ward")],
        *[F.col(f"baby{i}_identifier").isNotNull().cast("int").alias(f"baby{i}_exists") for i in range(1, babies + 1)],
    )
