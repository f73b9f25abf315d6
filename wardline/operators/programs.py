"""Enrolments, program states, admissions and deliveries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.filters import not_voided
from wardline.operators.ranking import first_rows, latest_per_key
from wardline.operators.slices import range_join
from wardline.operators.sweeps import previous_values


def current_program_state(
    enrolments: DataFrame, states: DataFrame, workflow_states: DataFrame, workflow, label_table: DataFrame, at: Column | None = None,
) -> DataFrame:
    """State label of each enrolment in a workflow, open at ``at`` or open now."""
    rows = not_voided(states).join(
        workflow_states.filter(F.col("program_workflow_id") == workflow).select(
            F.col("program_workflow_state_id").alias("state"), "concept_id"
        ),
        "state",
    )
    if at is None:
        rows = rows.filter(F.col("end_date").isNull())
    else:
        rows = rows.filter((F.col("start_date") <= at) & (F.col("end_date").isNull() | (F.col("end_date") >= at)))
    rows = rows.join(label_table, "concept_id", "left")
    best = latest_per_key(rows, ["patient_program_id"], ["start_date", "patient_state_id"], ["label"])
    return enrolments.join(best.withColumnRenamed("label", "program_state"), "patient_program_id", "left")


def state_ended_on(enrolments: DataFrame, states: DataFrame, workflow_states: DataFrame, label_table: DataFrame, day: str, out: str) -> DataFrame:
    """Label of the state that ended on the day of the ``day`` column."""
    rows = states.join(
        workflow_states.select(F.col("program_workflow_state_id").alias("state"), "concept_id"), "state"
    ).join(label_table, "concept_id", "left").select(
        "patient_program_id", F.to_date("end_date").alias("_day"), "start_date", "patient_state_id", "label"
    )
    best = latest_per_key(rows, ["patient_program_id", "_day"], ["start_date", "patient_state_id"], ["label"])
    best = best.withColumnRenamed("label", out)
    return enrolments.withColumn("_day", F.to_date(day)).join(best, ["patient_program_id", "_day"], "left").drop("_day")


def most_recent_enrolment(enrolments: DataFrame, program, columns: Sequence[str] = ("patient_program_id", "date_enrolled")) -> DataFrame:
    """The latest enrolment of each patient in a program."""
    rows = not_voided(enrolments).filter(F.col("program_id") == program)
    return latest_per_key(rows, ["patient_id"], ["date_enrolled", "patient_program_id"], list(columns))


def latest_encounter_since(encounters: DataFrame, types: Sequence, since: DataFrame | None = None, since_column: str = "since") -> DataFrame:
    """Latest encounter of the types per patient, at or after a per-patient time."""
    rows = not_voided(encounters).filter(F.col("encounter_type").isin(list(types)))
    if since is not None:
        rows = rows.join(since.select("patient_id", since_column), "patient_id", "left")
        rows = rows.filter(F.col(since_column).isNull() | (F.col("encounter_datetime") >= F.col(since_column)))
    return latest_per_key(
        rows, ["patient_id"], ["encounter_datetime", "encounter_id"], ["encounter_id", "encounter_datetime", "location_id"]
    )


def current_location(encounters: DataFrame, enter_types: Sequence, leave_types: Sequence) -> DataFrame:
    """Where each patient was last admitted or moved, at or after the latest discharge.

    One aggregate: per patient the latest leave time and the latest entry.
    """
    rows = not_voided(encounters)
    entry = F.col("encounter_type").isin(list(enter_types))
    leave = F.col("encounter_type").isin(list(leave_types))
    seen = rows.filter(entry | leave).groupBy("patient_id").agg(
        F.max(F.when(leave, F.col("encounter_datetime"))).alias("_left"),
        F.max(F.when(entry, F.struct("encounter_datetime", "encounter_id", "location_id"))).alias("_in"),
    )
    inside = F.col("_in").isNotNull() & (F.col("_left").isNull() | (F.col("_in.encounter_datetime") >= F.col("_left")))
    return seen.select("patient_id", F.when(inside, F.col("_in.location_id")).alias("location_id"))


def present_patients(encounters: DataFrame, open_visits: DataFrame, enter_types: Sequence, leave_types: Sequence, places: Sequence) -> DataFrame:
    """(place, patient) pairs still present: in an open visit, with no later leave
    and no later entry elsewhere.

    Entries shrink to one row per patient and place before anything is compared,
    so a busy patient costs no more than the number of places.
    """
    rows = not_voided(encounters)
    entry = F.col("encounter_type").isin(list(enter_types))
    leave = F.col("encounter_type").isin(list(leave_types))
    events = rows.filter(entry | leave).join(
        open_visits.select("visit_id", F.lit(True).alias("_open")), "visit_id", "left"
    )
    anchor = entry & F.col("_open") & F.col("location_id").isin(list(places))
    by_place = events.groupBy("patient_id", "location_id").agg(
        F.max(F.when(entry, F.col("encounter_datetime"))).alias("_entry"),
        F.max(F.when(anchor, F.col("encounter_datetime"))).alias("_anchor"),
        F.max(F.when(leave, F.col("encounter_datetime"))).alias("_leave"),
    )
    # One small row per place: the patient's list of places is bounded by the wards.
    whole = by_place.groupBy("patient_id").agg(
        F.max("_leave").alias("_left"),
        F.collect_list(F.struct("location_id", "_entry", "_anchor")).alias("_places"),
    )
    exploded = whole.select("patient_id", "_left", "_places", F.explode("_places").alias("p"))
    others = F.filter(F.col("_places"), lambda q: (q["location_id"] != F.col("p.location_id")) & (q["_entry"] > F.col("p._anchor")))
    return exploded.filter(
        F.col("p._anchor").isNotNull()
        & (F.col("_left").isNull() | (F.col("_left") <= F.col("p._anchor")))
        & (F.size(others) == 0)
    ).select(F.col("p.location_id").alias("location_id"), "patient_id")


def previous_location(encounters: DataFrame, by: Sequence[str] = ("patient_id",), quirk: bool = False) -> DataFrame:
    """Previous admission or transfer place of each row.

    The default is the row before.  ``quirk`` takes the latest *other* row of the
    key, even when it comes later.
    """
    if not quirk:
        out = previous_values(encounters, by, "encounter_datetime", ["encounter_id"], ["location_id"])
        return out.withColumnRenamed("previous_location_id", "previous_location")
    two = first_rows(
        encounters.select(*by, "encounter_datetime", "encounter_id", "location_id"), by,
        [F.col("encounter_datetime").desc(), F.col("encounter_id").desc()], 2, "_rank",
    ).groupBy(*by).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("encounter_id"))).alias("_top"),
        F.max(F.when(F.col("_rank") == 1, F.col("location_id"))).alias("_first"),
        F.max(F.when(F.col("_rank") == 2, F.col("location_id"))).alias("_second"),
    )
    joined = encounters.join(two, list(by))
    other = F.when(F.col("encounter_id") == F.col("_top"), F.col("_second")).otherwise(F.col("_first"))
    return joined.select(*encounters.columns, other.alias("previous_location"))


def born_in_facility(visits: DataFrame, attributes: DataFrame, attribute) -> DataFrame:
    """``inborn`` when the visit carries the live attribute ``true`` in any letter case, else ``outborn``."""
    flagged = not_voided(attributes).filter(
        (F.col("attribute_type_id") == attribute) & (F.lower("value_reference") == "true")
    ).select("visit_id", F.lit("inborn").alias("_born")).distinct()
    return visits.join(flagged, "visit_id", "left").withColumn(
        "inborn_outborn", F.coalesce(F.col("_born"), F.lit("outborn"))
    ).drop("_born")


def latest_lab(obs: DataFrame, encounters: DataFrame, types: Sequence, concept) -> DataFrame:
    """Date and value of the latest live result of a test per person."""
    enc = not_voided(encounters).filter(F.col("encounter_type").isin(list(types))).select("encounter_id", "encounter_datetime")
    rows = not_voided(obs).filter((F.col("concept_id") == concept) & F.col("value_numeric").isNotNull()).join(enc, "encounter_id")
    return latest_per_key(
        rows, ["person_id"], ["encounter_datetime", "obs_datetime", "obs_id"], ["encounter_datetime", "value_numeric"]
    ).withColumnsRenamed({"encounter_datetime": "lab_date", "value_numeric": "lab_value"})


def lab_orders(orders: DataFrame, flags: dict, test_type, label_table: DataFrame, separator: str = "|") -> DataFrame:
    """Per encounter: a flag per ordered concept and the list of ordered tests."""
    from wardline.operators.observations import joined_labels, with_labels

    rows = with_labels(not_voided(orders), label_table, on="concept_id")
    return rows.groupBy("encounter_id").agg(
        *[F.bool_or(F.col("concept_id") == concept).alias(name) for name, concept in flags.items()],
        joined_labels(F.collect_set(F.when(F.col("order_type_id") == test_type, F.col("label"))), separator).alias("tests_ordered"),
    )


def in_state_at(obs: DataFrame, states: DataFrame, enrolments: DataFrame, state, as_of: Column, unit: str = "month") -> DataFrame:
    """Observation ids recorded while the person was in the program state."""
    spans = not_voided(states).filter(F.col("state") == state).join(
        not_voided(enrolments).select("patient_program_id", F.col("patient_id").alias("person_id")), "patient_program_id"
    ).select("person_id", F.col("start_date").alias("_from"), F.col("end_date").alias("_to"))
    slim = obs.select("person_id", "obs_id", "obs_datetime")
    return range_join(slim, spans, ["person_id"], "obs_datetime", "_from", "_to", as_of, unit, grain="day").select("obs_id").distinct()
