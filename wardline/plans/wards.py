"""Ward handoff: census, activity, deliveries, deaths and their bundle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.clinical import age_at, gestational_age_weeks
from wardline.functions.dates import readable_datetime
from wardline.operators import aggregates as ag
from wardline.operators import observations as ob
from wardline.operators.filters import Shift, age_gate, not_voided, open_interval, shift_window
from wardline.operators.intervals import exact_time_join
from wardline.operators.programs import present_patients, previous_location, state_ended_on
from wardline.operators.ranking import latest_per_key
from wardline.plans.clinic import Clinic

# Labels of the census rows that are not a single location.
THEATRE = "PACU/Pre-Op"
NURSERY_INBORN = "NICU Inborn"
NURSERY_OUTBORN = "NICU Outborn"
NURSERY_OTHER = "NICU Other"
NURSERY_UNASSIGNED = "NICU Unassigned"


def _ward_label(places: Mapping) -> Column:
    """Row label of a location and bed; the in-born pattern is tested first."""
    place, bed = F.col("location_id"), F.col("bed_number")
    nursery = place == places["newborn"]
    return (
        F.when(place.isin(list(places["theatre"])), THEATRE)
        .when(nursery & bed.ilike("%inborn%"), NURSERY_INBORN)
        .when(nursery & bed.ilike("%outborn%"), NURSERY_OUTBORN)
        .when(nursery & bed.isNotNull(), NURSERY_OTHER)
        .when(nursery, NURSERY_UNASSIGNED)
        .otherwise(F.col("name"))
    )


def ward_census(clinic: Clinic) -> DataFrame:
    """Patients present and free beds per ward.

    ``places``: ``census`` wards counted, ``census_rows`` wards listed by name,
    ``theatre`` wards joined in one row, ``newborn`` the nursery.
    """
    places = clinic.places
    present = present_patients(
        clinic["encounter"], open_interval(clinic["visit"]), [*clinic.types["admission"], *clinic.types["transfer"]],
        clinic.types["discharge"], places["census"],
    )
    present = clinic.with_person(present, {"birthdate": "birthdate"})
    present = age_gate(present, "birthdate", "location_id", clinic.as_of, [places["newborn"]])
    beds = clinic["bed"].select("bed_id", "bed_number")
    # A patient has one bed; with several open assignments the lowest bed counts.
    held = open_interval(clinic["bed_patient_assignment_map"]).join(beds, "bed_id").groupBy("patient_id").agg(
        F.min(F.struct("bed_id", "bed_number"))["bed_number"].alias("bed_number")
    )
    names = clinic["location"].select("location_id", "name")
    counted = present.join(held, "patient_id", "left").join(names, "location_id")
    census = counted.groupBy(_ward_label(places).alias("ward")).agg(F.count(F.lit(1)).alias("current_census"))
    taken = open_interval(not_voided(clinic["bed_patient_assignment_map"])).select("bed_id")
    free = (
        clinic["bed_location_map"].join(not_voided(clinic["bed"]).select("bed_id", "bed_number"), "bed_id")
        .join(names, "location_id").join(taken, "bed_id", "left_anti")
        .groupBy(_ward_label(places).alias("ward")).agg(F.count(F.lit(1)).alias("free_beds"))
    )
    listed = names.filter(F.col("location_id").isin(list(places["census_rows"]))).select(F.col("name").alias("ward"))
    # The special rows ride on the location table so that the scaffold is one plan.
    special = names.select(F.explode(F.array(*[
        F.lit(label) for label in (THEATRE, NURSERY_INBORN, NURSERY_OUTBORN, NURSERY_OTHER, NURSERY_UNASSIGNED)
    ])).alias("ward")).distinct()
    counts = census.join(free, "ward", "full")
    return ag.scaffold_zero_fill(
        listed.unionByName(special), counts, "ward", ["current_census", "free_beds"], [NURSERY_OTHER, NURSERY_UNASSIGNED]
    )


def ward_activity(clinic: Clinic, shift: Shift, quirk: bool = False) -> DataFrame:
    """Admissions, transfers in and out, and discharges per ward in a shift.

    A transfer in counts as a transfer out of the patient's previous place in the
    same visit.  ``quirk`` takes the latest other place instead of the one before.
    """
    wards = list(clinic.places["activity"])
    enter = [*clinic.types["admission"], *clinic.types["transfer"]]
    kind = F.col("encounter_type")
    moves = not_voided(clinic["encounter"]).filter(F.col("location_id").isin(wards))
    now = moves.filter(kind.isin([*enter, *clinic.types["discharge"]]) & shift.covers(F.col("encounter_datetime")))
    transfers = now.filter(kind.isin(list(clinic.types["transfer"])))
    # Only visits with a transfer in this shift are searched for the place before.
    history = moves.filter(kind.isin(enter)).join(
        transfers.select("patient_id", "visit_id").distinct(), ["patient_id", "visit_id"], "left_semi"
    )
    by = ["patient_id"] if quirk else ["patient_id", "visit_id"]
    placed = previous_location(history, by, quirk=quirk)
    outs = placed.filter(kind.isin(list(clinic.types["transfer"])) & shift.covers(F.col("encounter_datetime"))).filter(
        F.col("previous_location").isNotNull()
    )
    events = now.select("location_id", "encounter_type", F.lit(False).alias("_out")).unionByName(
        outs.select(F.col("previous_location").alias("location_id"), "encounter_type", F.lit(True).alias("_out"))
    )
    inward = ~F.col("_out")
    counts = ag.conditional_counts(events, ["location_id"], {
        "admissions": inward & kind.isin(list(clinic.types["admission"])),
        "transfers_in": inward & kind.isin(list(clinic.types["transfer"])),
        "transfers_out": F.col("_out"),
        "discharges": inward & kind.isin(list(clinic.types["discharge"])),
    })
    rows = clinic["location"].filter(F.col("location_id").isin(wards)).select("location_id", F.col("name").alias("ward"))
    measures = ["admissions", "transfers_in", "transfers_out", "discharges"]
    return ag.scaffold_zero_fill(rows, counts, "location_id", measures).join(rows, "location_id").select("ward", *measures)


# The rows and columns of the delivery summary.
OUTCOMES = ("Livebirth", "Fresh Stillbirth", "Macerated Stillbirth", "No Outcome")
DELIVERY_KINDS = ("c_section", "vacuum", "vaginal")


def delivery_summary(clinic: Clinic, shift: Shift) -> DataFrame:
    """Births of a shift by outcome and type of delivery, with a total row.

    A type other than the three listed counts nowhere, not even in the total, and
    an outcome other than the listed ones has no row.
    """
    codes = clinic.codes
    deliveries = clinic.encounters("delivery").select("encounter_id")
    asked, live = clinic.obs_at([codes["delivery_datetime"]], "value_datetime", shift.start, shift.end)
    births = asked.filter(shift.covers(F.col("value_datetime"))).join(deliveries, "encounter_id", "left_semi").select("obs_group_id").distinct()
    facts = live.join(births, "obs_group_id", "left_semi")
    wants = [ob.peak("outcome", codes["birth_outcome"], "label"), ob.peak("kind", codes["delivery_type"], "value_coded")]
    babies = ob.group_values(facts, wants, clinic.labels)
    measures = [*DELIVERY_KINDS, "missing_delivery_type"]
    counts = ag.conditional_counts(
        babies.withColumn("outcome", F.coalesce("outcome", F.lit("No Outcome"))), ["outcome"],
        {**{name: F.col("kind") == codes[name] for name in DELIVERY_KINDS}, "missing_delivery_type": F.col("kind").isNull()},
    )
    kept = counts.filter(F.col("outcome").isin(list(OUTCOMES)))
    totals = ag.total_row(kept, "outcome", measures)
    rows = clinic["location"].select(F.explode(F.array(*[F.lit(o) for o in (*OUTCOMES, "Total")])).alias("outcome")).distinct()
    out = ag.scaffold_zero_fill(rows, totals, "outcome", measures, ["No Outcome"])
    total = sum((F.col(m) for m in measures[1:]), F.col(measures[0]))
    return out.select("outcome", *measures, total.alias("total"))


def death_list(clinic: Clinic, shift: Shift) -> DataFrame:
    """Deaths in a shift of patients whose last visit touched the wards."""
    codes = clinic.codes
    dead = clinic["person"].filter(shift.covers(F.col("death_date"))).select(
        F.col("person_id").alias("patient_id"), "birthdate", "death_date", "cause_of_death"
    )
    keys = dead.select("patient_id")
    visits = clinic["visit"].join(keys, "patient_id", "left_semi")
    last = latest_per_key(visits, ["patient_id"], ["date_started", "visit_id"], ["visit_id"])
    touched = clinic["encounter"].filter(F.col("location_id").isin(list(clinic.places["deaths"]))).select("visit_id")
    rows = dead.join(last.join(touched, "visit_id", "left_semi").select("patient_id"), "patient_id", "left_semi")
    enrolled = clinic["patient_program"].filter(F.col("program_id") == clinic.programs["pregnancy"])
    enrolled = latest_per_key(
        enrolled, ["patient_id", "date_completed"], ["date_enrolled", "patient_program_id"], ["patient_program_id", "date_enrolled"]
    )
    matched = exact_time_join(
        rows.select("patient_id", F.col("death_date").alias("at")), enrolled, "patient_id", "at", "date_completed",
        ["patient_program_id", "date_enrolled"],
    ).withColumnRenamed("at", "death_date")
    matched = state_ended_on(
        matched, clinic["patient_state"], clinic["program_workflow_state"], clinic.labels, "death_date", "pregnancy_status"
    )
    rows = rows.join(matched.select("patient_id", "patient_program_id", "date_enrolled", "pregnancy_status"), "patient_id", "left")
    own = clinic.person_obs(keys.withColumnRenamed("patient_id", "person_id"))

    def latest(role: str, value: str, name: str) -> DataFrame:
        facts = own.filter(F.col("concept_id") == codes[role])
        return latest_per_key(facts, ["person_id"], ["obs_datetime", "obs_id"], [value, "obs_datetime"]).select(
            F.col("person_id").alias("patient_id"), F.struct(F.col(value).alias("v"), F.col("obs_datetime").alias("at")).alias(name)
        )

    for part in (
        latest("last_menstrual_period", "value_datetime", "lmp"),
        latest("delivery_datetime", "value_datetime", "birth"),
        latest("gestational_age", "value_numeric", "weeks"),
    ):
        rows = rows.join(part, "patient_id", "left")
    weeks = gestational_age_weeks(
        F.col("lmp.v"), F.col("lmp.at"), F.col("weeks.v"), F.col("weeks.at"), F.col("birth.v"), F.col("birth.at"),
        F.col("date_enrolled"), clinic.as_of,
    )
    rows = clinic.with_identifiers(rows, ["emr_id"])
    rows = clinic.with_name(rows, "patient_name")
    rows = clinic.with_label(rows, "cause_of_death", "cause")
    return rows.select(
        "emr_id", "patient_name", age_at(F.col("birthdate"), F.col("death_date")).alias("age_at_death"),
        readable_datetime(F.col("death_date")).alias("time_of_death"), F.col("cause").alias("cause_of_death"),
        "pregnancy_status", weeks.alias("gestational_age"), "death_date",
    ).orderBy("death_date").drop("death_date")


def shift_handoff(clinic: Clinic, day, shift: str, quirk: bool = False) -> dict[str, DataFrame]:
    """The data sets of one handoff; nothing runs until one is read.

    Deaths use a half-open shift, deliveries and activity a closed one.
    """
    closed = shift_window(day, shift, end_inclusive=True)
    return {
        "Current_Census": ward_census(clinic),
        "Deliveries": delivery_summary(clinic, closed),
        "Ward_Activity": ward_activity(clinic, closed, quirk),
        "Deaths": death_list(clinic, shift_window(day, shift)),
    }


def morning_handoff(clinic: Clinic, day) -> dict[str, DataFrame]:
    return shift_handoff(clinic, day, "morning")


def evening_handoff(clinic: Clinic, day) -> dict[str, DataFrame]:
    return shift_handoff(clinic, day, "evening")


def discharge_presets(clinic: Clinic, day, wards: Sequence[str]) -> dict[str, DataFrame]:
    """The discharge list of each preset ward, by role name of the place."""
    from wardline.plans.maternity import discharge_list

    return {ward: discharge_list(clinic, day, clinic.places[ward]) for ward in wards}
