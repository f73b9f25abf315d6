"""Outpatient dispensing and the visit cohort extract."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.clinical import class_flags
from wardline.functions.dates import moment
from wardline.operators import dictionary as dc
from wardline.operators import observations as ob
from wardline.operators.filters import exclude_flagged_persons, not_voided, year_overlap
from wardline.operators.ranking import first_rows, latest_per_key
from wardline.operators.sweeps import asof_backward, number_rows
from wardline.plans.clinic import Clinic


def outpatient_visit_wants(codes: Mapping) -> list[ob.Want]:
    return [
        ob.number("height", codes["height"]), ob.number("weight", codes["weight"]), ob.number("z_score", codes["z_score"]),
        ob.number("muac_in_cm", codes["muac_mm"]), ob.answer_list("type_of_visit", codes["type_of_visit"]),
        ob.answer_list("fp_offered_and_accepted", codes["fp_offered"]), ob.answer_list("malaria_rdt", codes["malaria_rdt"]),
    ]


def outpatient_dispensing(
    clinic: Clinic, drugs: Mapping[str, int], classes: Mapping[str, Sequence[str]], start, end,
) -> DataFrame:
    """One row per dispensing encounter: visit facts, three diagnoses, drug quantities.

    ``drugs`` maps output columns to drug ids and ``classes`` flag columns to the
    drug columns that set them.  Test patients are left out even when the flag was
    voided.
    """
    codes = clinic.codes
    anchors = clinic.encounters("dispensing", start, end).select("patient_id", "visit_id", "encounter_id", "encounter_datetime")
    anchors = exclude_flagged_persons(anchors, clinic["person_attribute"], clinic.attributes["test"], include_voided=True)
    # Everything recorded in the visits of the listed encounters.
    visit_obs = clinic.visit_obs(anchors, start, end)
    wide = ob.collect_obs(visit_obs, "visit_id", outpatient_visit_wants(codes), clinic.labels)
    ranked = ob.ranked_answers(
        visit_obs, "visit_id", {"diag": codes["diagnosis"], "certainty": codes["diagnosis_certainty"], "order": codes["diagnosis_order"]},
        3, clinic.labels,
    )
    matrix = ob.drug_attribute_matrix(
        clinic.live_obs(anchors, start, end), "encounter_id", drugs, [ob.number("quantity", codes["quantity_dispensed"])]
    ).withColumnsRenamed({f"{name}_quantity": name for name in drugs})
    people = anchors.select(F.col("patient_id").alias("person_id")).distinct()
    # Latest occupation by person over all encounters of the listed patients.
    job = clinic.live_obs().filter(F.col("concept_id") == codes["occupation"]).join(people, "person_id", "left_semi")
    job = ob.collect_obs(job, "person_id", [ob.label("occupation", codes["occupation"])], clinic.labels)
    rows = dc.attach(anchors, "patient_id", job, "person_id", {"occupation": "occupation"})
    rows = clinic.with_age(rows, "age_at_encounter")
    rows = clinic.with_name(rows, "patient_name")
    rows = clinic.with_person(rows, {"gender": "gender"})
    rows = clinic.with_identifiers(rows, ["emr_id"])
    rows = clinic.with_address(rows, "patient_address")
    rows = rows.join(wide, "visit_id", "left").join(ranked, "visit_id", "left").join(matrix, "encounter_id", "left")
    return rows.select(
        "patient_id", "visit_id", F.col("emr_id").alias("patient_primary_id"), F.col("encounter_id").alias("dispensing_encounter_id"),
        F.col("encounter_datetime").alias("dispensed_encounter_date"), "patient_name", "age_at_encounter", "gender",
        "patient_address", "occupation", "height", "weight", "z_score", (F.col("muac_in_cm") / 10).alias("muac_in_cm"),
        "type_of_visit", "fp_offered_and_accepted", "malaria_rdt",
        *[
            F.col(f"{source}_{i}").alias(f"diag_{i}{suffix}")
            for i in (1, 2, 3)
            for source, suffix in (("diag", ""), ("certainty", "_certainty"), ("order", "_order"))
        ],
        *drugs, *[flag.alias(name) for name, flag in class_flags(classes).items()],
    )


# How many ranked columns the cohort extract has, and its years.
COHORT_DIAGNOSES, COHORT_MEDICINES, COHORT_TESTS = 16, 13, 47
COHORT_VITALS = (
    "height", "weight", "temperature", "heart_rate", "respiratory_rate", "bp_systolic", "bp_diastolic", "o2_saturation",
    "muac_mm", "chief_complaint",
)


def _in_years(df: DataFrame, at: str, first: int, last: int) -> DataFrame:
    return df.filter((F.col(at) >= moment(f"{first}-01-01 00:00:00")) & (F.col(at) < moment(f"{last + 1}-01-01 00:00:00")))


def _cohort_items(
    cohort: DataFrame, keyed: DataFrame, diagnoses: DataFrame, dispenses: DataFrame, labs: DataFrame, first_year: int, last_year: int,
) -> DataFrame:
    """(visit_id, kind, at, entry, value, result): diagnoses, medicines and tests of the cohort's visits.

    Medicines go to the latest visit that had started by their time, tests by their
    day.  Both look back in one sweep: the kind is part of the key, and every visit
    is a point of either kind.
    """
    own = diagnoses.join(cohort.select("visit_id"), "visit_id", "left_semi").select(
        "visit_id", F.lit("diagnosis").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("obs_id").cast("long").alias("entry"),
        F.col("diagnosis_entered").alias("value"), F.lit(None).cast("string").alias("result"),
    )
    given = _in_years(dispenses, "encounter_datetime", first_year, last_year).filter(F.col("drug_name").isNotNull()).select(
        "patient_id", F.lit("medicine").alias("kind"), F.col("encounter_datetime").alias("at"), F.col("encounter_datetime").alias("_when"),
        F.col("drug_name").alias("value"), F.lit(None).cast("string").alias("result"),
    )
    tested = _in_years(labs, "specimen_collection_date", first_year, last_year).filter(F.col("test").isNotNull()).select(
        "patient_id", F.lit("test").alias("kind"), F.col("specimen_collection_date").cast("timestamp_ntz").alias("at"),
        F.to_date("specimen_collection_date").cast("timestamp_ntz").alias("_when"), F.col("test").alias("value"), F.col("result").cast("string").alias("result"),
    )
    started = F.col("visit_date_started")
    kinds = F.array(
        F.struct(F.lit("medicine").alias("kind"), started.alias("at")),
        F.struct(F.lit("test").alias("kind"), F.to_date(started).cast("timestamp_ntz").alias("at")),
    )
    starts = keyed.select("patient_id", "visit_id", started.alias("_started"), F.explode(kinds).alias("k"))
    starts = starts.select("patient_id", F.col("k.kind").alias("kind"), F.col("k.at").alias("_from"), "_started", "visit_id")
    found = asof_backward(
        given.unionByName(tested).distinct(), starts, ["patient_id", "kind"], "_when", "_from", ["visit_id"], best=["_started", "visit_id"],
        sample=starts.select("patient_id", "kind", F.col("_from").alias("_at")),
    )
    placed = found.filter(F.col("visit_id").isNotNull()).select("visit_id", "kind", "at", F.lit(None).cast("long").alias("entry"), "value", "result")
    return own.unionByName(placed)


def _cohort(visits: DataFrame, patients: DataFrame, first_year: int, last_year: int) -> tuple[DataFrame, DataFrame]:
    cohort = year_overlap(visits, "visit_date_started", "visit_date_stopped", first_year, last_year)
    return cohort, cohort.join(patients.select("emr_id", "patient_id"), "emr_id", "left")


def visit_cohort(
    visits: DataFrame, patients: DataFrame, diagnoses: DataFrame, dispenses: DataFrame, labs: DataFrame, vitals: DataFrame,
    first_year: int = 2020, last_year: int = 2024, widths: tuple[int, int, int] = (COHORT_DIAGNOSES, COHORT_MEDICINES, COHORT_TESTS),
) -> DataFrame:
    """One wide row per visit from the curated tables.

    Diagnoses and vitals carry a visit; medicines are placed in the latest visit that
    had started by their time, labs by calendar day.  What ranks past the widths is in
    ``visit_cohort_rest``.  The vitals must hold every measure of the extract.
    """
    missing = [c for c in COHORT_VITALS if c not in vitals.columns]
    if missing:
        raise ValueError(f"vitals without {', '.join(missing)}")
    cohort, keyed = _cohort(visits, patients, first_year, last_year)
    details = [c for c in patients.columns if c not in ("emr_id", "patient_id")]
    rows = dc.attach(keyed, "patient_id", patients, "patient_id", {c: c for c in details})
    items = _cohort_items(cohort, keyed, diagnoses, dispenses, labs, first_year, last_year)
    # One ranking and one aggregate for all three lists.
    ranked = first_rows(items, ["visit_id", "kind"], ["at", "entry", "value", "result"], max(widths), "_n")
    lists = (("diagnosis", widths[0], {"diagnosis": "value"}), ("medicine", widths[1], {"med": "value"}), ("test", widths[2], {"test": "value", "result": "result"}))
    wide = ranked.groupBy("visit_id").agg(*[
        F.max(F.when((F.col("kind") == kind) & (F.col("_n") == i), F.col(source))).alias(f"{name}_{i}")
        for kind, width, columns in lists for i in range(1, width + 1) for name, source in columns.items()
    ])
    latest = latest_per_key(
        vitals.join(cohort.select("visit_id"), "visit_id", "left_semi"), ["visit_id"], ["encounter_datetime", "encounter_id"], list(COHORT_VITALS)
    )
    for part in (latest, wide):
        rows = rows.join(part, "visit_id", "left")
    return rows


def visit_cohort_rest(
    visits: DataFrame, patients: DataFrame, diagnoses: DataFrame, dispenses: DataFrame, labs: DataFrame,
    first_year: int = 2020, last_year: int = 2024, widths: tuple[int, int, int] = (COHORT_DIAGNOSES, COHORT_MEDICINES, COHORT_TESTS),
) -> DataFrame:
    """(visit_id, kind, rank, value, result) of what ranks past the widths of ``visit_cohort``, in long form."""
    cohort, keyed = _cohort(visits, patients, first_year, last_year)
    items = _cohort_items(cohort, keyed, diagnoses, dispenses, labs, first_year, last_year)
    ranked = number_rows(items, ["visit_id", "kind"], "at", ["entry", "value", "result"], "rank", None)
    width = F.when(F.col("kind") == "diagnosis", widths[0]).when(F.col("kind") == "medicine", widths[1]).otherwise(widths[2])
    return ranked.filter(F.col("rank") > width).select("visit_id", "kind", "rank", "value", "result")
