"""Patient lists, triage and diagnosis exports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.clinical import age_at, retrospective
from wardline.operators import dictionary as dc
from wardline.operators import observations as ob
from wardline.operators.aggregates import append_sets
from wardline.operators.filters import date_range, not_voided
from wardline.plans.clinic import Clinic


def patient_list(clinic: Clinic) -> DataFrame:
    """Every live patient with names, newest address, age and identifiers."""
    rows = not_voided(clinic["person"]).select(
        F.col("person_id").alias("patient_id"), "birthdate", "birthdate_estimated", "gender",
        age_at(F.col("birthdate"), clinic.as_of).alias("age"),
    )
    rows = dc.attach(
        rows, "patient_id", dc.preferred_name(clinic["person_name"]), "person_id",
        {"family_name": "family_name", "given_name": "given_name"},
    )
    parts = {
        "country": "country", "district": "county_district", "chiefdom": "state_province",
        "section": "address1", "village": "city_village", "address": "address2",
    }
    address = dc.latest_address(clinic["person_address"], list(parts.values()))
    rows = dc.attach(rows, "patient_id", address, "person_id", parts)
    rows = clinic.with_identifiers(rows)
    rows = clinic.with_attribute(rows, "phone", "telephone_number")
    return rows.select(
        "family_name", "given_name", *parts, "birthdate", "birthdate_estimated", "age", "gender",
        *clinic.identifiers, "telephone_number",
    )


def triage_wants(codes: Mapping) -> list[ob.Want]:
    """Triage answers; the largest value wins when a question repeats."""
    def numbers(*names):
        return [ob.peak(n, codes[n]) for n in names]

    def labelled(*names):
        return [ob.peak(n, codes[n], "label") for n in names]

    return [
        *labelled("triage_queue_status", "triage_color"),
        *numbers("triage_score"),
        ob.peak("chief_complaint", codes["chief_complaint"], "value_text"),
        *numbers("weight_kg"),
        *labelled("mobility"),
        *numbers("respiratory_rate", "blood_oxygen_saturation", "pulse", "bp_systolic", "bp_diastolic", "temperature_c"),
        ob.peak("trauma_present", codes["triage_diagnosis"], "label", codes["traumatic_injury"]),
        ob.peak("clinical_impression", codes["clinical_impression"], "value_text"),
        *numbers("glucose_value"),
        *labelled("referral_destination"),
    ]


# The output columns filled from concept sets of triage symptoms.
TRIAGE_CATEGORIES = (
    "response", "emergency_signs", "signs_of_shock", "dehydration", "neurological", "burn", "glucose", "trauma_type",
    "digestive", "pregnancy", "respiratory", "pain", "other_symptom",
)


def triage_export(clinic: Clinic, sets: Mapping[str, object], start=None, end=None) -> DataFrame:
    """One row per triage encounter.  ``sets`` maps category columns to concept sets."""
    anchors = clinic.encounters("triage", start, end).select(
        "patient_id", "encounter_id", "visit_id", "encounter_datetime", F.col("date_created").alias("date_entered"),
        "creator", "location_id",
    )
    obs = clinic.live_obs(anchors, start, end)
    symptoms = ob.category_symptoms(
        obs, "encounter_id", clinic.codes["triage_diagnosis"], clinic["concept_set"], sets, clinic.labels
    )
    # Narrow lookups first: every join copies the columns gathered so far.
    rows = clinic.with_identifiers(anchors)
    rows = clinic.with_registration(rows, "loc_registered")
    rows = clinic.with_attribute(rows, "unknown", "unknown_patient")
    rows = clinic.with_person(rows, {"gender": "gender"})
    rows = clinic.with_age(rows, "age_at_encounter")
    rows = dc.attach(rows, "visit_id", clinic["visit"], "visit_id", {"ed_visit_start_datetime": "date_started"})
    rows = clinic.with_location(rows, "encounter_location")
    rows = clinic.with_provider(rows, "provider")
    rows = clinic.with_user(rows, "user_entered")
    rows = rows.join(symptoms, "encounter_id", "left")
    rows = ob.register(rows, obs, triage_wants(clinic.codes), label_table=clinic.labels)
    rows = clinic.keyed(rows, "patient_id", "encounter_id", "visit_id")
    return rows.select(
        "patient_id", *clinic.identifiers, "encounter_id", "visit_id", "loc_registered", "unknown_patient", "gender",
        "age_at_encounter", "ed_visit_start_datetime", "encounter_datetime", "encounter_location", "provider",
        F.to_date("date_entered").alias("date_entered"), "user_entered",
        "triage_queue_status", "triage_color", "triage_score", "chief_complaint", "weight_kg", "emergency_signs",
        "mobility", "respiratory_rate", "blood_oxygen_saturation", "pulse", "bp_systolic", "bp_diastolic",
        "temperature_c", "response", "trauma_present", "signs_of_shock", "dehydration", "neurological", "burn",
        "glucose", "trauma_type", "digestive", "pregnancy", "respiratory", "pain", "other_symptom",
        "clinical_impression", "glucose_value", "referral_destination",
        F.lit(None).cast("int").alias("index_asc"), F.lit(None).cast("int").alias("index_desc"),
    )


# The class flags of a coded diagnosis.
DIAGNOSIS_CLASSES = (
    "notifiable", "urgent", "women_and_children", "psychological", "pediatric", "outpatient", "ncd", "non_diagnosis",
    "ed", "age_restricted", "oncology",
)


def diagnosis_export(
    clinic: Clinic, sets: Mapping[str, object], code_source: str, start=None, end=None, quirk: bool = False,
) -> DataFrame:
    """One row per coded or free-text diagnosis.

    ``quirk`` leaves ``birthdate_estimated`` null and compares clock times only for
    the retrospective flag.
    """
    codes = clinic.codes
    asked, live = clinic.obs_at([codes["diagnosis"], codes["diagnosis_free_text"]], "obs_datetime", start, end)
    shared = ["person_id", "encounter_id", "obs_id", "obs_datetime"]
    coded = date_range(asked.filter(F.col("concept_id") == codes["diagnosis"]), "obs_datetime", start, end).select(
        *shared, "obs_group_id", F.col("value_coded").alias("diagnosis_concept"), F.lit("1").alias("coded")
    )
    # Only the groups of these diagnoses are read for their order and certainty.
    members = live.join(coded.select("obs_group_id").distinct(), "obs_group_id", "left_semi")
    group = ob.group_values(
        members, [ob.label("dx_order", codes["diagnosis_order"]), ob.label("certainty", codes["diagnosis_certainty"])],
        clinic.labels,
    )
    coded = dc.attach(coded, "obs_group_id", group, "obs_group_id", {"dx_order": "dx_order", "certainty": "certainty"})
    coded = dc.attach(
        coded, "diagnosis_concept", clinic.labels, "concept_id",
        {"diagnosis_entered": "label", "diagnosis_coded_en": "label"},
    )
    coded = dc.retrieve_code(coded, clinic["concept_map"], "diagnosis_concept", code_source, "icd10_code")
    coded = dc.concept_in_sets(coded, clinic["concept_set"], "diagnosis_concept", sets)
    free = date_range(asked.filter(F.col("concept_id") == codes["diagnosis_free_text"]), "obs_datetime", start, end).select(
        *shared, F.col("value_text").alias("diagnosis_entered"), F.lit("0").alias("coded")
    )
    rows = append_sets(coded, free).withColumnRenamed("person_id", "patient_id")
    rows = dc.attach(
        rows, "encounter_id", clinic["encounter"], "encounter_id",
        {
            "visit_id": "visit_id", "creator": "creator", "location_id": "location_id", "encounter_type": "encounter_type",
            "date_created": "date_created", "encounter_datetime": "encounter_datetime",
        },
    )
    rows = clinic.with_location(rows, "encounter_location")
    rows = clinic.with_user(rows, "entered_by")
    rows = clinic.with_type_name(rows, "encounter_type_name")
    rows = clinic.with_provider(rows, "provider")
    rows = clinic.with_identifiers(rows)
    rows = clinic.with_registration(rows, "loc_registered")
    rows = clinic.with_attribute(rows, "unknown", "unknown_patient")
    rows = clinic.with_person(rows, {"gender": "gender", "birthdate": "birthdate", "birthdate_estimated": "birthdate_estimated"})
    parts = {
        "department": "state_province", "commune": "city_village", "section": "address3", "locality": "address1",
        "street_landmark": "address2",
    }
    address = dc.latest_address(clinic["person_address"], list(parts.values()), include_voided=True)
    rows = dc.attach(rows, "patient_id", address, "person_id", parts)
    if quirk:
        rows = rows.withColumn("birthdate_estimated", F.lit(None).cast("boolean"))
    late = retrospective(F.col("date_created"), F.col("obs_datetime"), clock_only=quirk)
    return rows.select(
        "patient_id", *clinic.identifiers, "loc_registered", "unknown_patient", "gender",
        age_at(F.col("birthdate"), F.col("encounter_datetime")).alias("age_at_encounter"), *parts, "encounter_id",
        "encounter_location", "obs_id", "obs_datetime", "entered_by", "provider", "diagnosis_entered", "dx_order",
        "certainty", "coded", "diagnosis_concept", "diagnosis_coded_en", "icd10_code", *sets, "date_created",
        late.alias("retrospective"), "visit_id", "birthdate", "birthdate_estimated",
        F.col("encounter_type_name").alias("encounter_type"),
    )
