"""Mental-health and chronic-disease reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction

from wardline.functions import clinical as cl
from wardline.functions.dates import years_dot_months
from wardline.functions.text import reword
from wardline.operators import dictionary as dc
from wardline.operators import observations as ob
from wardline.operators import programs as pg
from wardline.operators.filters import exclude_flagged_persons, not_voided
from wardline.operators.intervals import enrolment_of_encounter, enrolment_window, relationship_join
from wardline.operators.ranking import pivot_ranked
from wardline.operators.sweeps import number_rows
from wardline.plans import columns
from wardline.plans.clinic import Clinic
from wardline.plans.columns import in_order
from wardline.plans.maternity import _each

# The attributes listed per drug.
DRUG_ATTRIBUTES = ("dose", "dose_units", "freq", "duration", "dur_units", "route")


def mental_health_wants(codes: Mapping) -> list[ob.Want]:
    other = codes["other"]
    return [
        *_each(ob.answer_list, codes, "referred_by_community", "referred_by_facility", "history_of_homelessness", "housing_type",
               "hiv_test", "tb_smear_result", "extrapulmonary_tuberculosis", "alcohol_history", "marijuana_history",
               "other_drug_history", "traditional_medicine_history", "family_epilepsy", "family_mental_illness",
               "family_behavioral_problems", "presenting_features", "mental_state_exam_findings", "past_suicidal_ideation",
               "past_suicidal_attempt", "current_suicidal_ideation", "current_suicidal_attempt", "psychosocial_counseling",
               "interventions", "assigned_chw"),
        ob.remark("other_community_referral", codes["referred_by_community"], other),
        ob.remark("other_facility_referral", codes["referred_by_facility"], other),
        ob.remark("other_presenting_features", codes["presenting_features"], other),
        ob.remark("other_mental_state_exam_finding", codes["mental_state_exam_findings"], other),
        ob.remark("noncoded_diagnosis", codes["mental_health_diagnosis"], other),
        *_each(ob.when, codes, "arv_start_date", "date_latest_suicidal_attempt", "return_visit_date"),
        *_each(ob.number, codes, "alcohol_duration", "marijuana_duration", "other_drug_duration", "seizure_frequency", "cgi_s", "cgi_e"),
        *_each(ob.text, codes, "other_drug_name", "clinical_impressions", "additional_medication_comments"),
    ]


def drug_wants(codes: Mapping) -> list[ob.Want]:
    return [
        ob.number("dose", codes["dose"]), ob.answer_list("dose_units", codes["dose_units"]), ob.answer_list("freq", codes["frequency"]),
        ob.number("duration", codes["duration"]), ob.answer_list("dur_units", codes["duration_units"]), ob.answer_list("route", codes["route"]),
    ]


def mental_health_encounters(clinic: Clinic, drugs: Mapping[str, int], diagnosis_set, start, end) -> DataFrame:
    """One row per mental-health encounter, soft-deleted ones included.

    ``drugs`` maps column prefixes to drug ids.  Two scores read the same question.
    """
    codes = clinic.codes
    anchors = clinic.encounters("mental_health", start, end, keep_voided=True).select(
        "patient_id", "encounter_id", "encounter_datetime", "encounter_type", "visit_id"
    )
    obs = clinic.live_obs(anchors, start, end)
    wants = mental_health_wants(codes)
    # The first four answers that belong to the diagnosis set.
    members = clinic["concept_set"].filter(F.col("concept_set") == diagnosis_set).select(F.col("concept_id").alias("value_coded")).distinct()
    answers = obs.filter(F.col("concept_id") == codes["mental_health_diagnosis"]).select("encounter_id", "obs_id", "value_coded")
    answers = ob.with_labels(answers.join(members, "value_coded", "left_semi"), clinic.labels)
    four = pivot_ranked(answers, ["encounter_id"], ["obs_id"], {"diagnosis": "label"}, 4)
    matrix = ob.drug_attribute_matrix(obs, "encounter_id", drugs, drug_wants(codes), clinic.labels)
    # Narrow lookups first: every join copies the columns gathered so far.
    rows = clinic.with_identifiers(anchors, ["emr_id"])
    rows = clinic.with_registration(rows, "location_registered")
    rows = clinic.with_age(rows, "age_at_encounter")
    rows = clinic.with_address(rows, "address")
    rows = clinic.with_type_name(rows, "encounter_type_name")
    rows = clinic.with_provider(rows, "provider")
    rows = rows.join(four, "encounter_id", "left")
    rows = ob.register(rows, obs, wants, label_table=clinic.labels).join(matrix, "encounter_id", "left")
    shown = rows.select(
        "patient_id", "emr_id", "location_registered", "age_at_encounter", "address", "encounter_id",
        F.col("encounter_type_name").alias("encounter_type"), "visit_id", "encounter_datetime", "provider",
        *[w.column for w in wants], F.col("cgi_s").alias("cgi_i"), *[f"diagnosis_{i}" for i in range(1, 5)],
        *[f"{drug}_{attribute}" for drug in drugs for attribute in DRUG_ATTRIBUTES],
    )
    return in_order(shown, columns.MENTAL_HEALTH_ENCOUNTERS, columns.MENTAL_HEALTH_LAST)


def mental_health_enrolments(clinic: Clinic, relation, yes: str = "Oui", no: str = "No", unit: str = "month") -> DataFrame:
    """One row per enrolment with what happened while it lasted.

    Encounters inside each enrolment are found by one range join and serve all measures.
    """
    codes = clinic.codes
    base = not_voided(clinic["patient_program"]).filter(F.col("program_id") == clinic.programs["mental_health"])
    base = exclude_flagged_persons(base, clinic["person_attribute"], clinic.attributes["test"])
    spans = base.select("patient_id", "patient_program_id", "date_enrolled", "date_completed")
    encounters = clinic.encounters("mental_health_consult").select("patient_id", "encounter_id", "encounter_datetime")
    inside = enrolment_window(spans, encounters, clinic.as_of, unit=unit).select(
        "patient_program_id", "encounter_id", "encounter_datetime"
    )
    roles = {name: codes[name] for name in ("mental_health_diagnosis", "seizures", "medication", "return_visit_date")}
    facts = clinic.live_obs().filter(F.col("concept_id").isin(list(roles.values()))).select(
        "encounter_id", "obs_id", "concept_id", "value_coded", "value_numeric", "value_datetime"
    )
    named = ob.with_labels(facts, clinic.labels)
    asked = named.filter(F.col("concept_id") != roles["medication"]).select(
        "encounter_id", "obs_id", "concept_id", "label", "value_numeric", "value_datetime"
    )
    # What an encounter gives is one list, whichever enrolments hold it.
    given = named.filter(F.col("concept_id") == roles["medication"]).groupBy("encounter_id", "concept_id").agg(
        ob.joined_labels(F.collect_set("label"), ",").alias("label")
    )
    seen = inside.join(asked.unionByName(given, allowMissingColumns=True), "encounter_id", "left")
    fact = F.struct("encounter_datetime", "encounter_id", "obs_id", "label", "value_numeric", "value_datetime")

    def of(role: str):
        return F.when(F.col("concept_id") == roles[role], fact)

    # One aggregate for all measures: its state per enrolment is a few facts.
    measures = seen.groupBy("patient_program_id").agg(
        F.max(of("mental_health_diagnosis"))["label"].alias("latest_diagnosis"),
        F.sort_array(InternalFunction.collect_top_k(of("seizures"), 2, False), asc=False).alias("_seizures"),
        F.min(of("seizures")).alias("_first"),
        F.max(of("return_visit_date"))["value_datetime"].alias("next_scheduled_visit_date"),
        F.bool_or(F.when(F.col("concept_id") == roles["return_visit_date"], True)).alias("_planned"),
        F.max(of("medication")).alias("_given"),
        F.max("encounter_datetime").alias("last_visit_date"),
    )
    newest, second = F.get("_seizures", F.lit(0)), F.get("_seizures", F.lit(1))
    measures = measures.select(
        "patient_program_id", "latest_diagnosis", "next_scheduled_visit_date", "_planned", "last_visit_date",
        newest["value_numeric"].alias("latest_seizure_number"), F.to_date(newest["encounter_datetime"]).alias("latest_seizure_date"),
        second["value_numeric"].alias("previous_seizure_number"), F.to_date(second["encounter_datetime"]).alias("previous_seizure_date"),
        F.col("_first.value_numeric").alias("baseline_seizure_number"), F.to_date("_first.encounter_datetime").alias("baseline_seizure_date"),
        F.col("_given.label").alias("latest_medication_given"), F.to_date("_given.encounter_datetime").alias("latest_medication_date"),
    )
    rows = base.join(measures, "patient_program_id", "left")
    born = not_voided(clinic["person"])
    rows = dc.attach(rows, "patient_id", born, "person_id", {"_born": "birthdate"})
    rows = clinic.with_person(rows, {"gender": "gender"})
    rows = relationship_join(
        rows, clinic["relationship"], not_voided(clinic["person_name"]), relation, "assigned_chw", separator=", "
    )
    rows = clinic.with_identifiers(rows, ["emr_id"])
    rows = clinic.with_label(rows, "outcome_concept_id", "program_status_outcome")
    open_places = clinic["location"].filter(~F.col("retired"))
    rows = dc.attach(rows, "location_id", open_places, "location_id", {"location_when_registered_in_program": "name"})
    parts = {
        "province": "state_province", "city_village": "city_village", "address3": "address3", "address1": "address1", "address2": "address2",
    }
    address = dc.latest_address(clinic["person_address"], list(parts.values()))
    rows = dc.attach(rows, "patient_id", address, "person_id", parts)
    flags = cl.followup_flags(F.col("last_visit_date"), F.col("_planned"), clinic.as_of, yes, no)
    return rows.select(
        "patient_id", "emr_id", "gender", years_dot_months(F.col("_born"), clinic.as_of).cast("double").alias("age"),
        # Every listed name is led by a blank.
        F.concat(F.lit(" "), "assigned_chw").alias("assigned_chw"),
        *parts, "location_when_registered_in_program", F.to_date("date_enrolled").alias("date_enrolled"),
        F.to_date("date_completed").alias("date_completed"),
        cl.days_in_care(F.col("date_enrolled"), F.col("date_completed"), clinic.as_of).alias("number_of_days_in_care"),
        "program_status_outcome", "latest_diagnosis", "latest_seizure_number", "latest_seizure_date", "previous_seizure_number",
        "previous_seizure_date", "baseline_seizure_number", "baseline_seizure_date", "latest_medication_given",
        "latest_medication_date", F.to_date("last_visit_date").alias("last_visit_date"),
        F.to_date("next_scheduled_visit_date").alias("next_scheduled_visit_date"),
        flags["came_within_14_days"].alias("patient_came_within_14_days_appt"),
        flags["over_three_months"].alias("three_months_since_latest_return_date"),
        flags["over_six_months"].alias("six_months_since_latest_return_date"),
    )


def mental_health_cases(clinic: Clinic) -> DataFrame:
    """One row per live enrolment and live name of its patient, in patient order."""
    rows = not_voided(clinic["patient_program"]).filter(F.col("program_id") == clinic.programs["mental_health"])
    persons = not_voided(clinic["person"]).select(F.col("person_id").alias("patient_id"), "uuid", "gender", "birthdate")
    names = not_voided(clinic["person_name"]).select(F.col("person_id").alias("patient_id"), "given_name", "family_name")
    rows = rows.select("patient_id", "date_enrolled").join(persons, "patient_id").join(names, "patient_id")
    rows = clinic.with_identifiers(rows, ["emr_id"])
    return rows.select(
        F.col("uuid").alias("patient_uuid"), "emr_id", cl.age_at(F.col("birthdate"), clinic.as_of).alias("age"), "gender",
        F.col("given_name").alias("first_name"), F.col("family_name").alias("last_name"),
        F.to_date("date_enrolled").alias("date_enrolled"), "patient_id",
    ).orderBy("patient_id").drop("patient_id")


# Diseases with a history flag and an onset date.
CHRONIC_HISTORY = (
    "diabetes", "hypertension", "heart_failure", "chronic_lung_disease", "chronic_kidney_disease", "liver_cirrhosis_hepb",
    "palliative_care", "sickle_cell", "other_ncd",
)
# Diagnosis roles in order of preference.
DIABETES_TYPES = ("type_1", "type_2", "gestational", "unspecified")
SICKLE_TYPES = ("sickle_trait", "sickle_anemia", "beta_thalassemia", "hemoglobin_c", "other_hemoglobinopathy")
# Wording of the form.
BMI_LABELS = {"obese": "Moderate obese", "severely_obese": "Severe obese"}
STAGE_LABELS = {"stage_pre": "Pre-HTN", "stage_mild": "1 (Mild)", "stage_moderate": "2 (Moderate)"}
DISPOSITION_LABELS = {"labs_outstanding": "Laboratory tests outstanding", "no_action": "No action taken"}


def chronic_wants(codes: Mapping) -> list[ob.Want]:
    yes, no = codes["yes"], codes["no"]
    history, diagnosis = codes["chronic_history"], codes["diagnosis"]
    present = [ob.answered_or_null(name, history, codes[name]) for name in CHRONIC_HISTORY]
    return [
        *_each(ob.answer_list, codes, "visit_type", "vulnerable", "education_level", "literacy_level", "employment_status",
               "referred_from", "social_support_type", "hiv", "comorbidities", "bmi", "last_hospitalization_outcome",
               "ncd_diagnoses_caused_hospitalization", "reason_no_hydroxyurea", "diabetes_complications", "hypertension_type",
               "hypertension_stage", "nyha_classification", "ckd_stage", "sickle_cell_complications", "disposition",
               "transfer_site", "on_beta_blocker", "referred_to_surgery_for_heart_failure", "cardiac_surgery_scheduled",
               "type_cardiac_surgery", "asthma_severity", "nighttime_waking_asthma", "symptoms_2x_week_asthma",
               "inhaler_for_symptoms_2x_week_asthma", "on_esophageal_varices_prophylaxis"),
        *[
            ob.yes_no(name, codes[name], yes, no)
            for name in ("care_household", "social_support", "missed_school", "hospitalization_dka_last_12_months",
                         "treatment_with_hydroxyurea", "diabetes_home_glucometer", "diabetes_on_insulin",
                         "secondary_antibiotic_prophylaxis", "transfusion_past_12_months")
        ],
        ob.remark("other_referral", codes["referred_from"], codes["other"]),
        ob.remark("other_social_support", codes["social_support_type"], codes["other"]),
        *_each(ob.number, codes, "days_lost_schooling", "bp_systolic", "bp_diastolic", "fbg_level", "rbg_level",
               "number_hospitalizations_last_12_months", "number_hospitalizations_ncd", "number_days_hospitalized",
               "number_hospitalizations_since_visit"),
        *_each(ob.when, codes, "next_appointment_date", "last_hospitalization_discharge_date", "cardiac_surgery_performed_date",
               "transfusion_date"),
        *present,
        ob.answered_or_null("_fasting", codes["glucose_method"], codes["fasting"]),
        ob.answered_or_null("_random", codes["glucose_method"], codes["random"]),
        ob.answered_or_null("_obese_present", codes["symptom_present"], codes["obese"]),
        ob.answered_or_null("_obese_absent", codes["symptom_absent"], codes["obese"]),
        *[ob.answered_or_null(n, diagnosis, codes[n]) for n in ("cardiomyopathy", "rheumatic_heart_disease", "congenital_heart_disease")],
        *[ob.answered_or_null(n, codes["lung_medication"], codes[n]) for n in ("on_saba", "on_oral_salbutamol", "on_steroid_inhaler")],
        ob.answered_or_null("cardiac_surgery_performed", codes["surgery_status"], codes["surgery_done"]),
        *[ob.answered_or_null(n, codes["sickle_cell_medication"], codes[n]) for n in ("scd_penicillin_treatment", "scd_folic_acid_treatment")],
        ob.answer_list("lung_disease_type", diagnosis, answers=[codes[r] for r in ("copd", "bronchiectasis", "asthma", "cor_pulmonale")]),
        ob.answered_or_null("diabetic_coma", codes["coma_history"], codes["coma_with"]),
        ob.answered_or_null("diabetic_without_coma", codes["coma_history"], codes["coma_without"]),
        *[ob.answer_label(f"_{r}", codes["bmi"], codes[r]) for r in BMI_LABELS],
        *[ob.answer_label(f"_{r}", codes["hypertension_stage"], codes[r]) for r in STAGE_LABELS],
        *[ob.answer_label(f"_{r}", codes["disposition"], codes[r]) for r in DISPOSITION_LABELS],
        *[ob.answer_label(f"_yes_{n}", codes[n], yes) for n in
          ("nighttime_waking_asthma", "symptoms_2x_week_asthma", "inhaler_for_symptoms_2x_week_asthma")],
    ]


def _reworded(column: str, names: Mapping[str, str]):
    """The column, reworded where it equals the label of one of the answers."""
    out = F.col(column)
    for role, text in names.items():
        out = F.when(F.col(column) == F.col(f"_{role}"), F.lit(text)).otherwise(out)
    return out


def chronic_encounters(
    clinic: Clinic, sections: Mapping[str, Mapping], start=None, end=None, ordered: bool = False,
) -> DataFrame:
    """One row per chronic-disease encounter.

    ``sections`` maps section columns to the questions and answers that populate
    them; the column of a section that is not given is null.  ``ordered`` sorts the output by patient and time; the sort samples its
    input, so the widest stage runs twice, and only a file for reading needs it.
    """
    codes, labels = clinic.codes, clinic.labels
    anchors = clinic.encounters("chronic", start, end).select(
        "patient_id", "encounter_id", "encounter_datetime", F.col("date_created").alias("datetime_entered"), "visit_id",
        "creator", "location_id", "encounter_type",
    )
    obs = clinic.live_obs(anchors, start, end)
    # One pass at encounter grain and one at group grain serve the whole report.
    wants = [
        *chronic_wants(codes),
        ob.yes_questions("risk_factors", [codes[r] for r in codes if r.startswith("risk_")], codes["yes"]),
        ob.preferred("diabetes_type", codes["diagnosis"], [codes[r] for r in DIABETES_TYPES]),
        ob.preferred("sickle_cell_type", codes["diagnosis"], [codes[r] for r in SICKLE_TYPES]),
        *[ob.section(name, rule.get("questions", ()), rule.get("answers", ())) for name, rule in sections.items()],
    ]
    groups = ob.group_matrix(
        obs, "encounter_id",
        [
            ob.answer_list("control", codes["control"]), ob.answer_list("activity", codes["activity_limitation"]),
            ob.answer_label("activity_yes", codes["activity_limitation"], codes["yes"]), ob.answer_list("use", codes["medication_use"]),
            ob.when("onset_date", codes["onset_date"]), ob.when("date", codes["procedure_date"]),
            ob.answer_list("options", codes["echocardiogram"]), ob.text("comment", codes["procedure_comment"]),
        ],
        constructs={
            "diabetes_in": codes["diabetes_construct"], "hypertension_in": codes["hypertension_construct"], "ckd_in": codes["kidney_construct"],
            "liver_in": codes["liver_construct"], "limitation": codes["limitation_construct"], "ace": codes["ace_construct"],
        },
        leads={
            **{name: (codes["chronic_history"], codes[name]) for name in CHRONIC_HISTORY},
            "echo": (codes["procedure"], codes["echocardiogram"]),
        },
        label_table=labels,
    ).select(
        "encounter_id", *[f"{name}_in_control" for name in ("diabetes", "hypertension", "ckd", "liver")],
        "limitation_activity", "limitation_activity_yes", "ace_use", *[f"{name}_onset_date" for name in CHRONIC_HISTORY],
        "echo_date", "echo_options", "echo_comment",
    )
    tests = pg.lab_orders(
        clinic["orders"].join(anchors.select("encounter_id"), "encounter_id", "left_semi"),
        {"lab_order_hba1c": codes["hba1c"]}, clinic.types["test_order"][0], labels,
    ).withColumnRenamed("tests_ordered", "lab_tests_ordered")
    index = number_rows(anchors.select("patient_id", "encounter_id", "encounter_datetime"), ["patient_id"], "encounter_datetime", ["encounter_id"])
    # Narrow lookups first: every join copies the columns gathered so far.
    rows = anchors.join(index.select("encounter_id", "index_asc", "index_desc"), "encounter_id")
    enrolments = not_voided(clinic["patient_program"]).filter(F.col("program_id") == clinic.programs["chronic"]).select(
        "patient_id", "patient_program_id", "date_enrolled", "date_completed"
    )
    active = enrolment_of_encounter(anchors.select("patient_id", "encounter_id", "encounter_datetime"), enrolments, clinic.as_of)
    rows = rows.join(active.select("encounter_id", F.col("patient_program_id").alias("ncd_program_id")), "encounter_id")
    rows = clinic.with_identifiers(rows, ["emr_id"])
    rows = clinic.with_user(rows, "user_entered")
    rows = clinic.with_location(rows, "encounter_location")
    rows = clinic.with_type_name(rows, "encounter_type_name")
    rows = clinic.with_provider(rows, "provider")
    rows = rows.join(tests, "encounter_id", "left").join(groups, "encounter_id", "left")
    rows = ob.register(rows, obs, wants, label_table=labels)
    control = cl.symptom_control(
        [
            F.when(F.col(c).isNotNull(), F.coalesce(F.col(c) == F.col(y), F.lit(False)))
            for c, y in (
                ("nighttime_waking_asthma", "_yes_nighttime_waking_asthma"), ("symptoms_2x_week_asthma", "_yes_symptoms_2x_week_asthma"),
                ("inhaler_for_symptoms_2x_week_asthma", "_yes_inhaler_for_symptoms_2x_week_asthma"),
                ("limitation_activity", "limitation_activity_yes"),
            )
        ],
        F.lit(True),
    )
    shown = [w.column for w in wants if not w.column.startswith("_")]
    special = {
        "bmi": _reworded("bmi", BMI_LABELS), "hypertension_stage": _reworded("hypertension_stage", STAGE_LABELS),
        "disposition": _reworded("disposition", DISPOSITION_LABELS), "next_appointment_date": F.to_date("next_appointment_date"),
        "diabetes_complications": reword(F.col("diabetes_complications"), {"Cerebrovascular accident": "Stroke"}),
    }
    out = rows.select(
        F.col("patient_id").alias("_patient"), F.col("encounter_datetime").alias("_at"), F.col("encounter_id").alias("_id"),
        *[F.col(c) for c in ("patient_id", "emr_id", "encounter_id", "encounter_datetime", "datetime_entered", "visit_id", "ncd_program_id",
                             "provider", "user_entered", "encounter_location")],
        F.col("encounter_type_name").alias("encounter_type"),
        *[special.get(c, F.col(c)).alias(c) for c in shown],
        F.when(F.col("_fasting"), "FBG").when(F.col("_random"), "RBG").alias("glucose_fingerstick"),
        F.when(F.col("_obese_present"), True).when(F.col("_obese_absent"), False).alias("obesity"),
        *[f"{name}_onset_date" for name in CHRONIC_HISTORY],
        F.col("diabetes_in_control").alias("diabetes_control"), F.col("hypertension_in_control").alias("hypertension_controlled"),
        F.col("ckd_in_control").alias("ckd_controlled"), F.col("liver_in_control").alias("liver_disease_controlled"),
        F.concat("echo_options", F.lit("| "), "echo_comment").alias("echocardiogram_findings"), F.col("echo_date").alias("echocardiogram_date"),
        F.col("ace_use").alias("on_ace_inhibitor"), F.col("limitation_activity").alias("activity_limitation_asthma"),
        control.alias("asthma_control_gina"), "lab_order_hba1c", "lab_tests_ordered", "index_asc", "index_desc",
        *[F.lit(None).cast("boolean").alias(c) for c in columns.CHRONIC_ENCOUNTERS if c.endswith("_section_populated") and c not in sections],
    )
    out = clinic.keyed(out, "patient_id", "encounter_id", "visit_id", "ncd_program_id")
    if ordered:
        out = out.orderBy("_patient", "_at", "_id")
    return in_order(out.drop("_patient", "_at", "_id"), columns.CHRONIC_ENCOUNTERS)


# Labels by priority for patients with several answers.
DIABETES_PRIORITY = (
    ("type_2", "Type 2 DM"), ("type_1", "Type 1 DM"), ("gestational", "Gestational DM"), ("unspecified", "DM not yet specified"),
)
SICKLE_PRIORITY = (
    ("sickle_anemia", "Sickle-cell anemia (SS)"), ("sickle_trait", "Sickle-cell trait (AS)"),
    ("beta_thalassemia", "Sickle-cell beta thalassemia (SB)"), ("hemoglobin_c", "Sickle-cell hemoglobin C disease (SC)"),
    ("other_hemoglobinopathy", "Other hemoglobinopathy"),
)
REFERRAL_WORDS = {"Hospitalized": "Inpatient Ward", "Primary care clinic": "OPD"}


def chronic_patients(clinic: Clinic) -> DataFrame:
    """One row per patient of the chronic-disease clinic: latest and ever facts."""
    codes, labels = clinic.codes, clinic.labels
    anchors = clinic.encounters("chronic").select("patient_id", "encounter_id", "encounter_datetime")
    obs = clinic.live_obs(anchors)
    people = anchors.groupBy(F.col("patient_id")).agg(
        F.max("encounter_datetime").alias("most_recent_visit_date"), F.min("encounter_datetime").alias("first_ncd_visit_date")
    )
    listed = ob.latest_answer_lists(obs, "person_id", {
        name: codes[name] for name in ("education_level", "referred_from", "sickle_cell_confirmatory_test", "hypertension_type",
                                       "nyha_classification", "lung_disease_type", "ckd_stage", "disposition", "hiv", "comorbidities")
    }, labels)
    history, diagnosis = codes["chronic_history"], codes["diagnosis"]
    ever = {name: (history, codes[name]) for name in CHRONIC_HISTORY}
    ever |= {name: (diagnosis, codes[name]) for name in ("rheumatic_heart_disease", "congenital_heart_disease")}
    ever |= {f"_{role}": (diagnosis, codes[role]) for role, _ in (*DIABETES_PRIORITY, *SICKLE_PRIORITY)}
    facts = ob.collect_obs(obs, "person_id", [
        *[ob.answered(name, question, answer) for name, (question, answer) in ever.items()],
        ob.coded("_literacy", codes["literacy_level"]), ob.when("next_appointment_date", codes["next_appointment_date"]),
        ob.text("other_ncd_type", codes["noncoded_diagnosis"]), ob.section("ever_missed_school", [codes["missed_school"]]),
        ob.answered_or_null("cardiomyopathy", diagnosis, codes["cardiomyopathy"]),
    ])
    echo = ob.answer_led_values(
        obs, "encounter_id", {"echo": (codes["procedure"], codes["echocardiogram"])}, [ob.when("date", codes["procedure_date"])]
    ).join(anchors, "encounter_id").groupBy("patient_id").agg(F.max("echo_date").alias("most_recent_echocardiogram_date"))
    lab = pg.latest_lab(clinic["obs"], clinic["encounter"], clinic.types["lab_result"], codes["hba1c"])
    program = pg.most_recent_enrolment(
        clinic["patient_program"], clinic.programs["chronic"], ["date_enrolled", "date_completed", "outcome_concept_id"]
    )
    rows = people
    for part in (listed, facts, lab):
        rows = rows.join(part.withColumnRenamed("person_id", "patient_id"), "patient_id", "left")
    rows = rows.join(echo, "patient_id", "left").join(program, "patient_id", "left")
    rows = clinic.with_label(rows, "outcome_concept_id", "outcome")
    rows = clinic.with_identifiers(rows, ["emr_id"])
    rows = clinic.with_person(rows, {"gender": "gender", "date_of_death": "death_date", "birthdate": "birthdate"})
    rows = dc.attach(rows, "patient_id", not_voided(clinic["person"]), "person_id", {"birthdate_estimated": "birthdate_estimated"})
    # Patients without any observation have no history: false, as when asked and absent.
    rows = rows.withColumns({name: F.coalesce(F.col(name), F.lit(False)) for name in ever})
    outcome = cl.reporting_outcome(
        F.col("outcome"), F.col("date_completed"), F.col("most_recent_visit_date"), F.col("date_enrolled"),
        F.col("next_appointment_date"), clinic.as_of,
    )
    literate = F.when(F.col("_literacy") == codes["yes"], True).when(F.col("_literacy") == codes["no"], False)
    rows = clinic.keyed(rows, "patient_id")
    return rows.select(
        "patient_id", "emr_id", "hiv", "education_level", literate.alias("read_and_write"),
        reword(F.col("referred_from"), REFERRAL_WORDS).alias("referred_from"), "comorbidities", *CHRONIC_HISTORY,
        cl.first_match([(F.col(f"_{r}"), text) for r, text in DIABETES_PRIORITY]).alias("diabetes_type"), "hypertension_type",
        "rheumatic_heart_disease", "congenital_heart_disease", "nyha_classification", "lung_disease_type", "ckd_stage",
        cl.first_match([(F.col(f"_{r}"), text) for r, text in SICKLE_PRIORITY]).alias("sickle_cell_type"),
        "sickle_cell_confirmatory_test", F.to_date("next_appointment_date").alias("next_appointment_date"),
        F.col("date_of_death").isNotNull().alias("dead"), F.to_date("date_of_death").alias("date_of_death"),
        F.to_date("birthdate").alias("birthdate"), "birthdate_estimated",
        cl.age_at(F.col("birthdate"), clinic.as_of).alias("current_age"), "gender", "other_ncd_type",
        F.to_date("most_recent_visit_date").alias("most_recent_visit_date"),
        F.to_date("first_ncd_visit_date").alias("first_ncd_visit_date"), "disposition", "ever_missed_school", "cardiomyopathy",
        F.col("lab_value").alias("most_recent_hba1c_value"), F.to_date("lab_date").alias("most_recent_hba1c_date"),
        "most_recent_echocardiogram_date", "date_enrolled", F.col("date_completed").alias("outcome_date"), "outcome",
        outcome.alias("calculated_reporting_outcome"),
    )


def chronic_enrolments(clinic: Clinic, workflow) -> DataFrame:
    """One row per live enrolment of the chronic-disease program."""
    rows = not_voided(clinic["patient_program"]).filter(F.col("program_id") == clinic.programs["chronic"])
    rows = pg.current_program_state(rows, clinic["patient_state"], clinic["program_workflow_state"], workflow, clinic.labels)
    rows = clinic.with_identifiers(rows, ["emr_id"])
    rows = clinic.with_label(rows, "outcome_concept_id", "final_program_status")
    rows = clinic.with_user(rows, "user_entered", "username")
    rows = dc.attach(rows, "program_id", clinic["program"], "program_id", {"program_name": "name"})
    return clinic.keyed(rows.withColumnRenamed("patient_program_id", "ncd_program_id"), "ncd_program_id", "patient_id").select(
        "ncd_program_id", "patient_id", "emr_id", "program_name", F.to_date("date_enrolled").alias("date_enrolled"),
        F.to_date("date_completed").alias("date_completed"), "final_program_status",
        F.col("program_state").alias("clinical_status"), "user_entered",
        F.lit(None).cast("int").alias("index_asc"), F.lit(None).cast("int").alias("index_desc"),
    )
