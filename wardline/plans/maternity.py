"""Maternal and newborn registers, delivery forms and discharge lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.dates import readable_datetime
from wardline.operators import observations as ob
from wardline.operators.filters import in_months, not_voided, on_date_at_location
from wardline.operators.observations import with_labels
from wardline.operators.programs import born_in_facility
from wardline.operators.ranking import first_rows, pivot_ranked
from wardline.plans import columns
from wardline.plans.clinic import Clinic
from wardline.plans.columns import in_order


def _each(kind, codes: Mapping, *names: str) -> list[ob.Want]:
    return [kind(name, codes[name]) for name in names]


def maternal_register_wants(codes: Mapping) -> list[ob.Want]:
    yes, no = codes["yes"], codes["no"]
    return [
        *_each(ob.when, codes, "admission_datetime", "labor_start_datetime", "delivery_datetime"),
        *_each(ob.number, codes, "gravida", "parity", "gestational_age", "baby_weight", "apgar"),
        *_each(ob.answer_list, codes, "pac_type", "pres_and_position", "delivery_type", "delivery_outcome", "baby_sex",
               "disposition", "hcw_cadre"),
        *_each(ob.text, codes, "pres_and_position_other", "hcw_name", "hcw_cadre_other"),
        *[
            ob.yes_no(name, codes[name], yes, no)
            for name in ("partograph_used", "uterotonic_given", "baby_alive", "breastfeeding_1_hour", "counselled_fp", "received_fp")
        ],
    ]


def _diagnosis_wants(codes: Mapping) -> list[ob.Want]:
    return [
        ob.answer_list("coded_diagnoses", codes["coded_diagnosis"], ","),
        ob.text("noncoded_diagnosis", codes["noncoded_diagnosis"]),
    ]


def maternal_register(clinic: Clinic, start=None, end=None) -> DataFrame:
    """One row per maternal register encounter with initial and final diagnoses."""
    codes = clinic.codes
    anchors = clinic.encounters("maternal_register", start, end).select(
        "patient_id", "encounter_id", "encounter_datetime", "creator", F.col("date_created").alias("date_entered"), "location_id"
    )
    obs = clinic.live_obs(anchors, start, end)
    wants = maternal_register_wants(codes)
    diagnoses = ob.construct_children(
        obs, {"initial": codes["prior_diagnosis_construct"], "final": codes["diagnosis_construct"]},
        _diagnosis_wants(codes), label_table=clinic.labels,
    )
    # Narrow lookups first: every join copies the columns gathered so far.
    rows = clinic.with_identifiers(anchors, ["emr_id"])
    rows = clinic.with_address(rows, "address")
    rows = clinic.with_age(rows, "age_at_enc")
    rows = clinic.with_user(rows, "user_entered", "username")
    rows = clinic.with_location(rows, "encounter_location")
    rows = rows.join(diagnoses, "encounter_id", "left")
    rows = ob.register(rows, obs, wants, label_table=clinic.labels)
    shown = rows.select(
        "emr_id", "address", "age_at_enc", "encounter_id", "encounter_datetime", "user_entered", "date_entered",
        "encounter_location", *[w.column for w in wants], "initial_coded_diagnoses", "initial_noncoded_diagnosis",
        "final_coded_diagnoses", "final_noncoded_diagnosis",
    )
    return in_order(shown, columns.MATERNAL_REGISTER)


def newborn_register_wants(codes: Mapping) -> list[ob.Want]:
    other = codes["other"]
    referred = codes["referred_from"]
    return [
        *_each(ob.text, codes, "chart_number", "referral_reason_other", "referred_by_other", "provider",
               "delivery_place_other", "delivery_facility_other", "staff_completing"),
        *_each(ob.answer_list, codes, "referred_from", "referral_reason", "referred_by", "baby_sex", "delivery_place",
               "delivery_facility", "delivery_mode", "apgar_1_min_coded", "apgar_5_min_coded", "assisted_ventilation",
               "scbu_outcome"),
        ob.answer_list("treatment_provided_coded", codes["treatment_provided"], ","),
        ob.answer_list("admission_problems", codes["admission_problems"], ","),
        ob.answer_list("supportive_care", codes["supportive_care"], ","),
        ob.remark("referred_from_other", referred, other),
        ob.remark("referred_other_own_site", referred, codes["own_site"]),
        ob.remark("referred_other_site", referred, codes["other_site"]),
        ob.remark("treatment_provided_noncoded", codes["treatment_provided"], other),
        ob.remark("admission_problems_other", codes["admission_problems"], other),
        ob.remark("supportive_care_other", codes["supportive_care"], other),
        *_each(ob.when, codes, "management_datetime", "admission_datetime", "discharge_datetime"),
        ob.number("admission_age_days", codes["age_days"]).top(),
        *_each(ob.number, codes, "admission_age_hours", "baby_admission_weight", "number_of_anc", "apgar_1_min_numeric",
               "apgar_5_min_numeric", "birth_weight", "gestation_age"),
        ob.answer_label("_died", codes["scbu_outcome"], codes["died"]),
    ]


def newborn_register(clinic: Clinic, start=None, end=None) -> DataFrame:
    """One row per newborn-unit encounter, with the death group spread out."""
    codes = clinic.codes
    anchors = clinic.encounters("newborn_register", start, end).select(
        "patient_id", "encounter_id", F.col("encounter_datetime").alias("arrival_datetime"), "creator",
        F.col("date_created").alias("date_entered"), "location_id",
    )
    obs = clinic.live_obs(anchors, start, end)
    wants = newborn_register_wants(codes)
    prior = ob.construct_children(
        obs, {"prior": codes["prior_diagnosis_construct"]},
        [ob.answer_list("diagnoses_coded", codes["coded_diagnosis"], ","), ob.text("diagnoses_noncoded", codes["noncoded_diagnosis"])],
        label_table=clinic.labels,
    )
    death = ob.group_matrix(
        obs, "encounter_id",
        [
            ob.when("datetime", codes["death_datetime"]), ob.answer_list("cause", codes["cause_of_death"]),
            ob.text("other_cause", codes["other_cause"]), ob.number("age_days", codes["age_days"]), ob.number("weight", codes["weight"]),
        ],
        constructs={"death": codes["death_construct"]}, label_table=clinic.labels,
    )
    rows = clinic.with_identifiers(anchors, ["emr_id"])
    rows = clinic.with_user(rows, "user_entered", "username")
    rows = clinic.with_location(rows, "encounter_location")
    rows = rows.join(prior, "encounter_id", "left").join(death, "encounter_id", "left")
    rows = ob.register(rows, obs, wants, label_table=clinic.labels)
    shown = rows.select(
        "emr_id", "encounter_id", "user_entered", "date_entered", "encounter_location", "arrival_datetime",
        *[w.column for w in wants if w.column != "_died"],
        # Death is the outcome only when it is the one answer given.
        F.when(F.col("scbu_outcome") == F.col("_died"), True).alias("death_outcome"), "prior_diagnoses_coded", "prior_diagnoses_noncoded", "death_datetime",
        F.col("death_cause").alias("cause_of_death"), F.col("death_other_cause").alias("other_cause"),
        "death_age_days", "death_weight",
    )
    return in_order(shown, columns.NEWBORN_REGISTER)


# Answer flags of the delivery form.
MOTHER_FINDINGS = (
    "gbv_victim", "chorioamnionitis", "severe_preeclampsia", "eclampsia", "prolonged_labor", "acute_pulmonary_edema",
    "puerperal_sepsis", "herpes_simplex", "syphilis", "other_sti", "postpartum_hemorrhage",
)
BABY_FINDINGS = (
    "placental_abnormality", "malpresentation_fetus", "cephalopelvic_disproportion", "lbw_1000_1249", "lbw_1250_1499",
    "lbw_1500_1749", "lbw_1750_1999", "lbw_2000_2499", "extreme_premature_less_28", "very_premature_28_32",
    "moderate_prematurity_33_36", "respiratory_distress", "birth_asphyxia", "fetal_distress", "intrauterine_fetal_demise",
    "intrauterine_growth_retardation", "congenital_malformation", "premature_rupture_membranes", "meconium_aspiration",
)


def delivery_form_wants(codes: Mapping) -> list[ob.Want]:
    return [
        *_each(ob.number, codes, "birth_weight", "blood_loss", "gravida", "parity", "gestational_age",
               "apgar_score_onemin", "apgar_score_5min", "apgar_score_10min"),
        *_each(ob.answer_list, codes, "perineal_tear", "counselled_hiv_testing", "presentation_position", "delivery_type",
               "delivery_outcome", "partograph", "uterotonic", "newborn_sex", "breastfeeding", "fp_counselling",
               "family_planning", "maternal_disposition", "hcw_type"),
        *[ob.answered(name, codes["diagnosis"], codes[name]) for name in MOTHER_FINDINGS],
        ob.answered("other", codes["findings"], codes["other_answer"]),
        ob.remark("other_free_response", codes["findings"], codes["other_answer"]),
        *[ob.answered(name, codes["newborn_findings"], codes[name]) for name in BABY_FINDINGS],
        *_each(ob.text, codes, "clinical_note", "presentation_other", "hcw_delivery"),
        *_each(ob.when, codes, "exit_date", "admission_datetime", "labour_datetime", "delivery_datetime"),
    ]


def _pac_rows(clinic: Clinic, obs: DataFrame) -> DataFrame:
    """One row per answer of the post-abortion-care question; it may repeat."""
    rows = obs.filter(F.col("concept_id") == clinic.codes["pac_type"]).select("encounter_id", "value_coded")
    return with_labels(rows, clinic.labels, out="pac_type").select("encounter_id", "pac_type")


def delivery_form(clinic: Clinic) -> DataFrame:
    """One row per delivery encounter and post-abortion-care answer."""
    codes = clinic.codes
    anchors = clinic.encounters("delivery").select("patient_id", "encounter_id", "encounter_datetime", "location_id")
    obs = clinic.live_obs(anchors)
    wants = delivery_form_wants(codes)
    # The first diagnosis by group, then by entry, with what its group says about it.
    lead = first_rows(
        obs.filter(F.col("concept_id") == codes["diagnosis"]), ["encounter_id"], ["obs_group_id", "date_created", "obs_id"], 1, "_n"
    ).select("encounter_id", "obs_group_id", "value_coded")
    lead = with_labels(lead, clinic.labels, out="presumed_or_confirmed_diagnosis")
    group = ob.group_values(
        obs, [ob.answer_list("_order", codes["diagnosis_order"]), ob.answer_list("_certainty", codes["diagnosis_certainty"])], clinic.labels
    )
    lead = lead.join(group, "obs_group_id", "left").select(
        "encounter_id", "presumed_or_confirmed_diagnosis", F.col("_order").isNotNull().alias("primary_diagnosis"),
        F.col("_certainty").isNotNull().alias("confirmed_diagnoses"),
    )
    rows = clinic.with_identifiers(anchors, ["emr_id"])
    rows = clinic.with_provider(rows, "provider")
    rows = clinic.with_location(rows, "location")
    rows = rows.join(lead, "encounter_id", "left").join(_pac_rows(clinic, obs), "encounter_id", "left")
    rows = ob.register(rows, obs, wants, label_table=clinic.labels)
    shown = rows.select(
        "emr_id", "provider", "location", F.to_date("encounter_datetime").alias("form_date"),
        F.lit(None).cast("date").alias("estimated_delivery_date"), F.lit(None).cast("double").alias("estimated_blood_loss"),
        *[w.column for w in wants], "presumed_or_confirmed_diagnosis", "primary_diagnosis", "confirmed_diagnoses",
        "pac_type", F.col("exit_date").alias("maternal_outcome_date"),
    )
    return in_order(shown, columns.DELIVERY_FORM)


def delivery_register_wants(codes: Mapping) -> list[ob.Want]:
    return [
        *_each(ob.when, codes, "admission_datetime", "labour_datetime", "delivery_datetime"),
        *_each(ob.number, codes, "gravida", "parity", "gestational_age", "newborn_weight", "newborn_apgar"),
        *_each(ob.answer_list, codes, "presentation_position", "delivery_type", "delivery_outcome", "partograph", "uterotonic",
               "newborn_alive", "newborn_sex", "breastfeeding", "fp_counselling", "family_planning", "maternal_disposition",
               "hcw_type"),
        *_each(ob.text, codes, "presentation_other", "hcw_delivery"),
    ]


def delivery_register(clinic: Clinic, start, end) -> DataFrame:
    """One row per register encounter and post-abortion-care answer (encounters
    without one drop out), with ranked diagnoses as columns."""
    codes = clinic.codes
    anchors = clinic.encounters("delivery_register", start, end).select("patient_id", "encounter_id", "location_id")
    obs = clinic.live_obs(anchors, start, end)
    wants = delivery_register_wants(codes)
    order = ["obs_group_id", "date_created", "obs_id"]
    coded = with_labels(obs.filter(F.col("concept_id") == codes["coded_diagnosis"]), clinic.labels)
    six = pivot_ranked(coded, ["encounter_id"], order, {"diagnosis": "label"}, 6)
    free = obs.filter(F.col("concept_id") == codes["noncoded_diagnosis"])
    two = pivot_ranked(free, ["encounter_id"], order, {"other": "value_text"}, 2)
    rows = clinic.with_identifiers(anchors, ["emr_id"])
    rows = clinic.with_provider(rows, "provider")
    rows = clinic.with_location(rows, "location")
    rows = rows.join(_pac_rows(clinic, obs), "encounter_id")
    rows = rows.join(six, "encounter_id", "left").join(two, "encounter_id", "left")
    rows = ob.register(rows, obs, wants, label_table=clinic.labels)
    shown = rows.select(
        "emr_id", "provider", "location", "pac_type", *[w.column for w in wants],
        *[F.col(f"diagnosis_{i}").alias(f"initial_diagnosis_{i}") for i in (1, 2, 3)],
        F.col("other_1").alias("initial_diagnosis_other"),
        *[F.col(f"diagnosis_{i + 3}").alias(f"final_diagnosis_{i}") for i in (1, 2, 3)],
        F.col("other_2").alias("final_diagnosis_other"),
        F.to_date(clinic.as_of).alias("maternal_outcome_date"),
    )
    return in_order(shown, columns.DELIVERY_REGISTER)


def _discharged(clinic: Clinic, types: Sequence, day, place) -> DataFrame:
    rows = not_voided(on_date_at_location(in_months(clinic["encounter"], day, day), types, day, place))
    return rows.select("patient_id", "encounter_id", "visit_id", "encounter_datetime")


def _discharges(clinic: Clinic, types: Sequence, day, place) -> DataFrame:
    rows = _discharged(clinic, types, day, place)
    rows = clinic.with_identifiers(rows, ["emr_id"])
    rows = clinic.with_name(rows, "name")
    rows = clinic.with_provider(rows, "discharge_provider")
    return rows.withColumn("discharged", readable_datetime(F.col("encounter_datetime")))


def discharge_list(clinic: Clinic, day, place) -> DataFrame:
    """Patients discharged from a ward on a day; the latest disposition of the visit counts."""
    rows = _discharges(clinic, clinic.types["discharge"], day, place)
    # Observations of the listed visits, found through the encounters of those visits.
    obs = clinic.visit_obs(_discharged(clinic, clinic.types["discharge"], day, place), day, day)
    obs = obs.filter(F.col("concept_id") == clinic.codes["disposition"])
    latest = ob.collect_obs(obs, "visit_id", [ob.label("disposition", clinic.codes["disposition"])], clinic.labels)
    rows = rows.join(latest, "visit_id", "left")
    return rows.select("emr_id", "name", "discharged", "disposition", "discharge_provider")


def newborn_discharge_list(clinic: Clinic, day) -> DataFrame:
    """Newborns discharged on a day, inborn or outborn."""
    rows = _discharges(clinic, clinic.types["newborn_discharge"], day, clinic.places["newborn"])
    disposition = clinic.codes["disposition"]
    listed = ob.collect_obs(
        clinic.live_obs(rows, day, day), "encounter_id", [ob.answer_list("disposition", disposition)], clinic.labels
    )
    rows = rows.join(listed, "encounter_id", "left")
    rows = born_in_facility(rows, clinic["visit_attribute"], clinic.attributes["born_during_visit"])
    return rows.select("emr_id", "name", "discharged", "disposition", "discharge_provider", "inborn_outborn")


def register_bundle(clinic: Clinic, start=None, end=None) -> dict[str, DataFrame]:
    """The maternal and the newborn register of one request."""
    return {
        "maternal_register": maternal_register(clinic, start, end),
        "newborn_register": newborn_register(clinic, start, end),
    }
