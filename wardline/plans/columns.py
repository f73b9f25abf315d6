"""Column order of the wide reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

# The order in which readers of the files expect the columns.
CHRONIC_ENCOUNTERS = (
    "patient_id emr_id encounter_id encounter_datetime datetime_entered visit_id ncd_program_id provider user_entered encounter_location "
    "encounter_type visit_type care_household vulnerable education_level literacy_level employment_status referred_from other_referral "
    "social_support social_support_type other_social_support missed_school days_lost_schooling hiv risk_factors comorbidities bp_systolic "
    "bp_diastolic glucose_fingerstick fbg_level rbg_level bmi obesity number_hospitalizations_last_12_months "
    "last_hospitalization_discharge_date last_hospitalization_outcome number_hospitalizations_ncd hospitalization_dka_last_12_months "
    "number_days_hospitalized ncd_diagnoses_caused_hospitalization number_hospitalizations_since_visit diabetes hypertension heart_failure "
    "cardiomyopathy chronic_lung_disease chronic_kidney_disease liver_cirrhosis_hepb palliative_care sickle_cell other_ncd "
    "diabetes_onset_date hypertension_onset_date heart_failure_onset_date chronic_lung_disease_onset_date chronic_kidney_disease_onset_date "
    "liver_cirrhosis_hepb_onset_date palliative_care_onset_date sickle_cell_onset_date other_ncd_onset_date treatment_with_hydroxyurea "
    "reason_no_hydroxyurea diabetes_type diabetes_control diabetes_on_insulin diabetes_home_glucometer diabetes_complications lab_order_hba1c "
    "hypertension_type hypertension_stage hypertension_controlled rheumatic_heart_disease congenital_heart_disease nyha_classification "
    "lung_disease_type on_saba on_oral_salbutamol on_steroid_inhaler ckd_stage ckd_controlled liver_disease_controlled sickle_cell_type "
    "sickle_cell_complications next_appointment_date disposition transfer_site echocardiogram_findings on_ace_inhibitor on_beta_blocker "
    "secondary_antibiotic_prophylaxis referred_to_surgery_for_heart_failure cardiac_surgery_scheduled type_cardiac_surgery "
    "cardiac_surgery_performed cardiac_surgery_performed_date scd_penicillin_treatment scd_folic_acid_treatment transfusion_past_12_months "
    "transfusion_date asthma_severity nighttime_waking_asthma symptoms_2x_week_asthma inhaler_for_symptoms_2x_week_asthma "
    "activity_limitation_asthma asthma_control_gina on_esophageal_varices_prophylaxis echocardiogram_date lab_tests_ordered "
    "diabetes_section_populated heart_failure_section_populated hypertension_section_populated kidney_section_populated "
    "liver_section_populated lung_section_populated palliative_care_section_populated sickle_cell_section_populated index_asc index_desc"
).split()
MATERNAL_REGISTER = (
    "emr_id address age_at_enc encounter_id encounter_datetime user_entered date_entered encounter_location admission_datetime gravida parity "
    "gestational_age pac_type labor_start_datetime pres_and_position pres_and_position_other delivery_datetime delivery_type delivery_outcome "
    "partograph_used uterotonic_given baby_alive baby_sex baby_weight apgar breastfeeding_1_hour initial_coded_diagnoses "
    "initial_noncoded_diagnosis final_coded_diagnoses final_noncoded_diagnosis counselled_fp received_fp disposition hcw_name hcw_cadre "
    "hcw_cadre_other"
).split()
NEWBORN_REGISTER = (
    "emr_id encounter_id user_entered date_entered encounter_location chart_number arrival_datetime referred_from referred_from_other "
    "referred_other_own_site referred_other_site referral_reason referral_reason_other referred_by referred_by_other management_datetime "
    "provider admission_datetime admission_age_days admission_age_hours baby_sex baby_admission_weight delivery_place delivery_place_other "
    "delivery_facility delivery_facility_other number_of_anc delivery_mode prior_diagnoses_coded prior_diagnoses_noncoded "
    "treatment_provided_coded treatment_provided_noncoded apgar_1_min_numeric apgar_1_min_coded apgar_5_min_numeric apgar_5_min_coded "
    "assisted_ventilation birth_weight gestation_age admission_problems admission_problems_other supportive_care supportive_care_other "
    "scbu_outcome death_outcome death_datetime cause_of_death other_cause death_age_days death_weight discharge_datetime staff_completing"
).split()
DELIVERY_FORM = (
    "emr_id provider location form_date estimated_delivery_date birth_weight estimated_blood_loss perineal_tear gbv_victim chorioamnionitis "
    "severe_preeclampsia eclampsia prolonged_labor acute_pulmonary_edema puerperal_sepsis herpes_simplex syphilis other_sti other "
    "other_free_response postpartum_hemorrhage blood_loss placental_abnormality malpresentation_fetus cephalopelvic_disproportion "
    "lbw_1000_1249 lbw_1250_1499 lbw_1500_1749 lbw_1750_1999 lbw_2000_2499 extreme_premature_less_28 very_premature_28_32 "
    "moderate_prematurity_33_36 respiratory_distress birth_asphyxia fetal_distress intrauterine_fetal_demise intrauterine_growth_retardation "
    "congenital_malformation premature_rupture_membranes meconium_aspiration exit_date presumed_or_confirmed_diagnosis clinical_note "
    "primary_diagnosis confirmed_diagnoses counselled_hiv_testing admission_datetime gravida parity labour_datetime presentation_position "
    "presentation_other delivery_datetime gestational_age delivery_type delivery_outcome partograph uterotonic newborn_sex apgar_score_onemin "
    "apgar_score_5min apgar_score_10min breastfeeding pac_type fp_counselling family_planning maternal_outcome_date maternal_disposition "
    "hcw_delivery hcw_type"
).split()
DELIVERY_REGISTER = (
    "emr_id provider location admission_datetime gravida parity gestational_age pac_type labour_datetime presentation_position "
    "presentation_other delivery_datetime delivery_type delivery_outcome partograph uterotonic newborn_alive newborn_sex newborn_weight "
    "newborn_apgar breastfeeding initial_diagnosis_1 initial_diagnosis_2 initial_diagnosis_3 initial_diagnosis_other final_diagnosis_1 "
    "final_diagnosis_2 final_diagnosis_3 final_diagnosis_other fp_counselling family_planning maternal_outcome_date maternal_disposition "
    "hcw_delivery hcw_type"
).split()
MENTAL_HEALTH_ENCOUNTERS = (
    "patient_id emr_id location_registered age_at_encounter address encounter_id encounter_type visit_id encounter_datetime provider "
    "referred_by_community other_community_referral referred_by_facility other_facility_referral history_of_homelessness housing_type hiv_test "
    "arv_start_date tb_smear_result extrapulmonary_tuberculosis alcohol_history alcohol_duration marijuana_history marijuana_duration "
    "other_drug_history other_drug_duration other_drug_name traditional_medicine_history family_epilepsy family_mental_illness "
    "family_behavioral_problems presenting_features other_presenting_features clinical_impressions mental_state_exam_findings "
    "other_mental_state_exam_finding past_suicidal_ideation past_suicidal_attempt current_suicidal_ideation current_suicidal_attempt "
    "date_latest_suicidal_attempt psychosocial_counseling interventions diagnosis_1 diagnosis_2 diagnosis_3 diagnosis_4 noncoded_diagnosis "
    "seizure_frequency cgi_s cgi_i cgi_e"
).split()
# After the drugs.
MENTAL_HEALTH_LAST = "additional_medication_comments assigned_chw return_visit_date".split()


def in_order(df: DataFrame, first: Sequence[str], last: Sequence[str] = ()) -> DataFrame:
    """The same columns, those named in front or at the end in that order and the others between.

    A name the table lacks is an error.
    """
    placed = {*first, *last}
    return df.select(*first, *[c for c in df.columns if c not in placed], *last)
