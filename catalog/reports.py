"""Reports bound to the given tables."""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import functions as F

from catalog.base import NOW, months_sql, query, weeks_sql, years_sql
from wardline.functions.dates import moment
from wardline.operators import observations as ob
from wardline.operators.filters import shift_window
from wardline.plans import maternity, outpatient, patients, programs, wards
from wardline.plans.clinic import ADDRESS_ORDER, Clinic


class Roles(dict):
    """Concept ids by role; roles not listed are spread over the seven questions."""

    def __missing__(self, role: str) -> int:
        return 1 + crc32(role.encode()) % 7


CODES = Roles(
    yes=1, no=2, prior_diagnosis_construct=101, diagnosis_construct=102, death_construct=103, diabetes_construct=101,
    hypertension_construct=102, kidney_construct=103, liver_construct=101, limitation_construct=102, ace_construct=103,
    risk_alcohol=1, risk_smoking=2, risk_cooking=5, risk_salt=7, unspecified=23, type_1=14, type_2=15, gestational=16,
    sickle_trait=17, sickle_anemia=18, beta_thalassemia=19, hemoglobin_c=20, other_hemoglobinopathy=21,
)
IDENTIFIERS = {"emr_id": 1, "clinic_id": 2, "national_id": 3}
TYPES = {
    "registration": ["5-LOW"], "triage": ["1-URGENT"], "maternal_register": ["2-HIGH"], "newborn_register": ["3-MEDIUM"],
    "delivery": ["1-URGENT", "2-HIGH"], "delivery_register": ["4-NOT SPECIFIED"], "mental_health": ["2-HIGH", "3-MEDIUM"],
    "chronic": ["1-URGENT", "3-MEDIUM", "5-LOW"], "lab_result": ["1-URGENT"], "dispensing": ["4-NOT SPECIFIED"], "test_order": [1],
}


def clinic(t, person: bool = False) -> Clinic:
    tables = {
        "obs": t.probs if person else t.robs, "encounter": t.encounter, "visit": t.visit, "person": t.person,
        "person_name": t.person_name, "person_address": t.person_address, "person_attribute": t.person_attribute,
        "patient_identifier": t.patient_identifier, "location": t.location, "users": t.users, "provider": t.provider,
        "encounter_provider": t.encounter_provider, "encounter_type": t.encounter_type, "concept_name": t.concept_name,
        "concept_set": t.concept_set, "concept_map": t.concept_map, "orders": t.orders_placed, "patient_program": t.patient_program,
        "patient_state": t.patient_state, "program_workflow_state": t.program_workflow_state, "program": t.program,
        "relationship": t.relationship,
    }
    return Clinic(
        tables, moment("2002-01-01 00:00:00"), CODES, TYPES, IDENTIFIERS, programs={"chronic": 1, "mental_health": 1},
        attributes={"unknown": "unknown", "phone": "phone", "test": "test"},
    )


# ---- SQL pieces

def _values(values) -> str:
    return ", ".join(str(v) for v in values)


def hit_sql(w: ob.Want) -> str:
    text = f"concept_id IN ({_values(w.concepts)})"
    if w.answers and w.how != "yes_no":
        text += f" AND value_coded IN ({_values(w.answers)})"
    if w.top_level:
        text += " AND obs_group_id IS NULL"
    return text


def want_sql(w: ob.Want) -> str:
    hit = hit_sql(w)
    if w.how == "latest":
        out = f"arg_max({w.field}, (obs_datetime, obs_id)) FILTER (WHERE {hit} AND {w.field} IS NOT NULL)"
    elif w.how in ("max", "min"):
        out = f"{w.how}({w.field}) FILTER (WHERE {hit})"
    elif w.how == "list":
        out = f"string_agg(DISTINCT label, '{w.separator}' ORDER BY label) FILTER (WHERE {hit})"
    elif w.how == "yes_no":
        out = f"bool_or(CASE value_coded WHEN {w.answers[0]} THEN TRUE WHEN {w.answers[1]} THEN FALSE END) FILTER (WHERE {hit})"
    elif w.how == "answered":
        out = f"bool_or({hit})"
    elif w.how == "answered_or_null":
        out = f"CASE WHEN bool_or({hit}) THEN TRUE END"
    else:
        out = f"count(*) FILTER (WHERE {hit})"
    return f"{out} AS {w.column}"


def wide_sql(name: str, wants, key: str = "encounter_id", obs: str = "robs", where: str = "", label: str = "label_en") -> str:
    return (
        f"{name} AS (SELECT {key}, {', '.join(want_sql(w) for w in wants)} FROM (SELECT o.*, label FROM {obs} o "
        f"LEFT JOIN {label} l ON o.value_coded = l.concept_id WHERE NOT voided {where}) GROUP BY {key})"
    )


def shown(wants, prefix: str = "w") -> str:
    """Report columns of the wants; a missing answer flag reads false."""
    return ", ".join(
        f"coalesce({prefix}.{w.column}, FALSE) AS {w.column}" if w.how == "answered" else f"{prefix}.{w.column}"
        for w in wants if not w.column.startswith("_")
    )


def child_sql(name: str, parents: dict, wants, obs: str = "robs") -> str:
    """Children of constructs, one aggregate per (encounter, construct), spread."""
    long = (
        f"{name}_l AS (SELECT encounter_id, construct, {', '.join(want_sql(w) for w in wants)} FROM (SELECT o.*, h.concept_id AS construct, label FROM {obs} o "
        f"JOIN {obs} h ON o.obs_group_id = h.obs_id AND NOT h.voided AND h.concept_id IN ({_values(set(parents.values()))}) "
        f"LEFT JOIN label_en l ON o.value_coded = l.concept_id WHERE NOT o.voided) GROUP BY encounter_id, construct)"
    )
    spread = ", ".join(
        f"max(CASE WHEN construct = {c} THEN {w.column} END) AS {p}_{w.column}" for p, c in parents.items() for w in wants
    )
    return f"{long}, {name} AS (SELECT encounter_id, {spread} FROM {name}_l GROUP BY encounter_id)"


IDS = """
ids AS (SELECT patient_id, max(CASE WHEN identifier_type = 1 THEN identifier END) AS emr_id, max(CASE WHEN identifier_type = 2 THEN identifier END) AS clinic_id,
  max(CASE WHEN identifier_type = 3 THEN identifier END) AS national_id FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, identifier_type ORDER BY preferred DESC, patient_identifier_id) AS r
  FROM patient_identifier WHERE NOT voided) WHERE r = 1 GROUP BY patient_id)
"""
NAMES = """
nm AS (SELECT person_id, given_name, family_name, concat_ws(' ', given_name, family_name) AS called FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY preferred DESC, date_created DESC, person_name_id) AS r
  FROM person_name WHERE NOT voided) WHERE r = 1)
"""
_FORMATTED = "concat_ws(', ', " + ", ".join(f"nullif(trim({c}), '')" for c in ADDRESS_ORDER) + ")"
ADDRESS = f"""
ad AS (SELECT *, {_FORMATTED} AS formatted FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY preferred DESC, date_created DESC, person_address_id) AS r FROM person_address WHERE NOT voided) WHERE r = 1)
"""
REGISTRATION = """
rg AS (SELECT x.patient_id, l.name AS loc_registered FROM (SELECT patient_id, location_id, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime, encounter_id) AS r
  FROM encounter WHERE NOT voided AND encounter_type = '5-LOW') x JOIN location l ON x.location_id = l.location_id WHERE r = 1)
"""
PROVIDER = """
pv AS (SELECT f.encounter_id, p.name AS provider FROM (SELECT encounter_id, min(provider_id) AS provider_id FROM encounter_provider WHERE NOT voided GROUP BY encounter_id) f JOIN provider p ON f.provider_id = p.provider_id)
"""
UNKNOWN = """
un AS (SELECT person_id, max(value) AS unknown_patient FROM person_attribute WHERE NOT voided AND attribute_type = 'unknown' GROUP BY person_id)
"""
PHONE = "ph AS (SELECT person_id, max(value) AS phone FROM person_attribute WHERE NOT voided AND attribute_type = 'phone' GROUP BY person_id)"
AT_2002 = "TIMESTAMP '2002-01-01 00:00:00'"
_AGE_ENC = years_sql("p.birthdate", "e.encounter_datetime")


def day(column: str) -> str:
    return f"CAST(CAST({column} AS DATE) AS VARCHAR)"


# ---- patients

@query("patient_list", f"""
WITH {IDS}, {NAMES}, {ADDRESS}, {PHONE}
SELECT family_name, given_name, country, county_district AS district, state_province AS chiefdom, address1 AS section, city_village AS village, address2 AS address,
  birthdate, birthdate_estimated, {years_sql('birthdate', AT_2002)} AS age, gender, emr_id, clinic_id, national_id, phone AS telephone_number
FROM person p LEFT JOIN nm ON p.person_id = nm.person_id LEFT JOIN ad ON p.person_id = ad.person_id LEFT JOIN ids ON p.person_id = ids.patient_id LEFT JOIN ph ON p.person_id = ph.person_id WHERE NOT p.voided
""")
def _(t):
    return patients.patient_list(clinic(t))


_TRIAGE = patients.triage_wants(CODES)
_TRIAGE_SETS = {name: kind for name, kind in zip(
    patients.TRIAGE_CATEGORIES,
    ("ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO", "STANDARD", "BIG", "ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO", "STANDARD"),
)}


@query("triage_export", f"""
WITH {wide_sql('w', _TRIAGE)}, {IDS}, {REGISTRATION}, {PROVIDER}, {UNKNOWN},
cs AS (SELECT encounter_id, concept_set, label FROM (SELECT encounter_id, concept_set, label, row_number() OVER (PARTITION BY encounter_id, concept_set ORDER BY obs_id) AS r
  FROM robs o JOIN (SELECT DISTINCT concept_id, concept_set FROM concept_set) m ON o.value_coded = m.concept_id LEFT JOIN label_en l ON o.value_coded = l.concept_id WHERE NOT voided AND o.concept_id = {CODES['triage_diagnosis']}) WHERE r = 1),
sy AS (SELECT encounter_id, {', '.join(f"max(CASE WHEN concept_set = '{s}' THEN label END) AS {n}" for n, s in _TRIAGE_SETS.items())} FROM cs GROUP BY encounter_id)
SELECT CAST(e.patient_id AS VARCHAR) AS patient_id, emr_id, clinic_id, national_id, CAST(e.encounter_id AS VARCHAR) AS encounter_id, CAST(e.visit_id AS VARCHAR) AS visit_id, loc_registered, unknown_patient, gender,
  {_AGE_ENC} AS age_at_encounter, v.date_started AS ed_visit_start_datetime, e.encounter_datetime, l.name AS encounter_location, provider, {day('e.date_created')} AS date_entered, u.person_name AS user_entered,
  {shown(_TRIAGE)}, {', '.join('sy.' + n for n in _TRIAGE_SETS)}, CAST(NULL AS INT) AS index_asc, CAST(NULL AS INT) AS index_desc
FROM encounter e LEFT JOIN w ON e.encounter_id = w.encounter_id LEFT JOIN sy ON e.encounter_id = sy.encounter_id LEFT JOIN ids ON e.patient_id = ids.patient_id LEFT JOIN rg ON e.patient_id = rg.patient_id
LEFT JOIN un ON e.patient_id = un.person_id LEFT JOIN person p ON e.patient_id = p.person_id LEFT JOIN visit v ON e.visit_id = v.visit_id LEFT JOIN location l ON e.location_id = l.location_id
LEFT JOIN pv ON e.encounter_id = pv.encounter_id LEFT JOIN users u ON e.creator = u.user_id WHERE e.encounter_type = '1-URGENT' AND NOT e.voided
""")
def _(t):
    return patients.triage_export(clinic(t), _TRIAGE_SETS)


_DX_SETS = dict(zip(
    patients.DIAGNOSIS_CLASSES,
    ("ECONOMY", "SMALL", "MEDIUM", "LARGE", "PROMO", "STANDARD", "BIG", "ECONOMY", "SMALL", "MEDIUM", "LARGE"),
))


@query("diagnosis_export", f"""
WITH {IDS}, {REGISTRATION}, {PROVIDER}, {UNKNOWN}, {wide_sql('g', [ob.label('dx_order', CODES['diagnosis_order']), ob.label('certainty', CODES['diagnosis_certainty'])], 'obs_group_id', 'probs', 'AND obs_group_id IS NOT NULL')},
ada AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY preferred DESC, date_created DESC, person_address_id) AS r FROM person_address),
cd AS (SELECT concept_id, min(code) AS code FROM concept_map WHERE source = 'NAMES' GROUP BY concept_id),
fl AS (SELECT concept_id, {', '.join(f"max(CASE WHEN concept_set = '{s}' THEN 1 ELSE 0 END) AS {n}" for n, s in _DX_SETS.items())} FROM concept_set GROUP BY concept_id),
dx AS (SELECT person_id AS patient_id, o.encounter_id, obs_id, obs_datetime, l.label AS diagnosis_entered, dx_order, certainty, '1' AS coded, value_coded AS diagnosis_concept, l.label AS diagnosis_coded_en, code AS icd10_code,
    {', '.join(f'coalesce({n}, 0) AS {n}' for n in _DX_SETS)}
  FROM probs o LEFT JOIN g ON o.obs_group_id = g.obs_group_id LEFT JOIN label_en l ON value_coded = l.concept_id LEFT JOIN cd ON value_coded = cd.concept_id LEFT JOIN fl ON value_coded = fl.concept_id
  WHERE o.concept_id = {CODES['diagnosis']} AND NOT voided AND obs_datetime >= TIMESTAMP '1996-01-01 00:00:00'
  UNION ALL SELECT person_id, encounter_id, obs_id, obs_datetime, value_text, NULL, NULL, '0', NULL, NULL, NULL, {', '.join('NULL' for _ in _DX_SETS)}
  FROM probs WHERE concept_id = {CODES['diagnosis_free_text']} AND NOT voided AND obs_datetime >= TIMESTAMP '1996-01-01 00:00:00')
SELECT dx.patient_id, emr_id, clinic_id, national_id, loc_registered, unknown_patient, gender, {_AGE_ENC} AS age_at_encounter, state_province AS department, city_village AS commune, address3 AS section,
  address1 AS locality, address2 AS street_landmark, dx.encounter_id, w.name AS encounter_location, obs_id, obs_datetime, u.person_name AS entered_by, provider, diagnosis_entered, dx_order, certainty, coded,
  diagnosis_concept, diagnosis_coded_en, icd10_code, {', '.join(_DX_SETS)}, e.date_created, trunc((epoch_us(e.date_created) - epoch_us(obs_datetime)) / 1000000.0) > 1800 AS retrospective, e.visit_id, p.birthdate, p.birthdate_estimated, y.name AS encounter_type
FROM dx LEFT JOIN encounter e ON dx.encounter_id = e.encounter_id LEFT JOIN ids ON dx.patient_id = ids.patient_id LEFT JOIN rg ON dx.patient_id = rg.patient_id LEFT JOIN un ON dx.patient_id = un.person_id
LEFT JOIN person p ON dx.patient_id = p.person_id LEFT JOIN (SELECT * FROM ada WHERE r = 1) a ON dx.patient_id = a.person_id LEFT JOIN location w ON e.location_id = w.location_id LEFT JOIN users u ON e.creator = u.user_id
LEFT JOIN pv ON dx.encounter_id = pv.encounter_id LEFT JOIN encounter_type y ON e.encounter_type = y.encounter_type_id
""")
def _(t):
    return patients.diagnosis_export(clinic(t, True), _DX_SETS, "NAMES", start="1996-01-01")


# ---- maternity

_MATERNAL = maternity.maternal_register_wants(CODES)
_DX = [ob.answer_list("coded_diagnoses", CODES["coded_diagnosis"], ","), ob.text("noncoded_diagnosis", CODES["noncoded_diagnosis"])]


@query("maternal_register", f"""
WITH {wide_sql('w', _MATERNAL)}, {child_sql('c', {'initial': 101, 'final': 102}, _DX)}, {IDS}, {ADDRESS}
SELECT emr_id, formatted AS address, {_AGE_ENC} AS age_at_enc, e.encounter_id, e.encounter_datetime, username AS user_entered, e.date_created AS date_entered, l.name AS encounter_location, {shown(_MATERNAL)},
  initial_coded_diagnoses, initial_noncoded_diagnosis, final_coded_diagnoses, final_noncoded_diagnosis
FROM encounter e LEFT JOIN w ON e.encounter_id = w.encounter_id LEFT JOIN c ON e.encounter_id = c.encounter_id LEFT JOIN ids ON e.patient_id = ids.patient_id LEFT JOIN ad ON e.patient_id = ad.person_id
LEFT JOIN person p ON e.patient_id = p.person_id LEFT JOIN users u ON e.creator = u.user_id LEFT JOIN location l ON e.location_id = l.location_id
WHERE e.encounter_type = '2-HIGH' AND NOT e.voided AND CAST(e.encounter_datetime AS DATE) BETWEEN DATE '1995-06-01' AND DATE '2001-06-30'
""")
def _(t):
    return maternity.maternal_register(clinic(t), "1995-06-01", "2001-06-30")


_NEWBORN = maternity.newborn_register_wants(CODES)
_PRIOR = [ob.answer_list("diagnoses_coded", CODES["coded_diagnosis"], ","), ob.text("diagnoses_noncoded", CODES["noncoded_diagnosis"])]
_DEATH = [
    ob.when("datetime", CODES["death_datetime"]), ob.answer_list("cause", CODES["cause_of_death"]), ob.text("other_cause", CODES["other_cause"]),
    ob.number("age_days", CODES["age_days"]), ob.number("weight", CODES["weight"]),
]


@query("newborn_register", f"""
WITH {wide_sql('w', _NEWBORN)}, {child_sql('c', {'prior': 101}, _PRIOR)}, {child_sql('d', {'death': 103}, _DEATH)}, {IDS}
SELECT emr_id, e.encounter_id, username AS user_entered, e.date_created AS date_entered, l.name AS encounter_location, e.encounter_datetime AS arrival_datetime, {shown(_NEWBORN)},
  CASE WHEN scbu_outcome = _died THEN TRUE END AS death_outcome, prior_diagnoses_coded, prior_diagnoses_noncoded, death_datetime, death_cause AS cause_of_death, death_other_cause AS other_cause, death_age_days, death_weight
FROM encounter e LEFT JOIN w ON e.encounter_id = w.encounter_id LEFT JOIN c ON e.encounter_id = c.encounter_id LEFT JOIN d ON e.encounter_id = d.encounter_id LEFT JOIN ids ON e.patient_id = ids.patient_id
LEFT JOIN users u ON e.creator = u.user_id LEFT JOIN location l ON e.location_id = l.location_id WHERE e.encounter_type = '3-MEDIUM' AND NOT e.voided
""")
def _(t):
    return maternity.newborn_register(clinic(t))


_FORM = maternity.delivery_form_wants(CODES)
_PAC = f"""
pac AS (SELECT encounter_id, label AS pac_type FROM robs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id = {CODES['pac_type']})
"""


@query("delivery_form", f"""
WITH {wide_sql('w', _FORM)}, {IDS}, {PROVIDER}, {_PAC},
{wide_sql('g', [ob.answer_list('ord', CODES['diagnosis_order']), ob.answer_list('cer', CODES['diagnosis_certainty'])], 'obs_group_id', 'robs', "AND obs_group_id IS NOT NULL")},
ld AS (SELECT r.encounter_id, label, ord, cer FROM (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY obs_group_id NULLS FIRST, date_created NULLS FIRST, obs_id) AS rn FROM robs WHERE NOT voided AND concept_id = {CODES['diagnosis']}) r
  LEFT JOIN g ON r.obs_group_id = g.obs_group_id LEFT JOIN label_en l ON r.value_coded = l.concept_id WHERE rn = 1)
SELECT emr_id, provider, lo.name AS location, {day('e.encounter_datetime')} AS form_date, CAST(NULL AS VARCHAR) AS estimated_delivery_date, CAST(NULL AS DOUBLE) AS estimated_blood_loss, {shown(_FORM)},
  ld.label AS presumed_or_confirmed_diagnosis, CASE WHEN ld.encounter_id IS NOT NULL THEN ord IS NOT NULL END AS primary_diagnosis, CASE WHEN ld.encounter_id IS NOT NULL THEN cer IS NOT NULL END AS confirmed_diagnoses, pac_type, w.exit_date AS maternal_outcome_date
FROM encounter e LEFT JOIN w ON e.encounter_id = w.encounter_id LEFT JOIN ids ON e.patient_id = ids.patient_id LEFT JOIN pv ON e.encounter_id = pv.encounter_id LEFT JOIN pac ON e.encounter_id = pac.encounter_id
LEFT JOIN ld ON e.encounter_id = ld.encounter_id LEFT JOIN location lo ON e.location_id = lo.location_id WHERE e.encounter_type IN ('1-URGENT', '2-HIGH') AND NOT e.voided
""")
def _(t):
    return maternity.delivery_form(clinic(t))


_REGISTER = maternity.delivery_register_wants(CODES)
_RANKED = "row_number() OVER (PARTITION BY encounter_id ORDER BY obs_group_id NULLS FIRST, date_created NULLS FIRST, obs_id) AS n"


@query("delivery_register", f"""
WITH {wide_sql('w', _REGISTER)}, {IDS}, {PROVIDER}, {_PAC},
a AS (SELECT encounter_id, {', '.join(f'max(CASE WHEN n = {i} THEN label END) AS d{i}' for i in range(1, 7))} FROM (SELECT o.*, label, {_RANKED} FROM robs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id = {CODES['coded_diagnosis']}) GROUP BY encounter_id),
b AS (SELECT encounter_id, max(CASE WHEN n = 1 THEN value_text END) AS o1, max(CASE WHEN n = 2 THEN value_text END) AS o2 FROM (SELECT *, {_RANKED} FROM robs WHERE NOT voided AND concept_id = {CODES['noncoded_diagnosis']}) GROUP BY encounter_id)
SELECT emr_id, provider, lo.name AS location, pac_type, {shown(_REGISTER)}, d1 AS initial_diagnosis_1, d2 AS initial_diagnosis_2, d3 AS initial_diagnosis_3, o1 AS initial_diagnosis_other,
  d4 AS final_diagnosis_1, d5 AS final_diagnosis_2, d6 AS final_diagnosis_3, o2 AS final_diagnosis_other, '2002-01-01' AS maternal_outcome_date
FROM encounter e JOIN pac ON e.encounter_id = pac.encounter_id LEFT JOIN w ON e.encounter_id = w.encounter_id LEFT JOIN a ON e.encounter_id = a.encounter_id LEFT JOIN b ON e.encounter_id = b.encounter_id
LEFT JOIN ids ON e.patient_id = ids.patient_id LEFT JOIN pv ON e.encounter_id = pv.encounter_id LEFT JOIN location lo ON e.location_id = lo.location_id
WHERE e.encounter_type = '4-NOT SPECIFIED' AND NOT e.voided AND CAST(e.encounter_datetime AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2000-12-31'
""")
def _(t):
    return maternity.delivery_register(clinic(t), "1995-01-01", "2000-12-31")


# ---- wards

WARD_CODES = Roles(
    delivery_datetime=301, delivery_type=302, birth_outcome=303, c_section=311, vacuum=312, vaginal=313, disposition=203,
    last_menstrual_period=202, gestational_age=201,
)
PLACES = {
    "census": [0, 1, 2, 3, 4, 5, 6, 7, 9, 10, 11], "census_rows": [0, 1, 3, 5, 6, 7, 9, 10, 11], "theatre": [4, 8], "newborn": 2,
    "activity": list(range(11)), "deaths": list(range(12)),
}


def ward_clinic(t) -> Clinic:
    tables = {
        "obs": t.eobs, "encounter": t.adt, "visit": t.adt_visit, "person": t.person, "person_name": t.person_name,
        "patient_identifier": t.patient_identifier, "location": t.location, "provider": t.provider, "bed": t.bed,
        "bed_location_map": t.bed_location_map, "bed_patient_assignment_map": t.bed_patient_assignment_map,
        "visit_attribute": t.visit_attribute, "patient_program": t.patient_program, "patient_state": t.patient_state,
        "program_workflow_state": t.program_workflow_state, "concept_name": t.birth_name,
        "encounter_provider": t.ev.select(
            F.col("event_id").alias("encounter_id"), (F.col("k") % 10).cast("int").alias("provider_id"), (F.col("value") < 20).alias("voided")
        ),
    }
    return Clinic(
        tables, moment(NOW), WARD_CODES,
        {"admission": ["admission"], "transfer": ["transfer"], "discharge": ["discharge"], "newborn_discharge": ["discharge"], "delivery": ["delivery"]},
        {"emr_id": 1}, PLACES, {"pregnancy": 1}, {"born_during_visit": 1},
    )


_WARD_LIST = f"""
{IDS}, {NAMES}, pv AS (SELECT event_id AS encounter_id, name AS provider FROM ev JOIN provider ON CAST(k % 10 AS INT) = provider_id WHERE NOT value < 20),
dl AS (SELECT a.*, strftime(encounter_datetime, '%b %-d, %Y ') || lower(strftime(encounter_datetime, '%-I:%M%p')) AS discharged FROM adt a
  WHERE encounter_type = 'discharge' AND NOT voided AND CAST(encounter_datetime AS DATE) = DATE '2024-01-15' AND location_id = {{place}})
"""


@query("discharge_list", f"""
WITH {_WARD_LIST.format(place=3)}, vo AS (SELECT visit_id, label, row_number() OVER (PARTITION BY visit_id ORDER BY obs_datetime DESC, obs_id DESC) AS r FROM eobs o JOIN adt a ON o.encounter_id = a.encounter_id
  LEFT JOIN birth_label l ON o.value_coded = l.concept_id WHERE NOT o.voided AND o.concept_id = 203)
SELECT emr_id, called AS name, discharged, label AS disposition, provider AS discharge_provider FROM dl LEFT JOIN ids ON dl.patient_id = ids.patient_id LEFT JOIN nm ON dl.patient_id = nm.person_id
LEFT JOIN pv ON dl.encounter_id = pv.encounter_id LEFT JOIN vo ON dl.visit_id = vo.visit_id AND r = 1
""")
def _(t):
    return maternity.discharge_list(ward_clinic(t), "2024-01-15", 3)


@query("newborn_discharge_list", f"""
WITH {_WARD_LIST.format(place=2)}, {wide_sql('w', [ob.answer_list('disposition', 203)], 'encounter_id', 'eobs', label='birth_label')}
SELECT emr_id, called AS name, discharged, disposition, provider AS discharge_provider, CASE WHEN EXISTS (SELECT 1 FROM visit_attribute v WHERE v.visit_id = dl.visit_id AND v.attribute_type_id = 1 AND v.value_reference = 'true' AND NOT v.voided) THEN 'inborn' ELSE 'outborn' END AS inborn_outborn
FROM dl LEFT JOIN ids ON dl.patient_id = ids.patient_id LEFT JOIN nm ON dl.patient_id = nm.person_id LEFT JOIN pv ON dl.encounter_id = pv.encounter_id LEFT JOIN w ON dl.encounter_id = w.encounter_id
""")
def _(t):
    return maternity.newborn_discharge_list(ward_clinic(t), "2024-01-15")


_LABEL = """CASE WHEN {l}.location_id IN (4, 8) THEN 'PACU/Pre-Op' WHEN {l}.location_id = 2 AND {b} ILIKE '%inborn%' THEN 'NICU Inborn' WHEN {l}.location_id = 2 AND {b} ILIKE '%outborn%' THEN 'NICU Outborn'
  WHEN {l}.location_id = 2 AND {b} IS NOT NULL THEN 'NICU Other' WHEN {l}.location_id = 2 THEN 'NICU Unassigned' ELSE {l}.name END"""
_YEARS_NOW = years_sql("p.birthdate", f"TIMESTAMP '{NOW}'")
_CENSUS = f"""
pr AS (SELECT DISTINCT e.location_id, e.patient_id FROM adt e JOIN adt_visit v ON e.visit_id = v.visit_id AND v.date_stopped IS NULL WHERE NOT e.voided AND e.encounter_type IN ('admission', 'transfer')
  AND e.location_id IN ({_values(PLACES['census'])}) AND NOT EXISTS (SELECT 1 FROM adt x WHERE NOT x.voided AND x.patient_id = e.patient_id AND x.encounter_datetime > e.encounter_datetime
  AND (x.encounter_type = 'discharge' OR (x.encounter_type IN ('admission', 'transfer') AND x.location_id <> e.location_id)))),
kept AS (SELECT pr.* FROM pr JOIN person p ON pr.patient_id = p.person_id WHERE p.birthdate IS NOT NULL AND CASE WHEN location_id = 2 THEN {_YEARS_NOW} <= 0 ELSE {_YEARS_NOW} >= 10 END),
held AS (SELECT patient_id, arg_min(bed_number, b.bed_id) AS bed_number FROM bed_patient_assignment_map m JOIN bed b ON m.bed_id = b.bed_id WHERE m.date_stopped IS NULL GROUP BY patient_id),
cn AS (SELECT {_LABEL.format(l='l', b='h.bed_number')} AS ward, count(*) AS census FROM kept k JOIN location l ON k.location_id = l.location_id LEFT JOIN held h ON k.patient_id = h.patient_id GROUP BY 1),
fb AS (SELECT {_LABEL.format(l='l', b='b.bed_number')} AS ward, count(*) AS free_beds FROM bed_location_map m JOIN bed b ON m.bed_id = b.bed_id AND NOT b.voided JOIN location l ON m.location_id = l.location_id
  WHERE NOT EXISTS (SELECT 1 FROM bed_patient_assignment_map a WHERE a.bed_id = m.bed_id AND NOT a.voided AND a.date_stopped IS NULL) GROUP BY 1),
sc AS (SELECT name AS ward FROM location WHERE location_id IN ({_values(PLACES['census_rows'])}) UNION ALL SELECT unnest(['PACU/Pre-Op', 'NICU Inborn', 'NICU Outborn', 'NICU Other', 'NICU Unassigned'])),
census AS (SELECT sc.ward, coalesce(census, 0) AS current_census, coalesce(free_beds, 0) AS free_beds FROM sc LEFT JOIN cn ON sc.ward = cn.ward LEFT JOIN fb ON sc.ward = fb.ward
  WHERE NOT (coalesce(census, 0) = 0 AND coalesce(free_beds, 0) = 0 AND sc.ward IN ('NICU Other', 'NICU Unassigned')))
"""


@query("ward_census", f"WITH {_CENSUS} SELECT ward, current_census, free_beds FROM census")
def _(t):
    return wards.ward_census(ward_clinic(t))


def activity_sql(start: str, end: str, quirk: bool) -> str:
    enter = "encounter_type IN ('admission', 'transfer')"
    if quirk:
        previous = """
tr AS (SELECT h.*, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS r FROM hist h),
pl AS (SELECT h.*, CASE WHEN h.encounter_id = a.encounter_id THEN b.location_id ELSE a.location_id END AS prev FROM hist h JOIN tr a ON h.patient_id = a.patient_id AND a.r = 1 LEFT JOIN tr b ON h.patient_id = b.patient_id AND b.r = 2)"""
    else:
        previous = "pl AS (SELECT h.*, lag(location_id) OVER (PARTITION BY patient_id, visit_id ORDER BY encounter_datetime, encounter_id) AS prev FROM hist h)"
    span = f"encounter_datetime >= TIMESTAMP '{start}' AND encounter_datetime <= TIMESTAMP '{end}'"
    return f"""
mv AS (SELECT * FROM adt WHERE NOT voided AND location_id IN ({_values(PLACES['activity'])})),
nw AS (SELECT * FROM mv WHERE encounter_type IN ('admission', 'transfer', 'discharge') AND {span}),
hist AS (SELECT * FROM mv WHERE {enter} AND (patient_id, visit_id) IN (SELECT (patient_id, visit_id) FROM nw WHERE encounter_type = 'transfer')),
{previous},
al AS (SELECT location_id, encounter_type FROM nw UNION ALL SELECT prev, 'out' FROM pl WHERE encounter_type = 'transfer' AND {span} AND prev IS NOT NULL),
ct AS (SELECT location_id, count(*) FILTER (WHERE encounter_type = 'admission') AS admissions, count(*) FILTER (WHERE encounter_type = 'transfer') AS transfers_in,
  count(*) FILTER (WHERE encounter_type = 'out') AS transfers_out, count(*) FILTER (WHERE encounter_type = 'discharge') AS discharges FROM al GROUP BY location_id),
activity AS (SELECT l.name AS ward, coalesce(admissions, 0) AS admissions, coalesce(transfers_in, 0) AS transfers_in, coalesce(transfers_out, 0) AS transfers_out, coalesce(discharges, 0) AS discharges
  FROM location l LEFT JOIN ct ON l.location_id = ct.location_id WHERE l.location_id IN ({_values(PLACES['activity'])}))
"""


_EVENING = ("2024-01-21 08:00:00", "2024-01-21 20:00:00")
_MORNING = ("2024-01-20 08:00:00", "2024-01-21 08:00:00")


@query("ward_activity", f"WITH {activity_sql(*_MORNING, False)} SELECT * FROM activity")
def _(t):
    return wards.ward_activity(ward_clinic(t), shift_window("2024-01-21", "morning", True))


@query("ward_activity_latest_other", f"WITH {activity_sql(*_MORNING, True)} SELECT * FROM activity")
def _(t):
    return wards.ward_activity(ward_clinic(t), shift_window("2024-01-21", "morning", True), quirk=True)


def deliveries_sql(start: str, end: str) -> str:
    return f"""
bg AS (SELECT DISTINCT obs_group_id FROM eobs o JOIN adt a ON o.encounter_id = a.encounter_id AND NOT a.voided AND a.encounter_type = 'delivery'
  WHERE NOT o.voided AND concept_id = 301 AND value_datetime >= TIMESTAMP '{start}' AND value_datetime <= TIMESTAMP '{end}'),
bb AS (SELECT obs_group_id, coalesce(max(CASE WHEN o.concept_id = 303 THEN label END), 'No Outcome') AS outcome, max(CASE WHEN o.concept_id = 302 THEN value_coded END) AS kind
  FROM eobs o LEFT JOIN birth_label l ON o.value_coded = l.concept_id WHERE NOT voided AND o.concept_id IN (302, 303) AND obs_group_id IN (SELECT obs_group_id FROM bg) GROUP BY obs_group_id),
cb AS (SELECT outcome, count(*) FILTER (WHERE kind = 311) AS c_section, count(*) FILTER (WHERE kind = 312) AS vacuum, count(*) FILTER (WHERE kind = 313) AS vaginal, count(*) FILTER (WHERE kind IS NULL) AS missing_delivery_type
  FROM bb WHERE outcome IN ('Livebirth', 'Fresh Stillbirth', 'Macerated Stillbirth', 'No Outcome') GROUP BY outcome),
tt AS (SELECT * FROM cb UNION ALL SELECT 'Total', CAST(sum(c_section) AS BIGINT), CAST(sum(vacuum) AS BIGINT), CAST(sum(vaginal) AS BIGINT), CAST(sum(missing_delivery_type) AS BIGINT) FROM cb),
ds AS (SELECT s.outcome, coalesce(c_section, 0) AS c_section, coalesce(vacuum, 0) AS vacuum, coalesce(vaginal, 0) AS vaginal, coalesce(missing_delivery_type, 0) AS missing_delivery_type
  FROM (SELECT unnest(['Livebirth', 'Fresh Stillbirth', 'Macerated Stillbirth', 'No Outcome', 'Total']) AS outcome) s LEFT JOIN tt ON s.outcome = tt.outcome),
deliveries AS (SELECT *, c_section + vacuum + vaginal + missing_delivery_type AS total FROM ds WHERE NOT (outcome = 'No Outcome' AND c_section + vacuum + vaginal + missing_delivery_type = 0))
"""


@query("delivery_summary", f"WITH {deliveries_sql(*_MORNING)} SELECT * FROM deliveries")
def _(t):
    return wards.delivery_summary(ward_clinic(t), shift_window("2024-01-21", "morning", True))


_NOW = f"TIMESTAMP '{NOW}'"


def deaths_sql(start: str, end: str) -> str:
    def latest(concept: int, field: str, name: str) -> str:
        return (
            f"{name} AS (SELECT person_id, {field} AS v, obs_datetime AS at_time FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY obs_datetime DESC, obs_id DESC) AS r "
            f"FROM eobs WHERE NOT voided AND concept_id = {concept}) WHERE r = 1)"
        )

    def valid(name: str, what: str = "v") -> str:
        return f"CASE WHEN CAST({name}.at_time AS DATE) >= CAST(pe.date_enrolled AS DATE) THEN {name}.{what} END"

    return f"""
{IDS}, {NAMES}, {latest(202, 'value_datetime', 'lm')}, {latest(301, 'value_datetime', 'bi')}, {latest(201, 'value_numeric', 'wk')},
lv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date_started DESC, visit_id DESC) AS r FROM adt_visit) WHERE r = 1),
pe AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, date_completed ORDER BY date_enrolled DESC, patient_program_id DESC) AS r FROM patient_program WHERE program_id = 1) WHERE r = 1),
se AS (SELECT patient_program_id, CAST(end_date AS DATE) AS d, label, row_number() OVER (PARTITION BY patient_program_id, CAST(end_date AS DATE) ORDER BY start_date DESC, patient_state_id DESC) AS r
  FROM patient_state s JOIN program_workflow_state w ON s.state = w.program_workflow_state_id LEFT JOIN birth_label l ON w.concept_id = l.concept_id),
deaths AS (SELECT emr_id, called AS patient_name, {years_sql('p.birthdate', 'p.death_date')} AS age_at_death, strftime(p.death_date, '%b %-d, %Y ') || lower(strftime(p.death_date, '%-I:%M%p')) AS time_of_death,
  bl.label AS cause_of_death, se.label AS pregnancy_status,
  CASE WHEN {valid('lm')} IS NOT NULL THEN CAST({weeks_sql("date_trunc('day', " + valid('lm') + ")", f"coalesce({valid('bi')}, {_NOW})")} AS DOUBLE)
    ELSE {valid('wk')} + {weeks_sql(valid('wk', 'at_time'), f"coalesce({valid('bi')}, {_NOW})")} END AS gestational_age
FROM person p JOIN lv ON lv.patient_id = p.person_id AND EXISTS (SELECT 1 FROM adt a WHERE a.visit_id = lv.visit_id AND a.location_id IN ({_values(PLACES['deaths'])}))
LEFT JOIN ids ON ids.patient_id = p.person_id LEFT JOIN nm ON nm.person_id = p.person_id LEFT JOIN birth_label bl ON bl.concept_id = p.cause_of_death
LEFT JOIN pe ON pe.patient_id = p.person_id AND pe.date_completed = p.death_date LEFT JOIN se ON se.patient_program_id = pe.patient_program_id AND se.d = CAST(p.death_date AS DATE) AND se.r = 1
LEFT JOIN lm ON lm.person_id = p.person_id LEFT JOIN bi ON bi.person_id = p.person_id LEFT JOIN wk ON wk.person_id = p.person_id
WHERE p.death_date >= TIMESTAMP '{start}' AND p.death_date < TIMESTAMP '{end}')
"""


@query("death_list", f"WITH {deaths_sql(*_MORNING)} SELECT * FROM deaths")
def _(t):
    return wards.death_list(ward_clinic(t), shift_window("2024-01-21", "morning"))


_BUNDLE = {
    "Current_Census": ("ward", ["current_census", "free_beds"]), "Deliveries": ("outcome", ["c_section", "vacuum", "vaginal", "missing_delivery_type", "total"]),
    "Ward_Activity": ("ward", ["admissions", "transfers_in", "transfers_out", "discharges"]),
}


def bundle_sql(span) -> str:
    parts = [f"WITH {_CENSUS}, {activity_sql(*span, False)}, {deliveries_sql(*span)}, {deaths_sql(*span)}"]
    tables = {"Current_Census": "census", "Deliveries": "deliveries", "Ward_Activity": "activity"}
    rows = [
        f"SELECT '{name}' AS data_set, {label} AS line, '{m}' AS measure, CAST({m} AS BIGINT) AS n FROM {tables[name]}"
        for name, (label, measures) in _BUNDLE.items() for m in measures
    ]
    rows.append("SELECT 'Deaths', emr_id, 'age_at_death', CAST(age_at_death AS BIGINT) FROM deaths")
    return parts[0] + " UNION ALL ".join(rows)


def bundle(t, shift: str):
    """All data sets of a handoff as one long table."""
    sets = wards.shift_handoff(ward_clinic(t), "2024-01-21", shift)
    out = None
    for name, (label, measures) in _BUNDLE.items():
        part = sets[name].unpivot([label], measures, "measure", "n").select(
            F.lit(name).alias("data_set"), F.col(label).alias("line"), "measure", F.col("n").cast("long").alias("n")
        )
        out = part if out is None else out.unionByName(part)
    deaths = sets["Deaths"].select(
        F.lit("Deaths").alias("data_set"), F.col("emr_id").alias("line"), F.lit("age_at_death").alias("measure"),
        F.col("age_at_death").cast("long").alias("n"),
    )
    return out.unionByName(deaths)


@query("shift_handoff", bundle_sql(_MORNING))
def _(t):
    return bundle(t, "morning")


@query("report_bundle", bundle_sql(_EVENING))
def _(t):
    return bundle(t, "evening")


# ---- mental health

_MH = programs.mental_health_wants(CODES)
_MH_DRUGS = {f"drug_{i}_tab": i for i in range(27)}
_MH_ATTRS = programs.drug_wants(CODES)


@query("mental_health_encounters", f"""
WITH {wide_sql('w', _MH)}, {IDS}, {REGISTRATION}, {ADDRESS}, {PROVIDER}, {wide_sql('ga', _MH_ATTRS, 'encounter_id, obs_group_id', 'robs', 'AND obs_group_id IS NOT NULL')},
gd AS (SELECT encounter_id, value_drug, min(obs_group_id) AS obs_group_id FROM robs WHERE NOT voided AND obs_group_id IS NOT NULL AND value_drug BETWEEN 0 AND 26 GROUP BY 1, 2),
mx AS (SELECT gd.encounter_id, {', '.join(f'max(CASE WHEN value_drug = {i} THEN {a.column} END) AS {n}_{a.column}' for n, i in _MH_DRUGS.items() for a in _MH_ATTRS)}
  FROM gd LEFT JOIN ga ON gd.encounter_id = ga.encounter_id AND gd.obs_group_id = ga.obs_group_id GROUP BY gd.encounter_id),
dg AS (SELECT encounter_id, {', '.join(f'max(CASE WHEN n = {i} THEN label END) AS diagnosis_{i}' for i in range(1, 5))} FROM (SELECT encounter_id, label, row_number() OVER (PARTITION BY encounter_id ORDER BY obs_id) AS n FROM robs o
  LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id = {CODES['mental_health_diagnosis']} AND value_coded IN (SELECT concept_id FROM concept_set WHERE concept_set = 'BIG')) GROUP BY encounter_id)
SELECT e.patient_id, emr_id, loc_registered AS location_registered, {_AGE_ENC} AS age_at_encounter, formatted AS address, e.encounter_id, y.name AS encounter_type, e.visit_id, e.encounter_datetime, pv.provider,
  {shown(_MH)}, w.cgi_s AS cgi_i, diagnosis_1, diagnosis_2, diagnosis_3, diagnosis_4, {', '.join(f'{n}_{a.column}' for n in _MH_DRUGS for a in _MH_ATTRS)}
FROM encounter e LEFT JOIN w ON e.encounter_id = w.encounter_id LEFT JOIN dg ON e.encounter_id = dg.encounter_id LEFT JOIN mx ON e.encounter_id = mx.encounter_id LEFT JOIN ids ON e.patient_id = ids.patient_id
LEFT JOIN rg ON e.patient_id = rg.patient_id LEFT JOIN person p ON e.patient_id = p.person_id LEFT JOIN ad ON e.patient_id = ad.person_id LEFT JOIN encounter_type y ON e.encounter_type = y.encounter_type_id
LEFT JOIN pv ON e.encounter_id = pv.encounter_id WHERE e.encounter_type IN ('2-HIGH', '3-MEDIUM') AND CAST(e.encounter_datetime AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
""")
def _(t):
    return programs.mental_health_encounters(clinic(t), _MH_DRUGS, "BIG", "1995-01-01", "2001-12-31")


MH_CODES = Roles(mental_health_diagnosis=203, seizures=201, medication=302, return_visit_date=202)


def enrolment_clinic(t) -> Clinic:
    base = clinic(t)
    tables = {**base.tables, "obs": t.eobs, "encounter": t.adt}
    return Clinic(
        tables, moment("2024-03-01 00:00:00"), MH_CODES, {"mental_health_consult": ["delivery", "vitals"]}, IDENTIFIERS,
        programs={"mental_health": 1}, attributes={"test": "test"},
    )


def _since(limit: float, under: str, over: str) -> str:
    return f"CASE WHEN planned THEN CASE WHEN date_diff('day', CAST(last_visit AS DATE), DATE '2024-03-01') <= {limit} THEN '{under}' ELSE '{over}' END END"


@query("mental_health_enrolments", f"""
WITH {IDS}, {ADDRESS},
b AS (SELECT * FROM patient_program WHERE NOT voided AND program_id = 1 AND patient_id NOT IN (SELECT person_id FROM person_attribute WHERE attribute_type = 'test' AND value = 'true' AND NOT voided)),
i AS (SELECT b.patient_program_id, e.encounter_id, e.encounter_datetime FROM b JOIN adt e ON e.patient_id = b.patient_id AND NOT e.voided AND e.encounter_type IN ('delivery', 'vitals')
  AND CAST(e.encounter_datetime AS DATE) >= CAST(b.date_enrolled AS DATE) AND (b.date_completed IS NULL OR CAST(e.encounter_datetime AS DATE) <= CAST(b.date_completed AS DATE))),
f AS (SELECT i.*, o.obs_id, o.concept_id, o.value_numeric, o.value_datetime, label, row_number() OVER (PARTITION BY patient_program_id, o.concept_id ORDER BY encounter_datetime DESC, i.encounter_id DESC, obs_id DESC) AS d,
  row_number() OVER (PARTITION BY patient_program_id, o.concept_id ORDER BY encounter_datetime, i.encounter_id, obs_id) AS a FROM i JOIN eobs o ON i.encounter_id = o.encounter_id AND NOT o.voided AND o.concept_id IN (201, 202, 203, 302)
  LEFT JOIN label_en l ON o.value_coded = l.concept_id),
m AS (SELECT patient_program_id, max(CASE WHEN concept_id = 203 AND d = 1 THEN label END) AS latest_diagnosis, max(CASE WHEN concept_id = 201 AND d = 1 THEN value_numeric END) AS n1, max(CASE WHEN concept_id = 201 AND d = 1 THEN encounter_datetime END) AS t1,
  max(CASE WHEN concept_id = 201 AND d = 2 THEN value_numeric END) AS n2, max(CASE WHEN concept_id = 201 AND d = 2 THEN encounter_datetime END) AS t2, max(CASE WHEN concept_id = 201 AND a = 1 THEN value_numeric END) AS n3,
  max(CASE WHEN concept_id = 201 AND a = 1 THEN encounter_datetime END) AS t3, max(CASE WHEN concept_id = 202 AND d = 1 THEN value_datetime END) AS nx, bool_or(concept_id = 202) AS planned FROM f GROUP BY patient_program_id),
md AS (SELECT patient_program_id, encounter_id, encounter_datetime, string_agg(DISTINCT label, ',' ORDER BY label) AS meds FROM f WHERE concept_id = 302 GROUP BY 1, 2, 3),
ml AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_program_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS r FROM md) WHERE r = 1),
lv AS (SELECT patient_program_id, max(encounter_datetime) AS last_visit FROM i GROUP BY patient_program_id),
rw AS (SELECT person_b, ' ' || string_agg(DISTINCT concat_ws(' ', given_name, family_name), ', ' ORDER BY concat_ws(' ', given_name, family_name)) AS chw FROM relationship r JOIN person_name n ON r.person_a = n.person_id AND NOT n.voided
  WHERE NOT r.voided AND relationship = 1 GROUP BY person_b)
SELECT b.patient_id, emr_id, p.gender, CAST(CAST({years_sql('pl.birthdate', "TIMESTAMP '2024-03-01 00:00:00'")} AS VARCHAR) || '.' || CAST({months_sql('pl.birthdate', "TIMESTAMP '2024-03-01 00:00:00'")} % 12 AS VARCHAR) AS DOUBLE) AS age, chw AS assigned_chw,
  state_province AS province, city_village, address3, address1, address2, w.name AS location_when_registered_in_program, {day('b.date_enrolled')} AS date_enrolled, {day('b.date_completed')} AS date_completed,
  CAST(date_diff('day', CAST(b.date_enrolled AS DATE), CAST(coalesce(b.date_completed, TIMESTAMP '2024-03-01 00:00:00') AS DATE)) AS INT) AS number_of_days_in_care, ol.label AS program_status_outcome, latest_diagnosis,
  n1 AS latest_seizure_number, {day('t1')} AS latest_seizure_date, n2 AS previous_seizure_number, {day('t2')} AS previous_seizure_date, n3 AS baseline_seizure_number, {day('t3')} AS baseline_seizure_date,
  meds AS latest_medication_given, {day('ml.encounter_datetime')} AS latest_medication_date, {day('last_visit')} AS last_visit_date, {day('nx')} AS next_scheduled_visit_date,
  {_since(14, 'Oui', 'No')} AS patient_came_within_14_days_appt, {_since(91.2501, 'No', 'Oui')} AS three_months_since_latest_return_date, {_since(182.5, 'No', 'Oui')} AS six_months_since_latest_return_date
FROM b LEFT JOIN m ON b.patient_program_id = m.patient_program_id LEFT JOIN ml ON b.patient_program_id = ml.patient_program_id LEFT JOIN lv ON b.patient_program_id = lv.patient_program_id LEFT JOIN person p ON b.patient_id = p.person_id
LEFT JOIN (SELECT * FROM person WHERE NOT voided) pl ON b.patient_id = pl.person_id LEFT JOIN rw ON b.patient_id = rw.person_b LEFT JOIN ids ON b.patient_id = ids.patient_id LEFT JOIN ad ON b.patient_id = ad.person_id
LEFT JOIN (SELECT * FROM location WHERE NOT retired) w ON b.location_id = w.location_id LEFT JOIN label_en ol ON b.outcome_concept_id = ol.concept_id
""")
def _(t):
    return programs.mental_health_enrolments(enrolment_clinic(t), 1, unit="day")


@query("mental_health_cases", f"""
WITH {IDS}
SELECT p.uuid AS patient_uuid, emr_id, {years_sql('p.birthdate', "TIMESTAMP '2024-03-01 00:00:00'")} AS age, p.gender, n.given_name AS first_name, n.family_name AS last_name, {day('g.date_enrolled')} AS date_enrolled
FROM patient_program g JOIN person p ON g.patient_id = p.person_id AND NOT p.voided JOIN person_name n ON g.patient_id = n.person_id AND NOT n.voided LEFT JOIN ids ON g.patient_id = ids.patient_id WHERE NOT g.voided AND g.program_id = 1
""")
def _(t):
    return programs.mental_health_cases(enrolment_clinic(t))


# ---- chronic disease

_CHRONIC = programs.chronic_wants(CODES)
_SECTIONS = {
    "diabetes_section_populated": {"questions": [1, 2]}, "heart_failure_section_populated": {"questions": [3], "answers": [4, 5, 6]},
    "hypertension_section_populated": {"questions": [4]}, "kidney_section_populated": {"questions": [5]},
    "liver_section_populated": {"questions": [6], "answers": [7, 8]}, "lung_section_populated": {"questions": [7], "answers": [9]},
    "palliative_care_section_populated": {"questions": [1], "answers": [10]}, "sickle_cell_section_populated": {"questions": [2], "answers": [11, 12]},
}
_CONTROLS = [
    ob.answer_list("control", CODES["control"]), ob.answer_list("activity", CODES["activity_limitation"]),
    ob.answer_label("activity_yes", CODES["activity_limitation"], 1), ob.answer_list("use", CODES["medication_use"]),
]
_ECHO = [ob.when("date", CODES["procedure_date"]), ob.answer_list("options", CODES["echocardiogram"]), ob.text("comment", CODES["procedure_comment"])]


def section_sql() -> str:
    parts = []
    for name, rule in _SECTIONS.items():
        test = f"concept_id IN ({_values(rule['questions'])})"
        if rule.get("answers"):
            test += f" OR value_coded IN ({_values(rule['answers'])})"
        parts.append(f"bool_or(CASE WHEN {test} THEN TRUE END) AS {name}")
    return ", ".join(parts)


def lead_sql(name: str, leads: dict, wants, obs: str = "robs") -> str:
    groups = wide_sql(f"{name}_g", wants, "encounter_id, obs_group_id", obs, "AND obs_group_id IS NOT NULL")
    parts = []
    for lead, (q, a) in leads.items():
        for w in wants:
            parts.append(f"max(CASE WHEN q = {q} AND a = {a} THEN {w.column} END) AS {lead}_{w.column}")
    return (
        f"{groups}, {name}_f AS (SELECT encounter_id, concept_id AS q, value_coded AS a, min(obs_group_id) AS obs_group_id FROM {obs} WHERE NOT voided AND obs_group_id IS NOT NULL GROUP BY 1, 2, 3), "
        f"{name} AS (SELECT f.encounter_id, {', '.join(parts)} FROM {name}_f f JOIN {name}_g g ON f.encounter_id = g.encounter_id AND f.obs_group_id = g.obs_group_id GROUP BY f.encounter_id)"
    )


def first_sql(name: str, out: str, preference) -> str:
    order = " ".join(f"WHEN {c} THEN {i}" for i, c in enumerate(preference))
    return (
        f"{name} AS (SELECT encounter_id, label AS {out} FROM (SELECT encounter_id, label, row_number() OVER (PARTITION BY encounter_id ORDER BY CASE value_coded {order} END, obs_id) AS r FROM robs o "
        f"LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id = {CODES['diagnosis']} AND value_coded IN ({_values(preference)})) WHERE r = 1)"
    )


_DIABETES = [CODES[r] for r in ("type_1", "type_2", "gestational", "unspecified")]
_SICKLE = [CODES[r] for r in ("sickle_trait", "sickle_anemia", "beta_thalassemia", "hemoglobin_c", "other_hemoglobinopathy")]
_LEADS = {name: (CODES["chronic_history"], CODES[name]) for name in programs.CHRONIC_HISTORY}
_PLAIN = [w for w in _CHRONIC if w.column not in ("bmi", "hypertension_stage", "disposition", "next_appointment_date", "diabetes_complications")]
_ITEMS = ["(w.nighttime_waking_asthma, w._yes_nighttime_waking_asthma)", "(w.symptoms_2x_week_asthma, w._yes_symptoms_2x_week_asthma)",
          "(w.inhaler_for_symptoms_2x_week_asthma, w._yes_inhaler_for_symptoms_2x_week_asthma)", "(c.limitation_activity, c.limitation_activity_yes)"]


def _pair(item: str) -> tuple[str, str]:
    a, b = item.strip("()").split(", ")
    return a, b


_SCORE = " + ".join(f"CASE WHEN {a} = {b} THEN 1 ELSE 0 END" for a, b in map(_pair, _ITEMS))
_MISSING = " OR ".join(f"{a} IS NULL" for a, _ in map(_pair, _ITEMS))


@query("chronic_encounters", f"""
WITH {wide_sql('w', _CHRONIC)}, {child_sql('c', {'diabetes': 101, 'hypertension': 102, 'ckd': 103, 'liver': 101, 'limitation': 102, 'ace': 103}, _CONTROLS)},
{lead_sql('os', _LEADS, [ob.when('onset_date', CODES['onset_date'])])}, {lead_sql('ec', {'echo': (CODES['procedure'], CODES['echocardiogram'])}, _ECHO)},
rk AS (SELECT encounter_id, string_agg(DISTINCT label, '|' ORDER BY label) AS risk_factors FROM robs o JOIN label_en l ON o.concept_id = l.concept_id WHERE NOT voided AND obs_group_id IS NULL AND value_coded = 1 AND o.concept_id IN (1, 2, 5, 7) GROUP BY encounter_id),
sp AS (SELECT encounter_id, {section_sql()} FROM robs WHERE NOT voided GROUP BY encounter_id), {first_sql('db', 'diabetes_type', _DIABETES)}, {first_sql('sk', 'sickle_cell_type', _SICKLE)},
lo AS (SELECT encounter_id, bool_or(o.concept_id = {CODES['hba1c']}) AS lab_order_hba1c, string_agg(DISTINCT CASE WHEN order_type_id = 1 THEN label END, '|' ORDER BY CASE WHEN order_type_id = 1 THEN label END) AS lab_tests_ordered
  FROM orders_placed o LEFT JOIN label_en l ON o.concept_id = l.concept_id WHERE NOT voided GROUP BY encounter_id),
an AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime, encounter_id) AS index_asc, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS index_desc
  FROM encounter WHERE NOT voided AND encounter_type IN ('1-URGENT', '3-MEDIUM', '5-LOW')),
en AS (SELECT e.encounter_id, max((g.date_enrolled, g.patient_program_id)) AS best FROM an e JOIN patient_program g ON g.patient_id = e.patient_id AND NOT g.voided AND g.program_id = 1
  AND CAST(e.encounter_datetime AS DATE) >= CAST(g.date_enrolled AS DATE) AND (g.date_completed IS NULL OR CAST(e.encounter_datetime AS DATE) <= CAST(g.date_completed AS DATE)) GROUP BY e.encounter_id), {IDS}, {PROVIDER}
SELECT '7-' || CAST(e.patient_id AS VARCHAR) AS patient_id, emr_id, '7-' || CAST(e.encounter_id AS VARCHAR) AS encounter_id, e.encounter_datetime, e.date_created AS datetime_entered, '7-' || CAST(e.visit_id AS VARCHAR) AS visit_id,
  '7-' || CAST(en.best[2] AS VARCHAR) AS ncd_program_id, provider, u.person_name AS user_entered, lc.name AS encounter_location, y.name AS encounter_type, {shown(_PLAIN)},
  CASE WHEN w.bmi = w._severely_obese THEN 'Severe obese' WHEN w.bmi = w._obese THEN 'Moderate obese' ELSE w.bmi END AS bmi,
  CASE WHEN w.hypertension_stage = w._stage_moderate THEN '2 (Moderate)' WHEN w.hypertension_stage = w._stage_mild THEN '1 (Mild)' WHEN w.hypertension_stage = w._stage_pre THEN 'Pre-HTN' ELSE w.hypertension_stage END AS hypertension_stage,
  CASE WHEN w.disposition = w._no_action THEN 'No action taken' WHEN w.disposition = w._labs_outstanding THEN 'Laboratory tests outstanding' ELSE w.disposition END AS disposition,
  {day('w.next_appointment_date')} AS next_appointment_date, replace(w.diabetes_complications, 'Cerebrovascular accident', 'Stroke') AS diabetes_complications, risk_factors,
  CASE WHEN w._fasting THEN 'FBG' WHEN w._random THEN 'RBG' END AS glucose_fingerstick, CASE WHEN w._obese_present THEN TRUE WHEN w._obese_absent THEN FALSE END AS obesity, {', '.join(n + '_onset_date' for n in programs.CHRONIC_HISTORY)},
  diabetes_type, diabetes_control, hypertension_control AS hypertension_controlled, ckd_control AS ckd_controlled, liver_control AS liver_disease_controlled, sickle_cell_type, echo_options || '| ' || echo_comment AS echocardiogram_findings,
  echo_date AS echocardiogram_date, ace_use AS on_ace_inhibitor, limitation_activity AS activity_limitation_asthma,
  CASE WHEN {_MISSING} THEN NULL WHEN {_SCORE} >= 3 THEN 'Uncontrolled' WHEN {_SCORE} >= 1 THEN 'Partly controlled' ELSE 'Well controlled' END AS asthma_control_gina, lab_order_hba1c, lab_tests_ordered, {', '.join(_SECTIONS)}, index_asc, index_desc
FROM an e LEFT JOIN w ON e.encounter_id = w.encounter_id LEFT JOIN c ON e.encounter_id = c.encounter_id LEFT JOIN os ON e.encounter_id = os.encounter_id LEFT JOIN ec ON e.encounter_id = ec.encounter_id LEFT JOIN rk ON e.encounter_id = rk.encounter_id
LEFT JOIN sp ON e.encounter_id = sp.encounter_id LEFT JOIN db ON e.encounter_id = db.encounter_id LEFT JOIN sk ON e.encounter_id = sk.encounter_id LEFT JOIN lo ON e.encounter_id = lo.encounter_id LEFT JOIN en ON e.encounter_id = en.encounter_id
LEFT JOIN ids ON e.patient_id = ids.patient_id LEFT JOIN users u ON e.creator = u.user_id LEFT JOIN location lc ON e.location_id = lc.location_id LEFT JOIN encounter_type y ON e.encounter_type = y.encounter_type_id LEFT JOIN pv ON e.encounter_id = pv.encounter_id
""")
def _(t):
    base = clinic(t)
    base.site = "7"
    return programs.chronic_encounters(base, _SECTIONS)


_LISTED = ("education_level", "referred_from", "sickle_cell_confirmatory_test", "hypertension_type", "nyha_classification", "lung_disease_type",
           "ckd_stage", "disposition", "hiv", "comorbidities")
_EVER = {name: (CODES["chronic_history"], CODES[name]) for name in programs.CHRONIC_HISTORY}
_EVER |= {name: (CODES["diagnosis"], CODES[name]) for name in ("rheumatic_heart_disease", "congenital_heart_disease")}
_HAD = {r: (CODES["diagnosis"], CODES[r]) for r, _ in (*programs.DIABETES_PRIORITY, *programs.SICKLE_PRIORITY)}


def _case(priority) -> str:
    return "CASE " + " ".join(f"WHEN had_{r} THEN '{text}'" for r, text in priority) + " END"


@query("chronic_patients", f"""
WITH an AS (SELECT * FROM encounter WHERE NOT voided AND encounter_type IN ('1-URGENT', '3-MEDIUM', '5-LOW')),
po AS (SELECT o.*, label FROM probs o LEFT JOIN label_en l ON o.value_coded = l.concept_id WHERE NOT o.voided AND o.encounter_id IN (SELECT encounter_id FROM an)),
pp AS (SELECT patient_id, max(encounter_datetime) AS last_visit, min(encounter_datetime) AS first_visit FROM an GROUP BY patient_id),
le AS (SELECT person_id, concept_id, encounter_id, max(obs_datetime) AS seen, string_agg(DISTINCT label, ' | ' ORDER BY label) AS lst FROM po WHERE value_coded IS NOT NULL GROUP BY 1, 2, 3),
ll AS (SELECT person_id, {', '.join(f"max(CASE WHEN concept_id = {CODES[n]} THEN lst END) AS {n}" for n in _LISTED)} FROM (SELECT *, row_number() OVER (PARTITION BY person_id, concept_id ORDER BY seen DESC, encounter_id DESC) AS r FROM le) WHERE r = 1 GROUP BY person_id),
fl AS (SELECT person_id, {', '.join(f'bool_or(concept_id = {q} AND value_coded = {a}) AS {n}' for n, (q, a) in _EVER.items())}, {', '.join(f'bool_or(concept_id = {q} AND value_coded = {a}) AS had_{n}' for n, (q, a) in _HAD.items())},
  arg_max(value_coded, (obs_datetime, obs_id)) FILTER (WHERE concept_id = {CODES['literacy_level']} AND value_coded IS NOT NULL) AS literacy,
  arg_max(value_datetime, (obs_datetime, obs_id)) FILTER (WHERE concept_id = {CODES['next_appointment_date']} AND value_datetime IS NOT NULL) AS appointment,
  arg_max(value_text, (obs_datetime, obs_id)) FILTER (WHERE concept_id = {CODES['noncoded_diagnosis']} AND value_text IS NOT NULL) AS other_ncd_type,
  bool_or(CASE WHEN concept_id = {CODES['missed_school']} THEN TRUE END) AS ever_missed_school, bool_or(CASE WHEN concept_id = {CODES['diagnosis']} AND value_coded = {CODES['cardiomyopathy']} THEN TRUE END) AS cardiomyopathy FROM po GROUP BY person_id),
{lead_sql('ec', {'echo': (CODES['procedure'], CODES['echocardiogram'])}, [ob.when('date', CODES['procedure_date'])])},
eo AS (SELECT patient_id, max(echo_date) AS echo_date FROM ec JOIN an ON ec.encounter_id = an.encounter_id GROUP BY patient_id),
lb AS (SELECT person_id, arg_max(value_numeric, (e.encounter_datetime, o.obs_datetime, o.obs_id)) AS v, max(e.encounter_datetime) AS d FROM probs o JOIN encounter e ON o.encounter_id = e.encounter_id
  WHERE NOT o.voided AND NOT e.voided AND e.encounter_type = '1-URGENT' AND o.concept_id = {CODES['hba1c']} AND value_numeric IS NOT NULL GROUP BY person_id),
pg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date_enrolled DESC, patient_program_id DESC) AS r FROM patient_program WHERE NOT voided AND program_id = 1) WHERE r = 1), {IDS}
SELECT CAST(pp.patient_id AS VARCHAR) AS patient_id, emr_id, ll.hiv, ll.education_level, CASE literacy WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS read_and_write,
  replace(replace(ll.referred_from, 'Hospitalized', 'Inpatient Ward'), 'Primary care clinic', 'OPD') AS referred_from, ll.comorbidities, {', '.join(f'coalesce({n}, FALSE) AS {n}' for n in _EVER)}, {_case(programs.DIABETES_PRIORITY)} AS diabetes_type, ll.hypertension_type,
  ll.nyha_classification, ll.lung_disease_type, ll.ckd_stage, {_case(programs.SICKLE_PRIORITY)} AS sickle_cell_type, ll.sickle_cell_confirmatory_test, {day('appointment')} AS next_appointment_date, p.death_date IS NOT NULL AS dead,
  {day('p.death_date')} AS date_of_death, {day('p.birthdate')} AS birthdate, pl.birthdate_estimated, {years_sql('p.birthdate', AT_2002)} AS current_age, p.gender, other_ncd_type, {day('last_visit')} AS most_recent_visit_date, {day('first_visit')} AS first_ncd_visit_date,
  ll.disposition, ever_missed_school, cardiomyopathy, lb.v AS most_recent_hba1c_value, {day('lb.d')} AS most_recent_hba1c_date, echo_date AS most_recent_echocardiogram_date, pg.date_enrolled, pg.date_completed AS outcome_date, ol.label AS outcome,
  CASE WHEN date_diff('day', CAST(last_visit AS DATE), DATE '2002-01-01') > 90 AND date_diff('day', CAST(appointment AS DATE), DATE '2002-01-01') > 180 AND pg.date_completed IS NULL THEN 'Lost to followup' ELSE ol.label END AS calculated_reporting_outcome
FROM pp LEFT JOIN ll ON pp.patient_id = ll.person_id LEFT JOIN fl ON pp.patient_id = fl.person_id LEFT JOIN eo ON pp.patient_id = eo.patient_id LEFT JOIN lb ON pp.patient_id = lb.person_id LEFT JOIN pg ON pp.patient_id = pg.patient_id
LEFT JOIN ids ON pp.patient_id = ids.patient_id LEFT JOIN person p ON pp.patient_id = p.person_id LEFT JOIN (SELECT * FROM person WHERE NOT voided) pl ON pp.patient_id = pl.person_id LEFT JOIN label_en ol ON pg.outcome_concept_id = ol.concept_id
""")
def _(t):
    return programs.chronic_patients(clinic(t, True))


@query("chronic_enrolments", f"""
WITH {IDS}, st AS (SELECT s.patient_program_id, l.label, row_number() OVER (PARTITION BY s.patient_program_id ORDER BY s.start_date DESC, s.patient_state_id DESC) AS r FROM patient_state s
  JOIN program_workflow_state w ON s.state = w.program_workflow_state_id AND w.program_workflow_id = 1 LEFT JOIN label_en l ON w.concept_id = l.concept_id WHERE NOT s.voided AND s.end_date IS NULL)
SELECT CAST(g.patient_program_id AS VARCHAR) AS ncd_program_id, CAST(g.patient_id AS VARCHAR) AS patient_id, emr_id, pr.name AS program_name, {day('date_enrolled')} AS date_enrolled, {day('date_completed')} AS date_completed,
  ol.label AS final_program_status, st.label AS clinical_status, username AS user_entered, CAST(NULL AS INT) AS index_asc, CAST(NULL AS INT) AS index_desc
FROM patient_program g LEFT JOIN st ON g.patient_program_id = st.patient_program_id AND r = 1 LEFT JOIN ids ON g.patient_id = ids.patient_id LEFT JOIN program pr ON g.program_id = pr.program_id
LEFT JOIN label_en ol ON g.outcome_concept_id = ol.concept_id LEFT JOIN users u ON g.creator = u.user_id WHERE NOT g.voided AND g.program_id = 1
""")
def _(t):
    return programs.chronic_enrolments(clinic(t), 1)


# ---- outpatient

_OUT_DRUGS = {f"drug_{i}": i for i in range(17)}
_OUT_CLASSES = {"act": ["drug_10", "drug_11", "drug_12", "drug_13"], "non_act": ["drug_14", "drug_15", "drug_16"], "ari_antb": [f"drug_{i}" for i in (0, 1, 2, 3, 4, 5, 6, 7, 9)]}
_OUT = outpatient.outpatient_visit_wants(CODES)
_OUT_RANKED = {"diag": ("", CODES["diagnosis"]), "certainty": ("_certainty", CODES["diagnosis_certainty"]), "order": ("_order", CODES["diagnosis_order"])}


@query("outpatient_dispensing", f"""
WITH an AS (SELECT * FROM encounter WHERE NOT voided AND encounter_type = '4-NOT SPECIFIED' AND CAST(encounter_datetime AS DATE) BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'
  AND patient_id NOT IN (SELECT person_id FROM person_attribute WHERE attribute_type = 'test' AND value = 'true')),
vo AS (SELECT o.*, e.visit_id FROM probs o JOIN encounter e ON o.encounter_id = e.encounter_id WHERE e.visit_id IN (SELECT visit_id FROM an)), {wide_sql('w', _OUT, 'visit_id', 'vo')},
rn AS (SELECT visit_id, o.concept_id, label, row_number() OVER (PARTITION BY visit_id, o.concept_id ORDER BY obs_id) AS n FROM vo o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided),
rd AS (SELECT visit_id, {', '.join(f'max(CASE WHEN concept_id = {c} AND n = {i} THEN label END) AS diag_{i}{s}' for s, c in _OUT_RANKED.values() for i in (1, 2, 3))} FROM rn GROUP BY visit_id),
{wide_sql('ga', [ob.number('q', CODES['quantity_dispensed'])], 'encounter_id, obs_group_id', 'probs', 'AND obs_group_id IS NOT NULL')},
gd AS (SELECT encounter_id, value_drug, min(obs_group_id) AS obs_group_id FROM probs WHERE NOT voided AND obs_group_id IS NOT NULL AND value_drug BETWEEN 0 AND 16 GROUP BY 1, 2),
mx AS (SELECT gd.encounter_id, {', '.join(f'max(CASE WHEN value_drug = {i} THEN q END) AS {n}' for n, i in _OUT_DRUGS.items())} FROM gd LEFT JOIN ga ON gd.encounter_id = ga.encounter_id AND gd.obs_group_id = ga.obs_group_id GROUP BY gd.encounter_id),
{wide_sql('jb', [ob.label('occupation', CODES['occupation'])], 'person_id', 'probs')}, {IDS}, {NAMES}, {ADDRESS}
SELECT e.patient_id, e.visit_id, emr_id AS patient_primary_id, e.encounter_id AS dispensing_encounter_id, e.encounter_datetime AS dispensed_encounter_date, called AS patient_name, {_AGE_ENC} AS age_at_encounter, gender, formatted AS patient_address, occupation,
  height, weight, z_score, muac_in_cm / 10 AS muac_in_cm, type_of_visit, fp_offered_and_accepted, malaria_rdt, {', '.join(f'diag_{i}{s}' for i in (1, 2, 3) for s, _ in _OUT_RANKED.values())}, {', '.join(_OUT_DRUGS)},
  {', '.join('CASE WHEN ' + ' OR '.join(f'{c} > 0' for c in columns) + f' THEN 1 ELSE 0 END AS {name}' for name, columns in _OUT_CLASSES.items())}
FROM an e LEFT JOIN w ON e.visit_id = w.visit_id LEFT JOIN rd ON e.visit_id = rd.visit_id LEFT JOIN mx ON e.encounter_id = mx.encounter_id LEFT JOIN jb ON e.patient_id = jb.person_id LEFT JOIN person p ON e.patient_id = p.person_id
LEFT JOIN nm ON e.patient_id = nm.person_id LEFT JOIN ids ON e.patient_id = ids.patient_id LEFT JOIN ad ON e.patient_id = ad.person_id
""")
def _(t):
    return outpatient.outpatient_dispensing(clinic(t, True), _OUT_DRUGS, _OUT_CLASSES, "1995-01-01", "2001-12-31")


_ND, _NM, _NT = outpatient.COHORT_DIAGNOSES, outpatient.COHORT_MEDICINES, outpatient.COHORT_TESTS


# Questions that stand in for the measures of the extract.
_VITALS = {
    "height": 1, "weight": 2, "temperature": 3, "heart_rate": 4, "respiratory_rate": 5, "bp_systolic": 6, "bp_diastolic": 7, "o2_saturation": 3,
    "muac_mm": 5,
}


@query("visit_cohort", f"""
WITH vs AS (SELECT 'E' || CAST(patient_id AS VARCHAR) AS emr_id, patient_id, visit_id, date_started AS visit_date_started, date_stopped AS visit_date_stopped FROM visit WHERE year(date_stopped) >= 1996 AND year(date_started) <= 2000),
live AS (SELECT o.*, label FROM pobs o LEFT JOIN label_en l ON o.value_coded = l.concept_id WHERE NOT voided),
dx AS (SELECT visit_id, {', '.join(f'max(CASE WHEN n = {i} THEN label END) AS diagnosis_{i}' for i in range(1, _ND + 1))} FROM (SELECT visit_id, label, row_number() OVER (PARTITION BY visit_id ORDER BY obs_id) AS n FROM live WHERE concept_id = 3) GROUP BY visit_id),
me AS (SELECT DISTINCT person_id, obs_datetime AS given_at, label AS drug_name FROM live WHERE concept_id IN (4, 5, 6) AND label IS NOT NULL AND year(obs_datetime) BETWEEN 1996 AND 2000),
ma AS (SELECT m.*, v.visit_id FROM me m ASOF JOIN vs v ON m.person_id = v.patient_id AND m.given_at >= v.visit_date_started),
mp AS (SELECT visit_id, {', '.join(f'max(CASE WHEN n = {i} THEN drug_name END) AS med_{i}' for i in range(1, _NM + 1))} FROM (SELECT visit_id, drug_name, row_number() OVER (PARTITION BY visit_id ORDER BY given_at, drug_name) AS n FROM ma) GROUP BY visit_id),
la AS (SELECT DISTINCT person_id, obs_datetime AS taken_at, label AS test, value_text AS result FROM live WHERE concept_id IN (1, 2, 7) AND label IS NOT NULL AND year(obs_datetime) BETWEEN 1996 AND 2000),
lt AS (SELECT m.*, v.visit_id FROM la m ASOF JOIN vs v ON m.person_id = v.patient_id AND date_trunc('day', m.taken_at) + INTERVAL 1 DAY > v.visit_date_started),
lp AS (SELECT visit_id, {', '.join(f'max(CASE WHEN n = {i} THEN test END) AS test_{i}, max(CASE WHEN n = {i} THEN result END) AS result_{i}' for i in range(1, _NT + 1))}
  FROM (SELECT visit_id, test, result, row_number() OVER (PARTITION BY visit_id ORDER BY taken_at, test, result) AS n FROM lt) GROUP BY visit_id),
vt AS (SELECT visit_id, encounter_id, encounter_datetime, {', '.join(f'max(CASE WHEN concept_id = {c} THEN value_numeric END) AS {n}' for n, c in _VITALS.items())}, max(CASE WHEN concept_id = 4 THEN value_text END) AS chief_complaint
  FROM live GROUP BY 1, 2, 3),
vl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS r FROM vt) WHERE r = 1)
SELECT vs.emr_id, vs.patient_id, vs.visit_id, visit_date_started, visit_date_stopped, p.gender, p.birthdate, {', '.join(_VITALS)}, chief_complaint, {', '.join(f'diagnosis_{i}' for i in range(1, _ND + 1))},
  {', '.join(f'med_{i}' for i in range(1, _NM + 1))}, {', '.join(f'test_{i}, result_{i}' for i in range(1, _NT + 1))}
FROM vs LEFT JOIN person p ON vs.patient_id = p.person_id LEFT JOIN vl ON vs.visit_id = vl.visit_id LEFT JOIN dx ON vs.visit_id = dx.visit_id LEFT JOIN mp ON vs.visit_id = mp.visit_id LEFT JOIN lp ON vs.visit_id = lp.visit_id
""")
def _(t):
    return outpatient.visit_cohort(*_curated(t), 1996, 2000)


def _curated(t):
    """Visits, patients, diagnoses, dispenses, labs and vitals as a warehouse would hold them."""
    from catalog.base import english
    from wardline.operators.filters import not_voided

    emr = F.concat(F.lit("E"), F.col("patient_id").cast("string")).alias("emr_id")
    visits = t.visit.select(emr, "visit_id", F.col("date_started").alias("visit_date_started"), F.col("date_stopped").alias("visit_date_stopped"))
    people = t.person.select(F.col("person_id").alias("patient_id"), "gender", "birthdate").select(emr, "patient_id", "gender", "birthdate")
    live = ob.with_labels(not_voided(t.pobs), english(t))
    question = F.col("concept_id")
    diagnoses = live.filter(question == 3).select("visit_id", "obs_id", F.col("label").alias("diagnosis_entered"))
    given = live.filter(question.isin(4, 5, 6)).select(
        F.col("person_id").alias("patient_id"), F.col("obs_datetime").alias("encounter_datetime"), F.col("label").alias("drug_name")
    )
    labs = live.filter(question.isin(1, 2, 7)).select(
        F.col("person_id").alias("patient_id"), F.col("obs_datetime").alias("specimen_collection_date"), F.col("label").alias("test"),
        F.col("value_text").alias("result"),
    )
    vitals = ob.collect_obs(not_voided(t.pobs), ["visit_id", "encounter_id", "encounter_datetime"], [
        *[ob.peak(name, concept) for name, concept in _VITALS.items()], ob.peak("chief_complaint", 4, "value_text"),
    ])
    return visits, people, diagnoses, given, labs, vitals


@query("visit_cohort_rest", """
WITH vs AS (SELECT patient_id, visit_id, date_started AS visit_date_started FROM visit WHERE year(date_stopped) >= 1996 AND year(date_started) <= 2000),
live AS (SELECT o.*, label FROM pobs o LEFT JOIN label_en l ON o.value_coded = l.concept_id WHERE NOT voided),
me AS (SELECT DISTINCT person_id, obs_datetime AS "at", label FROM live WHERE concept_id IN (4, 5, 6) AND label IS NOT NULL AND year(obs_datetime) BETWEEN 1996 AND 2000),
la AS (SELECT DISTINCT person_id, obs_datetime AS "at", label, value_text FROM live WHERE concept_id IN (1, 2, 7) AND label IS NOT NULL AND year(obs_datetime) BETWEEN 1996 AND 2000),
i AS (SELECT visit_id, 'diagnosis' AS kind, NULL::TIMESTAMP AS "at", obs_id AS entry, label AS value, NULL::VARCHAR AS result FROM live SEMI JOIN vs USING (visit_id) WHERE concept_id = 3
  UNION ALL SELECT v.visit_id, 'medicine', me."at", NULL, label, NULL FROM me ASOF JOIN vs v ON me.person_id = v.patient_id AND me."at" >= v.visit_date_started
  UNION ALL SELECT v.visit_id, 'test', la."at", NULL, label, value_text FROM la ASOF JOIN vs v ON la.person_id = v.patient_id AND date_trunc('day', la."at") + INTERVAL 1 DAY > v.visit_date_started),
n AS (SELECT *, row_number() OVER (PARTITION BY visit_id, kind ORDER BY "at" NULLS FIRST, entry NULLS FIRST, value NULLS FIRST, result NULLS FIRST) AS rank FROM i)
SELECT visit_id, kind, rank, value, result FROM n WHERE rank > CASE kind WHEN 'diagnosis' THEN 1 WHEN 'medicine' THEN 2 ELSE 3 END
""")
def _(t):
    return outpatient.visit_cohort_rest(*_curated(t)[:5], 1996, 2000, (1, 2, 3))
