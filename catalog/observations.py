"""Observation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import english, query
from wardline.functions.dates import moment
from wardline.operators import observations as ob
from wardline.operators.dictionary import concept_label
from wardline.operators.filters import not_voided

YES, NO = 1, 2

# One live value per (key, concept): latest by time, then id.
_LATEST = """
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key}, concept_id ORDER BY obs_datetime DESC, obs_id DESC) AS r
  FROM {obs} WHERE {live}{field} IS NOT NULL) WHERE r = 1)
"""


def latest_cte(field: str, key: str = "encounter_id", obs: str = "obs", live: str = "NOT voided AND ", name: str = "latest") -> str:
    return _LATEST.format(key=key, field=field, obs=obs, live=live).replace("latest AS", f"{name} AS", 1)


@query("obs_subset", """
SELECT obs_id, encounter_id, concept_id FROM obs WHERE NOT voided
AND encounter_id IN (SELECT encounter_id FROM encounter WHERE encounter_type = '1-URGENT' AND NOT voided)
""")
def _(t):
    anchors = not_voided(t.encounter).filter(F.col("encounter_type") == "1-URGENT")
    return ob.obs_subset(t.obs, anchors).select("obs_id", "encounter_id", "concept_id")


@query("obs_value", f"""
WITH {latest_cte('value_numeric', name='n')}, {latest_cte('value_text', name='x')}, {latest_cte('value_datetime', name='d')}, {latest_cte('value_coded', name='c')}
SELECT e.encounter_id, n1.value_numeric AS weight, n2.value_numeric AS pulse, x3.value_text AS note, d4.value_datetime AS due_at, c5.value_coded AS answer
FROM encounter e LEFT JOIN n n1 ON e.encounter_id = n1.encounter_id AND n1.concept_id = 1 LEFT JOIN n n2 ON e.encounter_id = n2.encounter_id AND n2.concept_id = 2
LEFT JOIN x x3 ON e.encounter_id = x3.encounter_id AND x3.concept_id = 3 LEFT JOIN d d4 ON e.encounter_id = d4.encounter_id AND d4.concept_id = 4
LEFT JOIN c c5 ON e.encounter_id = c5.encounter_id AND c5.concept_id = 5
""")
def _(t):
    wants = [ob.number("weight", 1), ob.number("pulse", 2), ob.text("note", 3), ob.when("due_at", 4), ob.coded("answer", 5)]
    return ob.register(t.encounter.select("encounter_id"), not_voided(t.obs), wants)


@query("obs_coded_list", """
SELECT encounter_id, string_agg(DISTINCT CASE WHEN o.concept_id = 3 THEN label END, ' | ' ORDER BY CASE WHEN o.concept_id = 3 THEN label END) AS complaints,
  string_agg(DISTINCT CASE WHEN o.concept_id = 4 THEN label END, '|' ORDER BY CASE WHEN o.concept_id = 4 THEN label END) AS findings
FROM obs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id IN (3, 4) GROUP BY encounter_id
""")
def _(t):
    wants = [ob.answer_list("complaints", 3), ob.answer_list("findings", 4, "|")]
    return ob.collect_obs(not_voided(t.obs), "encounter_id", wants, english(t))


@query("obs_coded_bool", """
SELECT encounter_id, bool_or(CASE WHEN concept_id = 3 AND value_coded = 1 THEN TRUE WHEN concept_id = 3 AND value_coded = 2 THEN FALSE END) AS counselled,
  bool_or(CASE WHEN concept_id = 5 AND value_coded = 1 THEN TRUE WHEN concept_id = 5 AND value_coded = 2 THEN FALSE END) AS alive
FROM obs WHERE NOT voided AND concept_id IN (3, 5) GROUP BY encounter_id
""")
def _(t):
    wants = [ob.yes_no("counselled", 3, YES, NO), ob.yes_no("alive", 5, YES, NO)]
    return ob.collect_obs(not_voided(t.obs), "encounter_id", wants)


@query("obs_comments", """
SELECT encounter_id, arg_max(CASE WHEN concept_id = 3 AND value_coded = 7 THEN comments END, CASE WHEN concept_id = 3 AND value_coded = 7 THEN (obs_datetime, obs_id) END) AS other_reason,
  arg_max(CASE WHEN concept_id = 6 AND value_coded IN (9, 10) THEN comments END, CASE WHEN concept_id = 6 AND value_coded IN (9, 10) THEN (obs_datetime, obs_id) END) AS other_site
FROM obs WHERE NOT voided AND concept_id IN (3, 6) GROUP BY encounter_id
""")
def _(t):
    wants = [ob.remark("other_reason", 3, 7), ob.remark("other_site", 6, (9, 10))]
    return ob.collect_obs(not_voided(t.obs), "encounter_id", wants)


@query("answer_exists", """
WITH f AS (SELECT encounter_id, bool_or(concept_id = 2 AND value_coded = 11) AS sepsis, bool_or(CASE WHEN concept_id = 2 AND value_coded = 12 THEN TRUE END) AS coma
  FROM obs WHERE NOT voided AND concept_id = 2 GROUP BY encounter_id)
SELECT e.encounter_id, coalesce(sepsis, FALSE) AS sepsis, coma FROM encounter e LEFT JOIN f ON e.encounter_id = f.encounter_id
""")
def _(t):
    wants = [ob.answered("sepsis", 2, 11), ob.answered_or_null("coma", 2, 12)]
    return ob.register(t.encounter.select("encounter_id"), not_voided(t.obs), wants)


@query("single_value_coded", """
SELECT encounter_id, max(CASE WHEN o.concept_id = 4 AND value_coded = 5 THEN label END) AS fasting,
  CASE WHEN max(CASE WHEN o.concept_id = 4 AND value_coded = 5 THEN 1 END) = 1 THEN 'FBG' WHEN max(CASE WHEN o.concept_id = 4 AND value_coded = 6 THEN 1 END) = 1 THEN 'RBG' END AS method
FROM obs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id = 4 GROUP BY encounter_id
""")
def _(t):
    wants = [ob.answer_label("fasting", 4, 5), ob.answer_label("random", 4, 6)]
    rows = ob.collect_obs(not_voided(t.obs), "encounter_id", wants, english(t))
    method = F.when(F.col("fasting").isNotNull(), "FBG").when(F.col("random").isNotNull(), "RBG")
    return rows.select("encounter_id", "fasting", method.alias("method"))


_PIVOT = [(f"{field}_{c}", c, field) for c in range(1, 8) for field in ("value_numeric", "value_text")]


@query("obs_pivot", "SELECT encounter_id, " + ", ".join(
    f"max(CASE WHEN concept_id = {c} THEN {field} END) AS {name}" for name, c, field in _PIVOT
) + """, max(CASE WHEN o.concept_id = 3 THEN label END) AS label_3, max(CASE WHEN o.concept_id = 5 AND value_coded = 4 THEN label END) AS trauma
FROM (SELECT o.*, label FROM obs o LEFT JOIN label_en l ON value_coded = l.concept_id) o WHERE NOT voided GROUP BY encounter_id
""")
def _(t):
    wants = [ob.peak(name, c, field) for name, c, field in _PIVOT]
    wants += [ob.peak("label_3", 3, "label"), ob.peak("trauma", 5, "label", 4)]
    return ob.collect_obs(not_voided(t.obs), "encounter_id", wants, english(t))


@query("obs_id_nth", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY encounter_id ORDER BY obs_id) AS n FROM obs WHERE NOT voided AND concept_id = 2)
SELECT encounter_id, obs_id, n - 1 AS position FROM r WHERE n IN (1, 2)
""")
def _(t):
    live = not_voided(t.obs)
    return ob.nth_obs(live, "encounter_id", 2, 0).select("encounter_id", "obs_id", F.lit(0).cast("long").alias("position")).unionByName(
        ob.nth_obs(live, "encounter_id", 2, 1).select("encounter_id", "obs_id", F.lit(1).cast("long").alias("position"))
    )


@query("group_value", f"""
WITH {latest_cte('value_numeric', 'obs_group_id', name='n')}, {latest_cte('value_datetime', 'obs_group_id', name='d')}, {latest_cte('value_text', 'obs_group_id', name='x')},
g AS (SELECT obs_group_id, string_agg(DISTINCT CASE WHEN o.concept_id = 3 THEN label END, ' | ' ORDER BY CASE WHEN o.concept_id = 3 THEN label END) AS causes,
  arg_max(CASE WHEN o.concept_id = 4 AND value_coded IN (1, 2, 3, 4, 5, 6, 7, 8) THEN comments END, CASE WHEN o.concept_id = 4 AND value_coded IN (1, 2, 3, 4, 5, 6, 7, 8) THEN (obs_datetime, obs_id) END) AS remark
  FROM obs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND obs_group_id IS NOT NULL AND o.concept_id IN (1, 2, 3, 4, 5) GROUP BY obs_group_id)
SELECT g.obs_group_id, n.value_numeric AS death_weight, d.value_datetime AS death_datetime, x.value_text AS other_cause, causes, remark
FROM g LEFT JOIN n ON g.obs_group_id = n.obs_group_id AND n.concept_id = 1 LEFT JOIN d ON g.obs_group_id = d.obs_group_id AND d.concept_id = 2
LEFT JOIN x ON g.obs_group_id = x.obs_group_id AND x.concept_id = 5
""")
def _(t):
    wants = [
        ob.number("death_weight", 1), ob.when("death_datetime", 2), ob.text("other_cause", 5),
        ob.answer_list("causes", 3), ob.remark("remark", 4, range(1, 9)),
    ]
    return ob.group_values(not_voided(t.obs), wants, english(t))


@query("group_of_answer", """
SELECT encounter_id, min(CASE WHEN concept_id = 3 AND value_coded = 8 THEN obs_group_id END) AS echo_group,
  min(CASE WHEN concept_id = 4 AND value_coded IN (8, 9) THEN obs_group_id END) AS history_group
FROM obs WHERE NOT voided AND concept_id IN (3, 4) GROUP BY encounter_id
""")
def _(t):
    wants = [ob.group_of("echo_group", 3, 8), ob.group_of("history_group", 4, (8, 9))]
    return ob.collect_obs(not_voided(t.obs), "encounter_id", wants)


@query("construct_children", """
WITH c AS (SELECT o.encounter_id, h.concept_id AS construct, string_agg(DISTINCT CASE WHEN o.concept_id = 3 THEN label END, ',' ORDER BY CASE WHEN o.concept_id = 3 THEN label END) AS coded,
    arg_max(CASE WHEN o.concept_id = 4 THEN o.value_text END, CASE WHEN o.concept_id = 4 THEN (o.obs_datetime, o.obs_id) END) AS noncoded
  FROM tobs o JOIN tobs h ON o.obs_group_id = h.obs_id AND h.concept_id IN (101, 102) LEFT JOIN label_en l ON o.value_coded = l.concept_id
  WHERE o.concept_id IN (3, 4) GROUP BY o.encounter_id, h.concept_id)
SELECT encounter_id, max(CASE WHEN construct = 101 THEN coded END) AS prior_coded, max(CASE WHEN construct = 101 THEN noncoded END) AS prior_noncoded,
  max(CASE WHEN construct = 102 THEN coded END) AS final_coded, max(CASE WHEN construct = 102 THEN noncoded END) AS final_noncoded FROM c GROUP BY encounter_id
""")
def _(t):
    wants = [ob.answer_list("coded", 3, ","), ob.text("noncoded", 4)]
    return ob.construct_children(t.tobs, {"prior": 101, "final": 102}, wants, label_table=english(t))


_DRUGS = {f"drug{i}": i for i in range(27)}


@query("drug_attribute_matrix", f"""
WITH {latest_cte('value_numeric', 'obs_group_id', name='n')},
g AS (SELECT encounter_id, value_drug, min(obs_group_id) AS obs_group_id FROM obs WHERE NOT voided AND obs_group_id IS NOT NULL AND value_drug < 27 GROUP BY 1, 2),
u AS (SELECT obs_group_id, o.concept_id, string_agg(DISTINCT label, ' | ' ORDER BY label) AS lbl FROM obs o JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided GROUP BY 1, 2),
w AS (SELECT g.encounter_id, g.value_drug, n1.value_numeric AS dose, n4.value_numeric AS duration, u2.lbl AS dose_units, u3.lbl AS frequency, u5.lbl AS duration_units, u6.lbl AS route FROM g
  LEFT JOIN n n1 ON g.obs_group_id = n1.obs_group_id AND n1.concept_id = 1 LEFT JOIN n n4 ON g.obs_group_id = n4.obs_group_id AND n4.concept_id = 4
  LEFT JOIN u u2 ON g.obs_group_id = u2.obs_group_id AND u2.concept_id = 2 LEFT JOIN u u3 ON g.obs_group_id = u3.obs_group_id AND u3.concept_id = 3
  LEFT JOIN u u5 ON g.obs_group_id = u5.obs_group_id AND u5.concept_id = 5 LEFT JOIN u u6 ON g.obs_group_id = u6.obs_group_id AND u6.concept_id = 6)
SELECT encounter_id, """ + ", ".join(
    f"max(CASE WHEN value_drug = {i} THEN {a} END) AS drug{i}_{a}"
    for i in range(27) for a in ("dose", "dose_units", "frequency", "duration", "duration_units", "route")
) + " FROM w GROUP BY encounter_id")
def _(t):
    wants = [
        ob.number("dose", 1), ob.answer_list("dose_units", 2), ob.answer_list("frequency", 3),
        ob.number("duration", 4), ob.answer_list("duration_units", 5), ob.answer_list("route", 6),
    ]
    return ob.drug_attribute_matrix(not_voided(t.obs), "encounter_id", _DRUGS, wants, english(t))


@query("visit_value", f"""
WITH {latest_cte('value_numeric', 'visit_id', 'pobs', name='n')},
u AS (SELECT visit_id, string_agg(DISTINCT label, ' | ' ORDER BY label) AS lbl FROM pobs o JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id = 3 GROUP BY 1)
SELECT v.visit_id, n1.value_numeric AS height, n2.value_numeric / 10 AS muac_cm, lbl AS visit_type FROM visit v
LEFT JOIN n n1 ON v.visit_id = n1.visit_id AND n1.concept_id = 1 LEFT JOIN n n2 ON v.visit_id = n2.visit_id AND n2.concept_id = 2 LEFT JOIN u ON v.visit_id = u.visit_id
""")
def _(t):
    wants = [ob.number("height", 1), ob.number("muac_cm", 2), ob.answer_list("visit_type", 3)]
    rows = ob.register(t.visit.select("visit_id"), not_voided(t.pobs), wants, "visit_id", english(t))
    return rows.withColumn("muac_cm", F.col("muac_cm") / 10)


@query("visit_coded_nth", """
WITH r AS (SELECT visit_id, o.concept_id, label, row_number() OVER (PARTITION BY visit_id, o.concept_id ORDER BY obs_id) AS n
  FROM pobs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id IN (3, 4))
SELECT visit_id, """ + ", ".join(
    f"max(CASE WHEN concept_id = {c} AND n = {i} THEN label END) AS {name}_{i}" for name, c in (("diag", 3), ("certainty", 4)) for i in (1, 2, 3)
) + " FROM r WHERE n <= 3 GROUP BY visit_id")
def _(t):
    return ob.ranked_answers(not_voided(t.pobs), "visit_id", {"diag": 3, "certainty": 4}, 3, english(t))


@query("visit_coded_nth_grouped", """
WITH lead AS (SELECT visit_id, obs_group_id, min(obs_id) AS f FROM pobs WHERE NOT voided AND concept_id = 3 AND obs_group_id IS NOT NULL GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY f, obs_group_id) AS n FROM lead),
g AS (SELECT visit_id, obs_group_id, string_agg(DISTINCT CASE WHEN o.concept_id = 3 THEN label END, ' | ' ORDER BY CASE WHEN o.concept_id = 3 THEN label END) AS diag,
   string_agg(DISTINCT CASE WHEN o.concept_id = 4 THEN label END, ' | ' ORDER BY CASE WHEN o.concept_id = 4 THEN label END) AS certainty
  FROM pobs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id IN (3, 4) GROUP BY 1, 2)
SELECT k.visit_id, """ + ", ".join(
    f"max(CASE WHEN n = {i} THEN {c} END) AS {c}_{i}" for c in ("diag", "certainty") for i in (1, 2, 3)
) + " FROM k JOIN g ON k.visit_id = g.visit_id AND k.obs_group_id = g.obs_group_id WHERE n <= 3 GROUP BY k.visit_id")
def _(t):
    wants = [ob.answer_list("diag", 3), ob.answer_list("certainty", 4)]
    return ob.ranked_groups(not_voided(t.pobs), "visit_id", 3, wants, 3, english(t))


@query("latest_patient_value", f"""
WITH {latest_cte('value_numeric', 'person_id', 'pobs', name='n')}, {latest_cte('value_text', 'person_id', 'pobs', name='x')}, {latest_cte('value_datetime', 'person_id', 'pobs', name='d')}
SELECT p.person_id, n.value_numeric AS last_weight, x.value_text AS last_note, d.value_datetime AS next_appointment
FROM (SELECT DISTINCT person_id FROM pobs WHERE NOT voided AND concept_id IN (1, 2, 3)) p LEFT JOIN n ON p.person_id = n.person_id AND n.concept_id = 1
LEFT JOIN x ON p.person_id = x.person_id AND x.concept_id = 2 LEFT JOIN d ON p.person_id = d.person_id AND d.concept_id = 3
""")
def _(t):
    wants = [ob.number("last_weight", 1), ob.text("last_note", 2), ob.when("next_appointment", 3)]
    return ob.collect_obs(not_voided(t.pobs), "person_id", wants)


@query("latest_answer_list", """
WITH e AS (SELECT person_id, o.concept_id, encounter_id, max(obs_datetime) AS seen, string_agg(DISTINCT label, ' | ' ORDER BY label) AS lst
  FROM pobs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id IN (3, 4) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY person_id, concept_id ORDER BY seen DESC, encounter_id DESC) AS n FROM e)
SELECT person_id, max(CASE WHEN concept_id = 3 THEN lst END) AS education, max(CASE WHEN concept_id = 4 THEN lst END) AS referral FROM r WHERE n = 1 GROUP BY person_id
""")
def _(t):
    return ob.latest_answer_lists(not_voided(t.pobs), "person_id", {"education": 3, "referral": 4}, english(t))


@query("answer_ever", """
SELECT person_id, coalesce(bool_or(concept_id = 3 AND value_coded = 5 AND obs_datetime >= TIMESTAMP '1998-01-01 00:00:00'), FALSE) AS diabetes,
  coalesce(bool_or(concept_id = 4 AND value_coded = 6 AND obs_datetime >= TIMESTAMP '1998-01-01 00:00:00'), FALSE) AS hypertension
FROM pobs WHERE NOT voided AND concept_id IN (3, 4) GROUP BY person_id
""")
def _(t):
    return ob.answer_ever(not_voided(t.pobs), "person_id", {"diabetes": (3, 5), "hypertension": (4, 6)}, moment("1998-01-01 00:00:00"))


@query("latest_in_visit", f"""
WITH {latest_cte('value_coded', 'visit_id', 'pobs')}
SELECT visit_id, label AS disposition FROM latest r LEFT JOIN label_en l ON value_coded = l.concept_id WHERE r.concept_id = 6
""")
def _(t):
    rows = ob.collect_obs(not_voided(t.pobs), "visit_id", [ob.coded("answer", 6)])
    return concept_label(rows, english(t), "answer", "disposition").select("visit_id", "disposition")


@query("latest_before_encounter", """
SELECT 'any' AS scope, e.encounter_id, o.value_coded FROM adt e ASOF LEFT JOIN
  (SELECT * FROM eobs WHERE NOT voided AND concept_id = 203) o ON e.patient_id = o.person_id AND e.encounter_datetime > o.obs_datetime
UNION ALL
SELECT 'visit', e.encounter_id, o.value_coded FROM adt e ASOF LEFT JOIN
  (SELECT b.*, a.visit_id FROM eobs b JOIN adt a ON b.encounter_id = a.encounter_id WHERE NOT b.voided AND concept_id = 203) o
  ON e.patient_id = o.person_id AND e.visit_id = o.visit_id AND e.encounter_datetime > o.obs_datetime
""")
def _(t):
    live = not_voided(t.eobs).join(t.adt.select("encounter_id", "visit_id"), "encounter_id")
    events = t.adt.select(F.col("patient_id").alias("person_id"), "visit_id", "encounter_id", "encounter_datetime")
    out = None
    for scope in ("any", "visit"):
        part = ob.latest_before_encounter(events, live, 203, ["value_coded"], same_visit=scope == "visit")
        part = part.select(F.lit(scope).alias("scope"), "encounter_id", "value_coded")
        out = part if out is None else out.unionByName(part)
    return out


@query("toplevel_only", "SELECT obs_id, encounter_id FROM obs WHERE obs_group_id IS NULL")
def _(t):
    return ob.toplevel_only(t.obs).select("obs_id", "encounter_id")


_SETS = {"economy": "ECONOMY", "small": "SMALL", "medium": "MEDIUM", "large": "LARGE", "promo": "PROMO", "standard": "STANDARD", "big": "BIG"}


@query("category_symptom", """
WITH m AS (SELECT DISTINCT concept_id, concept_set FROM concept_set),
r AS (SELECT encounter_id, concept_set, label, row_number() OVER (PARTITION BY encounter_id, concept_set ORDER BY obs_id) AS n
  FROM obs o JOIN m ON value_coded = m.concept_id LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id = 3)
SELECT encounter_id, """ + ", ".join(f"max(CASE WHEN concept_set = '{s}' THEN label END) AS {n}" for n, s in _SETS.items()) + " FROM r WHERE n = 1 GROUP BY encounter_id")
def _(t):
    return ob.category_symptoms(not_voided(t.obs), "encounter_id", 3, t.concept_set, _SETS, english(t))


@query("section_populated", """
SELECT encounter_id, bool_or(CASE WHEN concept_id IN (1, 2) OR value_coded IN (4, 5) THEN TRUE END) AS diabetes, bool_or(CASE WHEN value_coded IN (7, 8, 9) THEN TRUE END) AS heart,
  bool_or(CASE WHEN concept_id = 7 THEN TRUE END) AS kidney FROM obs WHERE NOT voided GROUP BY encounter_id
""")
def _(t):
    sections = {"diabetes": {"questions": [1, 2], "answers": [4, 5]}, "heart": {"answers": [7, 8, 9]}, "kidney": {"questions": [7]}}
    return ob.section_populated(not_voided(t.obs), "encounter_id", sections)


@query("count_answer", """
SELECT encounter_id, count(*) FILTER (WHERE concept_id = 303 AND value_coded = 321) AS live_births, count(*) FILTER (WHERE concept_id = 303) AS outcomes
FROM eobs WHERE NOT voided AND concept_id = 303 GROUP BY encounter_id
""")
def _(t):
    wants = [ob.tally("live_births", 303, 321), ob.tally("outcomes", 303)]
    return ob.collect_obs(not_voided(t.eobs), "encounter_id", wants)


@query("risk_factor_list", """
SELECT encounter_id, string_agg(DISTINCT label, '|' ORDER BY label) AS risk_factors FROM obs o JOIN label_en l ON o.concept_id = l.concept_id
WHERE NOT voided AND obs_group_id IS NULL AND value_coded = 1 AND o.concept_id IN (1, 2, 3, 5, 7) GROUP BY encounter_id
""")
def _(t):
    return ob.risk_factors(not_voided(t.obs), "encounter_id", [1, 2, 3, 5, 7], YES, english(t))
