"""Scalar functions, derived clinical rules, scores, ranges and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import NOW, english, months_sql, query, weeks_sql, years_sql
from catalog.observations import latest_cte
from wardline.functions import clinical as cl
from wardline.functions import dates as dt
from wardline.functions import scoring as sc
from wardline.functions.text import reword
from wardline.operators import dashboards as db
from wardline.operators import observations as ob
from wardline.operators import programs as pg
from wardline.operators import ranges as rg
from wardline.operators.dictionary import labels
from wardline.operators.filters import not_voided

_NOW = f"TIMESTAMP '{NOW}'"


# ---- scalar functions

@query("complete_units", f"""
SELECT person_id, {years_sql('birthdate', _NOW)} AS years, CASE WHEN {_NOW} >= birthdate THEN {months_sql('birthdate', _NOW)} END AS months,
  {weeks_sql('birthdate', _NOW)} AS weeks, CAST(trunc((epoch_us({_NOW}) - epoch_us(birthdate)) / 1000000.0) AS BIGINT) AS seconds FROM person
""")
def _(t):
    born, now = F.col("birthdate"), dt.moment(NOW)
    return t.person.select(
        "person_id", dt.complete_units("YEAR", born, now).alias("years"), dt.complete_units("MONTH", born, now).alias("months"),
        dt.complete_units("WEEK", born, now).alias("weeks"), dt.complete_units("SECOND", born, now).alias("seconds"),
    )


@query("day_difference", "SELECT visit_id, CAST(date_diff('day', CAST(date_started AS DATE), CAST(date_stopped AS DATE)) AS INT) AS days FROM visit")
def _(t):
    return t.visit.select("visit_id", dt.days_between(F.col("date_started"), F.col("date_stopped")).alias("days"))


@query("date_shift", "SELECT encounter_id, encounter_datetime - INTERVAL 1 DAY AS day_before, encounter_datetime + INTERVAL 8 HOUR AS later FROM encounter")
def _(t):
    at = F.col("encounter_datetime")
    return t.encounter.select("encounter_id", dt.shift_days(at, -1).alias("day_before"), dt.shift_hours(at, 8).alias("later"))


@query("date_truncate", "SELECT encounter_id, CAST(CAST(encounter_datetime AS DATE) AS VARCHAR) AS day, CAST(year(encounter_datetime) AS INT) AS y FROM encounter")
def _(t):
    return t.encounter.select("encounter_id", F.to_date("encounter_datetime").alias("day"), F.year("encounter_datetime").alias("y"))


@query("seconds_of_day", "SELECT encounter_id, CAST(hour(encounter_datetime) * 3600 + minute(encounter_datetime) * 60 + second(encounter_datetime) AS INT) AS s FROM adt")
def _(t):
    return t.adt.select("encounter_id", dt.second_of_day(F.col("encounter_datetime")).alias("s"))


@query("date_format", """
SELECT encounter_id, strftime(encounter_datetime, '%b %-d, %Y ') || lower(strftime(encounter_datetime, '%-I:%M%p')) AS long_form,
  strftime(encounter_datetime, '%-d %b %Y') AS day, strftime(encounter_datetime, '%I:%M %p') AS clock FROM encounter
""")
def _(t):
    at = F.col("encounter_datetime")
    return t.encounter.select(
        "encounter_id", dt.readable_datetime(at).alias("long_form"), dt.readable_date(at).alias("day"), dt.readable_time(at).alias("clock")
    )


@query("age_text", f"""
SELECT person_id, CAST({years_sql('birthdate', _NOW)} AS VARCHAR) || '.' || CAST({months_sql('birthdate', _NOW)} % 12 AS VARCHAR) AS age FROM person
""")
def _(t):
    return t.person.select("person_id", dt.years_dot_months(F.col("birthdate"), dt.moment(NOW)).alias("age"))


@query("null_handling", """
SELECT obs_id, coalesce(value_numeric, 0) AS filled, CASE WHEN value_numeric IS NULL THEN 'missing' WHEN value_numeric > 25 THEN 'high' ELSE 'low' END AS band FROM obs
""")
def _(t):
    v = F.col("value_numeric")
    return t.obs.select("obs_id", F.coalesce(v, F.lit(0.0)).alias("filled"), F.when(v.isNull(), "missing").when(v > 25, "high").otherwise("low").alias("band"))


@query("string_functions", """
SELECT obs_id, CASE WHEN value_numeric IS NULL THEN NULL ELSE value_text || '| ' || comments END AS joined, lower(value_text) AS small, replace(comments, 'note ', 'remark ') AS reworded FROM obs
""")
def _(t):
    joined = F.concat(F.when(F.col("value_numeric").isNotNull(), F.col("value_text")), F.lit("| "), F.col("comments"))
    return t.obs.select(
        "obs_id", joined.alias("joined"), F.lower("value_text").alias("small"), reword(F.col("comments"), {"note ": "remark "}).alias("reworded")
    )


@query("regex_match", "SELECT person_address_id, regexp_matches(city_village, '^V[0-9]$') AS short_code FROM person_address")
def _(t):
    return t.person_address.select("person_address_id", F.col("city_village").rlike("^V[0-9]$").alias("short_code"))


@query("arithmetic", "SELECT obs_id, value_numeric / 10 AS cm, CASE WHEN value_numeric < 4 THEN value_numeric * 1000 ELSE value_numeric END AS ml FROM obs")
def _(t):
    v = F.col("value_numeric")
    return t.obs.select("obs_id", (v / 10).alias("cm"), F.when(v < 4, v * 1000).otherwise(v).alias("ml"))


@query("derived_ids", """
SELECT obs_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-' || substring(h, 13, 4) || '-' || substring(h, 17, 4) || '-' || substring(h, 21, 12) AS new_uuid,
  TRUE AS above_all, CAST(1 AS BIGINT) AS holders
FROM (SELECT obs_id, md5(CAST(obs_id AS VARCHAR) || ':recode') AS h FROM obs WHERE NOT voided)
""")
def _(t):
    from wardline.operators import changes as ch

    table = t.obs.withColumn("uuid", F.col("obs_id").cast("string"))
    made = t.obs.filter(~F.col("voided")).select(
        F.col("obs_id").alias("previous_version"), "encounter_id", "concept_id", F.lit(False).alias("voided"), ch.derived_uuid(F.col("obs_id"), "recode").alias("uuid"),
    )
    table = table.withColumn("previous_version", F.lit(None).cast("bigint"))
    after = ch.apply_changeset(table, ch.ChangeSet("obs_id", made))
    held = after.groupBy("obs_id").agg(F.count("*").alias("holders"))
    top = table.agg(F.max("obs_id")).scalar()
    return after.filter(F.col("previous_version").isNotNull()).join(held, "obs_id").select(
        F.col("previous_version").alias("obs_id"), F.col("uuid").alias("new_uuid"), (F.col("obs_id") > top).alias("above_all"), "holders",
    )


# ---- clinical rules

@query("age_at_event", f"""
SELECT e.encounter_id, {years_sql('p.birthdate', 'e.encounter_datetime')} AS age_at_encounter FROM encounter e JOIN person p ON e.patient_id = p.person_id
""")
def _(t):
    rows = t.encounter.join(t.person, F.col("patient_id") == F.col("person_id"))
    return rows.select("encounter_id", cl.age_at(F.col("birthdate"), F.col("encounter_datetime")).alias("age_at_encounter"))


@query("gestational_age_weeks", f"""
WITH {latest_cte('value_datetime', 'person_id', 'pobs', name='d')}, {latest_cte('value_numeric', 'person_id', 'pobs', name='n')},
e AS (SELECT patient_id, min(encounter_datetime) AS enrolled FROM encounter GROUP BY patient_id),
j AS (SELECT e.patient_id, enrolled, CASE WHEN CAST(d1.obs_datetime AS DATE) >= CAST(enrolled AS DATE) THEN d1.value_datetime END AS lmp,
   CASE WHEN CAST(n.obs_datetime AS DATE) >= CAST(enrolled AS DATE) THEN n.value_numeric END AS entered, CASE WHEN CAST(n.obs_datetime AS DATE) >= CAST(enrolled AS DATE) THEN n.obs_datetime END AS entered_at,
   coalesce(CASE WHEN CAST(d2.obs_datetime AS DATE) >= CAST(enrolled AS DATE) THEN d2.value_datetime END, TIMESTAMP '2002-01-01 00:00:00') AS fin
  FROM e LEFT JOIN d d1 ON e.patient_id = d1.person_id AND d1.concept_id = 1 LEFT JOIN d d2 ON e.patient_id = d2.person_id AND d2.concept_id = 2
  LEFT JOIN n ON e.patient_id = n.person_id AND n.concept_id = 3)
SELECT patient_id, CASE WHEN lmp IS NOT NULL THEN CAST({weeks_sql("date_trunc('day', lmp)", 'fin')} AS DOUBLE) ELSE entered + {weeks_sql('entered_at', 'fin')} END AS weeks FROM j
""")
def _(t):
    live = not_voided(t.pobs)

    def latest(concept, field, name):
        rows = live.filter((F.col("concept_id") == concept) & F.col(field).isNotNull())
        return rows.groupBy(F.col("person_id").alias("patient_id")).agg(
            F.max(F.struct("obs_datetime", "obs_id", F.col(field).alias("v"))).alias(name)
        )

    start = t.encounter.groupBy("patient_id").agg(F.min("encounter_datetime").alias("enrolled"))
    rows = start
    for part in (latest(1, "value_datetime", "lmp"), latest(2, "value_datetime", "birth"), latest(3, "value_numeric", "weeks")):
        rows = rows.join(part, "patient_id", "left")
    weeks = cl.gestational_age_weeks(
        F.col("lmp.v"), F.col("lmp.obs_datetime"), F.col("weeks.v"), F.col("weeks.obs_datetime"),
        F.col("birth.v"), F.col("birth.obs_datetime"), F.col("enrolled"), dt.moment("2002-01-01 00:00:00"),
    )
    return rows.select("patient_id", weeks.alias("weeks"))


@query("priority_class", """
SELECT person_id, CASE WHEN bool_or(value_coded = 5) THEN 'Type 2' WHEN bool_or(value_coded = 6) THEN 'Type 1' WHEN bool_or(value_coded = 7) THEN 'Gestational' END AS kind
FROM pobs WHERE NOT voided AND concept_id = 3 GROUP BY person_id
""")
def _(t):
    rows = ob.answer_ever(not_voided(t.pobs), "person_id", {"a": (3, 5), "b": (3, 6), "c": (3, 7)})
    kind = cl.first_match([(F.col("a"), "Type 2"), (F.col("b"), "Type 1"), (F.col("c"), "Gestational")])
    return rows.select("person_id", kind.alias("kind"))


@query("relabel", """
SELECT encounter_id, CASE encounter_type WHEN '1-URGENT' THEN 'Inpatient Ward' WHEN '5-LOW' THEN 'OPD' ELSE encounter_type END AS source FROM encounter
""")
def _(t):
    from wardline.functions.text import relabel

    return t.encounter.select("encounter_id", relabel(F.col("encounter_type"), {"1-URGENT": "Inpatient Ward", "5-LOW": "OPD"}).alias("source"))


@query("symptom_control_score", f"""
WITH {latest_cte('value_coded')},
w AS (SELECT encounter_id, """ + ", ".join(f"max(CASE WHEN concept_id = {c} THEN value_coded % 3 END) AS a{c}" for c in (1, 2, 3, 4)) + """
  FROM latest GROUP BY encounter_id),
s AS (SELECT encounter_id, a1, a2, a3, a4, (CASE WHEN a1 = 1 THEN 1 ELSE 0 END + CASE WHEN a2 = 1 THEN 1 ELSE 0 END + CASE WHEN a3 = 1 THEN 1 ELSE 0 END + CASE WHEN a4 = 1 THEN 1 ELSE 0 END) AS n FROM w)
SELECT encounter_id, CASE WHEN a1 IS NULL OR a2 IS NULL OR a3 IS NULL OR a4 IS NULL THEN NULL WHEN n >= 3 THEN 'Uncontrolled' WHEN n >= 1 THEN 'Partly controlled' ELSE 'Well controlled' END AS control FROM s
""")
def _(t):
    rows = ob.collect_obs(not_voided(t.obs), "encounter_id", [ob.coded(f"a{c}", c) for c in range(1, 8)])
    control = cl.symptom_control([F.col(f"a{c}") % 3 for c in (1, 2, 3, 4)], F.lit(1))
    return rows.select("encounter_id", control.alias("control"))


@query("reporting_outcome", f"""
WITH l AS (SELECT patient_id, max(encounter_datetime) AS last_visit FROM adt WHERE encounter_type = 'vitals' GROUP BY patient_id)
SELECT p.patient_program_id, CASE WHEN date_diff('day', CAST(coalesce(last_visit - INTERVAL 100 DAY, date_enrolled) AS DATE), DATE '2024-02-15') > 90
  AND date_diff('day', CAST(date_enrolled - to_days(CAST(150 + patient_program_id % 40 AS INTEGER)) AS DATE), DATE '2024-02-15') > 180 AND date_completed IS NULL THEN 'Lost to followup' ELSE label END AS outcome
FROM patient_program p LEFT JOIN l ON p.patient_id = l.patient_id LEFT JOIN label_en b ON outcome_concept_id = b.concept_id
""")
def _(t):
    seen = t.adt.filter(F.col("encounter_type") == "vitals").groupBy("patient_id").agg(F.max("encounter_datetime").alias("last_visit"))
    rows = t.patient_program.join(seen, "patient_id", "left").join(
        english(t), F.col("outcome_concept_id") == F.col("concept_id"), "left"
    )
    appointment = F.col("date_enrolled") - F.make_dt_interval((150 + F.col("patient_program_id") % 40).cast("int"))
    outcome = cl.reporting_outcome(
        F.col("label"), F.col("date_completed"), dt.shift_days(F.col("last_visit"), -100), F.col("date_enrolled"),
        appointment, dt.moment("2024-02-15 00:00:00"),
    )
    return rows.select("patient_program_id", outcome.alias("outcome"))


@query("followup_flags", """
WITH s AS (SELECT visit_id, date_diff('day', CAST(date_started AS DATE), DATE '2001-09-01') AS d, date_stopped FROM visit)
SELECT visit_id, CASE WHEN date_stopped IS NOT NULL THEN CASE WHEN d <= 14 THEN 'Oui' ELSE 'No' END END AS came_within_14_days,
  CASE WHEN date_stopped IS NOT NULL THEN CASE WHEN d <= 91.2501 THEN 'No' ELSE 'Oui' END END AS over_three_months,
  CASE WHEN date_stopped IS NOT NULL THEN CASE WHEN d <= 182.5 THEN 'No' ELSE 'Oui' END END AS over_six_months FROM s
""")
def _(t):
    flags = cl.followup_flags(F.col("date_started"), F.col("date_stopped"), dt.moment("2001-09-01 00:00:00"))
    return t.visit.select("visit_id", *[c.alias(n) for n, c in flags.items()])


@query("days_in_care", f"""
SELECT patient_program_id, CAST(date_diff('day', CAST(date_enrolled AS DATE), CAST(coalesce(date_completed, TIMESTAMP '2024-06-01 00:00:00') AS DATE)) AS INT) AS days FROM patient_program
""")
def _(t):
    days = cl.days_in_care(F.col("date_enrolled"), F.col("date_completed"), dt.moment("2024-06-01 00:00:00"))
    return t.patient_program.select("patient_program_id", days.alias("days"))


@query("latest_lab", """
SELECT person_id, encounter_datetime AS lab_date, value_numeric AS lab_value FROM (
  SELECT o.person_id, o.encounter_datetime, value_numeric, row_number() OVER (PARTITION BY o.person_id ORDER BY o.encounter_datetime DESC, obs_datetime DESC, obs_id DESC) AS r
  FROM pobs o JOIN encounter e ON o.encounter_id = e.encounter_id WHERE NOT e.voided AND e.encounter_type IN ('1-URGENT', '3-MEDIUM') AND NOT o.voided AND concept_id = 2 AND value_numeric IS NOT NULL) WHERE r = 1
""")
def _(t):
    return pg.latest_lab(t.pobs.drop("encounter_datetime"), t.encounter, ["1-URGENT", "3-MEDIUM"], 2).select("person_id", "lab_date", "lab_value")


@query("lab_order_flag", """
SELECT encounter_id, bool_or(o.concept_id = 7) AS hba1c, bool_or(o.concept_id = 9) AS creatinine,
  string_agg(DISTINCT CASE WHEN order_type_id = 1 THEN label END, '|' ORDER BY CASE WHEN order_type_id = 1 THEN label END) AS tests_ordered
FROM orders_placed o LEFT JOIN label_en l ON o.concept_id = l.concept_id WHERE NOT voided GROUP BY encounter_id
""")
def _(t):
    return pg.lab_orders(t.orders_placed, {"hba1c": 7, "creatinine": 9}, 1, english(t))


@query("treatment_category", """
WITH g AS (SELECT encounter_id, value_drug, min(obs_group_id) AS gid FROM obs WHERE NOT voided AND obs_group_id IS NOT NULL AND value_drug IN (1, 2, 3, 4) GROUP BY 1, 2),
""" + latest_cte("value_numeric", "obs_group_id", name="n").strip() + """,
m AS (SELECT g.encounter_id, max(CASE WHEN g.value_drug = 1 THEN n.value_numeric END) AS q1, max(CASE WHEN g.value_drug = 2 THEN n.value_numeric END) AS q2,
  max(CASE WHEN g.value_drug = 3 THEN n.value_numeric END) AS q3, max(CASE WHEN g.value_drug = 4 THEN n.value_numeric END) AS q4
  FROM g LEFT JOIN n ON g.gid = n.obs_group_id AND n.concept_id = 1 GROUP BY g.encounter_id)
SELECT encounter_id, CASE WHEN q1 > 0 OR q2 > 0 THEN 1 ELSE 0 END AS act, CASE WHEN q3 > 0 OR q4 > 0 THEN 1 ELSE 0 END AS antibiotic FROM m
""")
def _(t):
    rows = ob.drug_attribute_matrix(not_voided(t.obs), "encounter_id", {f"d{i}": i for i in (1, 2, 3, 4)}, [ob.number("quantity", 1)])
    flags = cl.class_flags({"act": ["d1_quantity", "d2_quantity"], "antibiotic": ["d3_quantity", "d4_quantity"]})
    return rows.select("encounter_id", *[c.alias(n) for n, c in flags.items()])


@query("retrospective_entry", """
SELECT encounter_id, trunc((epoch_us(date_created) - epoch_us(encounter_datetime)) / 1000000.0) > 1800 AS late,
  (hour(date_created) * 3600 + minute(date_created) * 60 + second(date_created)) - (hour(encounter_datetime) * 3600 + minute(encounter_datetime) * 60 + second(encounter_datetime)) > 1800 AS late_by_clock FROM encounter
""")
def _(t):
    created, at = F.col("date_created"), F.col("encounter_datetime")
    return t.encounter.select("encounter_id", cl.retrospective(created, at).alias("late"), cl.retrospective(created, at, True).alias("late_by_clock"))


@query("born_in_facility", """
SELECT v.visit_id, CASE WHEN EXISTS (SELECT 1 FROM visit_attribute a WHERE a.visit_id = v.visit_id AND a.attribute_type_id = 1 AND a.value_reference = 'true' AND NOT a.voided) THEN 'inborn' ELSE 'outborn' END AS inborn_outborn FROM adt_visit v
""")
def _(t):
    return pg.born_in_facility(t.adt_visit, t.visit_attribute, 1).select("visit_id", "inborn_outborn")


_STATE = """
st AS (SELECT s.patient_program_id, l.label, row_number() OVER (PARTITION BY s.patient_program_id ORDER BY s.start_date DESC, s.patient_state_id DESC) AS r
  FROM patient_state s JOIN program_workflow_state w ON s.state = w.program_workflow_state_id AND w.program_workflow_id = 1 LEFT JOIN label_en l ON w.concept_id = l.concept_id WHERE NOT s.voided AND {when})
"""


@query("current_program_state", f"""
WITH {_STATE.format(when="s.end_date IS NULL")},
{_STATE.format(when="s.start_date <= TIMESTAMP '2024-01-15 00:00:00' AND (s.end_date IS NULL OR s.end_date >= TIMESTAMP '2024-01-15 00:00:00')").strip().replace('st AS', 'st2 AS', 1)}
SELECT 'now' AS moment, p.patient_program_id, label AS program_state FROM patient_program p LEFT JOIN st ON p.patient_program_id = st.patient_program_id AND r = 1
UNION ALL SELECT 'then', p.patient_program_id, label FROM patient_program p LEFT JOIN st2 ON p.patient_program_id = st2.patient_program_id AND r = 1
""")
def _(t):
    args = (t.patient_program, t.patient_state, t.program_workflow_state, 1, english(t))
    now = pg.current_program_state(*args).select(F.lit("now").alias("moment"), "patient_program_id", "program_state")
    then = pg.current_program_state(*args, at=dt.moment("2024-01-15 00:00:00")).select(F.lit("then").alias("moment"), "patient_program_id", "program_state")
    return now.unionByName(then)


@query("most_recent_enrolment", """
SELECT patient_id, patient_program_id, date_enrolled FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date_enrolled DESC, patient_program_id DESC) AS r
  FROM patient_program WHERE NOT voided AND program_id = 1) WHERE r = 1
""")
def _(t):
    return pg.most_recent_enrolment(t.patient_program, 1)


@query("latest_encounter_since", """
WITH s AS (SELECT patient_id, max(date_enrolled) AS since FROM patient_program WHERE NOT voided AND program_id = 1 GROUP BY patient_id)
SELECT patient_id, encounter_id, encounter_datetime, location_id FROM (SELECT e.*, row_number() OVER (PARTITION BY e.patient_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS r
  FROM adt e LEFT JOIN s ON e.patient_id = s.patient_id WHERE NOT voided AND encounter_type IN ('delivery') AND (since IS NULL OR encounter_datetime >= since)) WHERE r = 1
""")
def _(t):
    since = pg.most_recent_enrolment(t.patient_program, 1).select("patient_id", F.col("date_enrolled").alias("since"))
    return pg.latest_encounter_since(t.adt, ["delivery"], since)


_CURRENT = """
lv AS (SELECT patient_id, max(encounter_datetime) AS gone FROM adt WHERE NOT voided AND encounter_type = 'discharge' GROUP BY patient_id),
en AS (SELECT e.patient_id, e.location_id, row_number() OVER (PARTITION BY e.patient_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS r
  FROM adt e LEFT JOIN lv ON e.patient_id = lv.patient_id WHERE NOT voided AND encounter_type IN ('admission', 'transfer') AND (gone IS NULL OR encounter_datetime >= gone)),
cur AS (SELECT d.patient_id, en.location_id FROM (SELECT DISTINCT patient_id FROM adt WHERE NOT voided AND encounter_type IN ('admission', 'transfer', 'discharge')) d LEFT JOIN en ON d.patient_id = en.patient_id AND r = 1)
"""


@query("current_location", f"WITH {_CURRENT} SELECT patient_id, location_id FROM cur")
def _(t):
    return pg.current_location(t.adt, ["admission", "transfer"], ["discharge"])


# ---- scores and ranges

_INFANT = """
CASE WHEN heart_rate IS NULL THEN 0 WHEN heart_rate <= 79 THEN 3 WHEN heart_rate BETWEEN 80 AND 99 THEN 1 WHEN heart_rate BETWEEN 100 AND 159 THEN 0 WHEN heart_rate BETWEEN 160 AND 174 THEN 1 WHEN heart_rate >= 175 THEN 3 ELSE 0 END
+ CASE WHEN respiratory_rate IS NULL THEN 0 WHEN respiratory_rate <= 25 OR respiratory_rate >= 80 THEN 3 WHEN respiratory_rate BETWEEN 30 AND 59 THEN 0 WHEN respiratory_rate BETWEEN 26 AND 29 OR respiratory_rate BETWEEN 60 AND 79 THEN 1 ELSE 0 END
+ CASE WHEN temperature_c IS NULL THEN 0 WHEN temperature_c <= 36 OR temperature_c >= 38 THEN 3 WHEN temperature_c BETWEEN 36 AND 36.5 OR temperature_c BETWEEN 37.5 AND 37.9 THEN 1 ELSE 0 END
+ CASE WHEN o2_sat IS NULL THEN 0 WHEN o2_sat <= 89 THEN 3 WHEN o2_sat BETWEEN 90 AND 94 THEN 1 ELSE 0 END
+ CASE WHEN glucose IS NULL THEN 0 WHEN glucose < 2.6 OR glucose > 8.3 THEN 3 ELSE 0 END
"""
_MATERNAL = """
CASE WHEN bp_systolic <= 79 THEN 3 WHEN bp_systolic > 139 AND bp_systolic < 160 THEN 1 WHEN bp_systolic >= 160 THEN 3 ELSE 0 END
+ CASE WHEN bp_diastolic <= 50 THEN 3 WHEN bp_diastolic > 89 AND bp_diastolic < 110 THEN 1 WHEN bp_diastolic >= 110 THEN 3 ELSE 0 END
+ CASE WHEN heart_rate <= 39 THEN 3 WHEN heart_rate < 50 THEN 2 WHEN heart_rate > 119 AND heart_rate < 131 THEN 2 WHEN heart_rate >= 131 THEN 3 ELSE 0 END
+ CASE WHEN respiratory_rate < 12 THEN 2 WHEN respiratory_rate > 26 THEN 2 ELSE 0 END
+ CASE WHEN temperature_c <= 34.9 OR temperature_c >= 40 THEN 3 WHEN temperature_c BETWEEN 38 AND 38.2 THEN 1 WHEN temperature_c > 38.2 AND temperature_c < 40 THEN 2 ELSE 0 END
+ CASE WHEN o2_sat <= 93 THEN 3 WHEN o2_sat < 96 THEN 2 ELSE 0 END
+ CASE WHEN fhr <= 109 OR fhr >= 161 THEN 3 ELSE 0 END + CASE WHEN fhr_second <= 109 OR fhr_second >= 161 THEN 3 ELSE 0 END
"""


def _label(total: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 'Normal' WHEN {total} = 1 THEN 'Prompt' WHEN {total} = 2 THEN 'Urgent' ELSE 'STAT' END"


@query("vitals_priority", f"""
WITH s AS (SELECT event_id, {_INFANT} AS infant, {_MATERNAL} AS maternal FROM vitals)
SELECT event_id, infant AS infant_total, {_label('infant')} AS infant_priority, maternal AS maternal_total, {_label('maternal')} AS maternal_priority FROM s
""")
def _(t):
    totals = t.vitals.select("event_id", sc.vitals_total("infant").alias("infant_total"), sc.vitals_total("maternal").alias("maternal_total"))
    return totals.select(
        "event_id", "infant_total", sc.priority_label(F.col("infant_total")).alias("infant_priority"),
        "maternal_total", sc.priority_label(F.col("maternal_total")).alias("maternal_priority"),
    )


def range_sql(value: str, bounds) -> str:
    al, cl_, nl, nh, ch, ah = bounds
    tests = [
        (al, f"{value} < {al}", "below_absolute"), (ah, f"{value} > {ah}", "above_absolute"), (cl_, f"{value} <= {cl_}", "critical_low"),
        (ch, f"{value} >= {ch}", "critical_high"), (nl, f"{value} < {nl}", "low"), (nh, f"{value} > {nh}", "high"),
    ]
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for bound, test, name in tests if bound is not None) + " ELSE 'normal' END"


_VITAL_CONCEPTS = {"pulse": 1, "temperature": 2, "respiratory_rate": 3, "oxygen_saturation": 4, "systolic_blood_pressure": 5}
# Vitals as observations of events: concept and value columns per vital.
_VOBS = {1: "heart_rate", 2: "temperature_c", 3: "respiratory_rate", 4: "o2_sat", 5: "bp_systolic"}


def _chain(condition: str) -> str:
    parts = [
        f"WHEN concept_id = {_VITAL_CONCEPTS[v]} THEN {range_sql('value_numeric', bounds)}"
        for v, c, *bounds in rg.VITAL_RANGES if c == condition and v in _VITAL_CONCEPTS
    ]
    return f"CASE {' '.join(parts)} END"


@query("flag_reference_range", "WITH vo AS (" + " UNION ALL ".join(
    f"SELECT event_id * 10 + {c} AS obs_id, user_id AS person_id, {c} AS concept_id, CAST({col} AS DOUBLE) AS value_numeric, ts AS obs_datetime FROM vitals" for c, col in _VOBS.items()
) + f"""),
ante AS (SELECT DISTINCT vo.obs_id FROM vo JOIN patient_program p ON p.patient_id = vo.person_id AND NOT p.voided JOIN patient_state s ON s.patient_program_id = p.patient_program_id AND NOT s.voided AND s.state = 2
  AND CAST(obs_datetime AS DATE) >= CAST(s.start_date AS DATE) AND (s.end_date IS NULL OR CAST(obs_datetime AS DATE) <= CAST(s.end_date AS DATE))),
j AS (SELECT vo.*, birthdate, ante.obs_id IS NOT NULL AS is_ante FROM vo JOIN person ON vo.person_id = person.person_id LEFT JOIN ante ON vo.obs_id = ante.obs_id)
SELECT obs_id, CASE WHEN value_numeric IS NOT NULL AND date_diff('day', CAST(birthdate AS DATE), CAST(obs_datetime AS DATE)) >= 0 AND date_diff('day', CAST(birthdate AS DATE), CAST(obs_datetime AS DATE)) < 30 THEN {_chain('newborn')} END AS newborn_flag,
  CASE WHEN value_numeric IS NOT NULL AND is_ante THEN {_chain('antenatal')} END AS antenatal_flag FROM j
""")
def _(t):
    # Stack the vitals of one row in the same pass instead of scanning once per vital.
    cells = [
        F.struct(F.lit(c).alias("concept_id"), F.col(col).cast("double").alias("value_numeric")) for c, col in _VOBS.items()
    ]
    obs = t.vitals.select(
        F.col("user_id").alias("person_id"), F.col("ts").alias("obs_datetime"), "event_id", F.inline(F.array(*cells))
    ).withColumn("obs_id", F.col("event_id") * 10 + F.col("concept_id"))
    inside = pg.in_state_at(obs, t.patient_state, t.patient_program, 2, dt.moment(NOW), unit="day").withColumn("_ante", F.lit(True))
    rows = obs.join(t.person.select("person_id", "birthdate"), "person_id").join(inside, "obs_id", "left")
    flagged = rg.flag_reference_range(rows, _VITAL_CONCEPTS, {
        "newborn": rg.newborn(F.col("birthdate"), F.col("obs_datetime")),
        "antenatal": F.coalesce(F.col("_ante"), F.lit(False)),
    })
    return flagged.select("obs_id", "newborn_flag", "antenatal_flag")


@query("bmi", f"""
WITH {latest_cte('value_numeric', 'visit_id', 'pobs', name='n')}
SELECT w.visit_id, CASE WHEN h.value_numeric > 0 THEN round(w.value_numeric / ((h.value_numeric * 4 / 100) * (h.value_numeric * 4 / 100)), 1) END AS bmi
FROM (SELECT DISTINCT visit_id FROM pobs WHERE NOT voided AND concept_id IN (1, 2)) v LEFT JOIN n w ON v.visit_id = w.visit_id AND w.concept_id = 1 LEFT JOIN n h ON v.visit_id = h.visit_id AND h.concept_id = 2
WHERE w.visit_id IS NOT NULL
""")
def _(t):
    rows = ob.collect_obs(not_voided(t.pobs), "visit_id", [ob.number("weight", 1), ob.number("height", 2)])
    bmi = cl.body_mass_index(F.col("weight"), F.col("height") * 4)
    return rows.filter(F.col("weight").isNotNull()).select("visit_id", bmi.alias("bmi"))


def _group_sql(fields: tuple[str, ...]) -> str:
    keys = ", ".join(fields)
    present = " AND ".join(f"{f} IS NOT NULL" for f in fields)
    same = " AND ".join(f"s.{f} = g.{f}" for f in fields)
    score = " + ".join(f"CASE WHEN s.{f} = a.{f} THEN {w} ELSE 0 END" for f, w in rg.SIMILARITY_WEIGHTS.items())
    return (
        f"SELECT g.anchor AS anchor_id, s.person_id, '{'+'.join(fields)}' AS agreed_on, {score} AS score FROM "
        f"(SELECT {keys}, min(person_id) AS anchor FROM lookalike WHERE {present} GROUP BY {keys} HAVING count(*) > 1) g "
        f"JOIN lookalike s ON {same} JOIN lookalike a ON a.person_id = g.anchor WHERE s.person_id <> g.anchor"
    )


@query("similar_patients", _group_sql(("phone",)) + " UNION ALL " + _group_sql(("village", "section", "mothers_first_name")))
def _(t):
    return rg.similar_patients(t.lookalike)


# ---- dashboards

_ENROLLED = """
pp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY date_enrolled DESC, patient_program_id DESC) AS rn FROM patient_program WHERE NOT voided AND program_id = 1) WHERE rn = 1)
"""
_IN = "CAST({at} AS DATE) >= CAST(pp.date_enrolled AS DATE) AND (pp.date_completed IS NULL OR CAST({at} AS DATE) <= CAST(pp.date_completed AS DATE))"


@query("obs_by_encounter", f"""
WITH {_ENROLLED}, w AS (SELECT encounter_id, max(CASE WHEN concept_id = 201 THEN value_numeric END) AS weight, max(CASE WHEN concept_id = 203 THEN value_coded END) AS answer
  FROM eobs WHERE NOT voided AND concept_id IN (201, 203) GROUP BY encounter_id),
r AS (SELECT e.patient_id, e.encounter_id, e.encounter_datetime, weight, answer, row_number() OVER (PARTITION BY e.patient_id ORDER BY e.encounter_datetime DESC, e.encounter_id DESC) AS rank
  FROM adt e JOIN pp ON e.patient_id = pp.patient_id AND {_IN.format(at='e.encounter_datetime')} JOIN w ON e.encounter_id = w.encounter_id WHERE NOT e.voided)
SELECT patient_id, encounter_id, encounter_datetime, weight, answer, rank FROM r WHERE rank <= 5
""")
def _(t):
    wants = [ob.number("weight", 201), ob.coded("answer", 203)]
    rows = db.obs_by_encounter(t.eobs, t.adt, t.patient_program, 1, wants, 5, dt.moment(NOW))
    return rows.withColumn("rank", F.col("rank").cast("long"))


@query("obs_series", f"""
WITH {_ENROLLED}, r AS (SELECT person_id AS patient_id, obs_id, obs_datetime, value_numeric, row_number() OVER (PARTITION BY person_id ORDER BY obs_datetime DESC, obs_id DESC) AS n
  FROM eobs o JOIN pp ON o.person_id = pp.patient_id AND {_IN.format(at='o.obs_datetime')} WHERE NOT o.voided AND concept_id = 201 AND value_numeric IS NOT NULL)
SELECT patient_id, obs_id, obs_datetime, value_numeric FROM r WHERE n <= 100
""")
def _(t):
    return db.obs_series(t.eobs, t.patient_program, 1, 201, dt.moment(NOW))


@query("discrete_values", f"""
WITH {_ENROLLED}, o AS (SELECT e.* FROM eobs e JOIN pp ON e.person_id = pp.patient_id AND {_IN.format(at='e.obs_datetime')} WHERE NOT e.voided)
SELECT person_id AS patient_id, arg_max(value_numeric, (obs_datetime, obs_id)) FILTER (WHERE concept_id = 201 AND value_numeric IS NOT NULL) AS score,
  arg_max(value_coded, (obs_datetime, obs_id)) FILTER (WHERE concept_id = 203 AND value_coded IS NOT NULL) AS answer,
  arg_max(value_datetime, (obs_datetime, obs_id)) FILTER (WHERE concept_id = 202 AND value_datetime IS NOT NULL) AS due FROM o WHERE concept_id IN (201, 202, 203) GROUP BY person_id
""")
def _(t):
    wants = [ob.number("score", 201), ob.coded("answer", 203), ob.when("due", 202)]
    return db.discrete_values(t.eobs, t.adt, t.patient_program, 1, wants, dt.moment(NOW))


@query("recent_results", """
SELECT person_id, obs_id, rank FROM (SELECT person_id, obs_id, row_number() OVER (PARTITION BY person_id ORDER BY obs_datetime DESC, obs_id DESC) AS rank FROM pobs WHERE NOT voided) WHERE rank <= 5
""")
def _(t):
    return db.recent_results(t.pobs, "person_id", 5).select("person_id", "obs_id", F.col("rank").cast("long").alias("rank"))


@query("recent_dispenses", """
SELECT medication_dispense_id, patient_id FROM (SELECT *, dense_rank() OVER (PARTITION BY patient_id ORDER BY CAST(date_created AS DATE) DESC) AS r FROM dispense WHERE NOT voided) WHERE r <= 5
""")
def _(t):
    return db.recent_dispenses(t.dispense, "patient_id", "date_created", 5).select("medication_dispense_id", "patient_id")


@query("enrolment_history", """
SELECT patient_program_id, patient_id, date_enrolled, date_completed FROM patient_program WHERE NOT voided AND program_id = 1 AND date_completed IS NOT NULL
""")
def _(t):
    return db.enrolment_history(t.patient_program, 1).select("patient_program_id", "patient_id", "date_enrolled", "date_completed")


@query("doses_received", """
SELECT person_id, count(*) FILTER (WHERE concept_id = 5) AS bcg_doses, max(CASE WHEN concept_id = 5 THEN obs_datetime END) AS bcg_latest,
  count(*) FILTER (WHERE concept_id = 6) AS polio_doses, max(CASE WHEN concept_id = 6 THEN obs_datetime END) AS polio_latest FROM pobs WHERE NOT voided AND concept_id IN (5, 6) GROUP BY person_id
""")
def _(t):
    return db.doses_received(t.pobs, "person_id", {"bcg": 5, "polio": 6})


DELIVERY_CODES = {
    "delivery_datetime": 301, "delivery_type": 302, "birth_outcome": 303, "live_birth": 321, "baby_construct": 300, "baby_link": 304,
}


@query("delivery_status", f"""
WITH {_CURRENT}, {_ENROLLED},
ld AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY e.patient_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS rn FROM adt e LEFT JOIN pp ON e.patient_id = pp.patient_id
  WHERE NOT e.voided AND encounter_type = 'delivery' AND (pp.date_enrolled IS NULL OR encounter_datetime >= pp.date_enrolled)) WHERE rn = 1),
o AS (SELECT eobs.*, ld.patient_id FROM eobs JOIN ld ON eobs.encounter_id = ld.encounter_id WHERE NOT eobs.voided),
f AS (SELECT patient_id, arg_max(value_datetime, (obs_datetime, obs_id)) FILTER (WHERE o.concept_id = 301 AND value_datetime IS NOT NULL) AS born,
  string_agg(DISTINCT CASE WHEN o.concept_id = 302 THEN label END, ', ' ORDER BY CASE WHEN o.concept_id = 302 THEN label END) AS delivery_type,
  count(*) FILTER (WHERE o.concept_id = 303 AND value_coded = 321) AS number_babies FROM o LEFT JOIN label_en l ON value_coded = l.concept_id GROUP BY patient_id),
c AS (SELECT patient_id, obs_id, row_number() OVER (PARTITION BY patient_id ORDER BY obs_id) AS n FROM o WHERE concept_id = 300),
ids AS (SELECT * FROM (SELECT patient_id, identifier, row_number() OVER (PARTITION BY patient_id ORDER BY preferred DESC, patient_identifier_id) AS r FROM patient_identifier WHERE NOT voided AND identifier_type = 2) WHERE r = 1),
b AS (SELECT c.patient_id, c.n, k.comments AS uuid, ids.identifier, w.name AS ward FROM c JOIN o k ON k.obs_group_id = c.obs_id AND k.concept_id = 304 LEFT JOIN person p ON p.uuid = k.comments
  LEFT JOIN ids ON ids.patient_id = p.person_id LEFT JOIN cur ON cur.patient_id = p.person_id LEFT JOIN location w ON w.location_id = cur.location_id WHERE n <= 3),
bb AS (SELECT patient_id, """ + ", ".join(f"max(CASE WHEN n = {i} THEN {c} END) AS baby{i}_{c}" for i in (1, 2, 3) for c in ("uuid", "identifier", "ward")) + """ FROM b GROUP BY patient_id)
SELECT x.patient_id, strftime(born, '%-d %b %Y') AS delivery_date, strftime(born, '%I:%M %p') AS delivery_time, CASE WHEN born IS NULL THEN 0 ELSE 1 END AS were_there_deliveries,
  coalesce(number_babies, 0) AS number_babies, delivery_type, """ + ", ".join(
    f"baby{i}_uuid, baby{i}_identifier, baby{i}_ward, CASE WHEN baby{i}_identifier IS NULL THEN 0 ELSE 1 END AS baby{i}_exists" for i in (1, 2, 3)
) + """ FROM (SELECT person_id AS patient_id FROM person) x LEFT JOIN f ON x.patient_id = f.patient_id LEFT JOIN bb ON x.patient_id = bb.patient_id
""")
def _(t):
    from wardline.operators.dictionary import patient_identifiers

    ids = patient_identifiers(t.patient_identifier, {"identifier": 2}).withColumnRenamed("patient_id", "person_id")
    here = pg.current_location(t.adt, ["admission", "transfer"], ["discharge"]).join(
        t.location.select("location_id", F.col("name").alias("ward")), "location_id"
    ).select(F.col("patient_id").alias("person_id"), "ward")
    return db.delivery_status(
        t.person.select(F.col("person_id").alias("patient_id")), t.patient_program, t.adt, t.eobs, t.person, ids, here,
        english(t), DELIVERY_CODES, 1, ["delivery"],
    )
