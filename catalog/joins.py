"""Joins, aggregates, ranks and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import NOW, english, query
from wardline.functions.dates import moment
from wardline.operators import aggregates as ag
from wardline.operators import intervals as iv
from wardline.operators import ranking as rk
from wardline.operators import sweeps as sw
from wardline.operators.filters import not_voided
from wardline.operators.observations import first_by_preference, with_labels


@query("inner_equi", """
SELECT o.encounter_id, o.location_id, CASE WHEN v.visit_id IS NULL THEN o.encounter_datetime ELSE v.date_started END AS started
FROM encounter o LEFT JOIN (SELECT * FROM visit WHERE date_stopped IS NOT NULL) v ON o.visit_id = v.visit_id
""")
def _(t):
    rows = t.encounter.select("encounter_id", "visit_id", "location_id", F.col("encounter_datetime").alias("started"))
    closed = t.visit.filter(F.col("date_stopped").isNotNull())
    return iv.update_from(rows, closed, ["visit_id"], {"started": "date_started"}).select("encounter_id", "location_id", "started")


@query("left_outer", """
SELECT e.encounter_id, o.order_id FROM encounter e LEFT JOIN (SELECT * FROM orders_placed WHERE NOT voided AND concept_id = 7) o ON e.encounter_id = o.encounter_id
""")
def _(t):
    placed = not_voided(t.orders_placed).filter(F.col("concept_id") == 7).select("encounter_id", "order_id")
    return t.encounter.select("encounter_id").join(placed, "encounter_id", "left")


@query("semi_exists", """
SELECT visit_id, patient_id FROM visit v WHERE EXISTS (SELECT 1 FROM encounter e WHERE e.visit_id = v.visit_id AND e.location_id IN (1, 2, 3))
""")
def _(t):
    seen = t.encounter.filter(F.col("location_id").isin(1, 2, 3)).select("visit_id")
    return t.visit.join(seen, "visit_id", "left_semi").select("visit_id", "patient_id")


@query("anti_theta", """
SELECT e.encounter_id, e.patient_id, e.location_id FROM adt e WHERE NOT e.voided AND e.encounter_type IN ('admission', 'transfer') AND NOT EXISTS (
  SELECT 1 FROM adt e2 WHERE NOT e2.voided AND e2.patient_id = e.patient_id AND e2.encounter_datetime > e.encounter_datetime
  AND (e2.encounter_type = 'discharge' OR (e2.encounter_type IN ('admission', 'transfer') AND e2.location_id <> e.location_id)))
""")
def _(t):
    live = not_voided(t.adt).filter(F.col("encounter_type").isin("admission", "transfer", "discharge"))
    enter = live.filter(F.col("encounter_type") != "discharge")
    kept = iv.no_later(
        enter, live, "patient_id", "encounter_datetime", "encounter_datetime",
        elsewhere="location_id", leave=F.col("encounter_type") == "discharge",
    )
    return kept.select("encounter_id", "patient_id", "location_id")


@query("anti_equi", """
SELECT b.bed_id, m.location_id FROM bed b JOIN bed_location_map m ON b.bed_id = m.bed_id WHERE NOT b.voided AND NOT EXISTS (
  SELECT 1 FROM bed_patient_assignment_map a WHERE a.bed_id = b.bed_id AND NOT a.voided AND a.date_stopped IS NULL)
""")
def _(t):
    taken = not_voided(t.bed_patient_assignment_map).filter(F.col("date_stopped").isNull()).select("bed_id")
    return not_voided(t.bed).join(t.bed_location_map, "bed_id").join(taken, "bed_id", "left_anti").select("bed_id", "location_id")


@query("self_group", """
SELECT c.obs_id, p.concept_id AS parent_concept, c.concept_id FROM tobs c JOIN tobs p ON c.obs_group_id = p.obs_id
""")
def _(t):
    parents = t.tobs.select(F.col("obs_id").alias("obs_group_id"), F.col("concept_id").alias("parent_concept"))
    return t.tobs.join(parents, "obs_group_id").select("obs_id", "parent_concept", "concept_id")


@query("or_join", """
WITH dx AS (SELECT obs_id, obs_group_id FROM obs WHERE concept_id = 3 AND NOT voided)
SELECT t.obs_id AS left_id, o.obs_id AS right_id FROM dx t JOIN (SELECT * FROM obs WHERE NOT voided) o ON t.obs_group_id = o.obs_group_id
UNION SELECT t.obs_id, o.obs_id FROM dx t JOIN (SELECT * FROM obs WHERE NOT voided) o ON t.obs_id = o.obs_id
""")
def _(t):
    live = not_voided(t.obs).select("obs_id", "obs_group_id", "concept_id")
    dx = live.filter(F.col("concept_id") == 3)
    return iv.or_join(dx, live, ("obs_group_id", "obs_group_id"), ("obs_id", "obs_id"), "obs_id", "obs_id")


@query("asof_backward", """
WITH pts AS (SELECT obs_id, person_id, obs_datetime FROM pobs),
a AS (SELECT e.obs_id, v.visit_id FROM pts e ASOF LEFT JOIN visit v ON e.person_id = v.patient_id AND e.obs_datetime >= v.date_started),
d AS (SELECT e.obs_id, v.visit_id FROM pts e ASOF LEFT JOIN visit v ON e.person_id = v.patient_id AND date_trunc('day', e.obs_datetime) + INTERVAL 1 DAY > v.date_started)
SELECT 'timestamp' AS grain, obs_id, visit_id FROM a UNION ALL SELECT 'day', obs_id, visit_id FROM d
""")
def _(t):
    events = t.pobs.select("obs_id", F.col("person_id").alias("patient_id"), F.col("obs_datetime").alias("event_at"))
    out = None
    for grain in ("timestamp", "day"):
        part = iv.visit_of_event(events, t.visit, grain=grain).select(F.lit(grain).alias("grain"), "obs_id", "visit_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("interval_contains", """
WITH c AS (SELECT * FROM visit WHERE date_stopped IS NOT NULL),
pts AS (SELECT obs_id, person_id, obs_datetime + INTERVAL 18 HOUR AS event_at FROM pobs),
i AS (SELECT * FROM (SELECT e.obs_id, c.visit_id, row_number() OVER (PARTITION BY e.obs_id ORDER BY c.date_stopped DESC, c.visit_id DESC) AS r FROM pts e
  JOIN c ON c.patient_id = e.person_id AND c.date_started <= e.event_at AND c.date_stopped >= e.event_at) WHERE r = 1),
b AS (SELECT * FROM (SELECT e.obs_id, c.visit_id, row_number() OVER (PARTITION BY e.obs_id ORDER BY c.date_stopped DESC, c.visit_id DESC) AS r FROM pts e
  JOIN c ON c.patient_id = e.person_id AND CAST(c.date_stopped AS DATE) = CAST(e.event_at AS DATE) AND c.date_stopped < e.event_at) WHERE r = 1)
SELECT e.obs_id, coalesce(i.visit_id, b.visit_id) AS visit_id FROM pts e LEFT JOIN i ON e.obs_id = i.obs_id LEFT JOIN b ON e.obs_id = b.obs_id
""")
def _(t):
    events = t.pobs.select(
        "obs_id", F.col("person_id").alias("patient_id"), (F.col("obs_datetime") + F.expr("INTERVAL '18' HOUR")).alias("event_at")
    )
    return iv.interval_contains(events, t.visit, "patient_id", "event_at").select("obs_id", "visit_id")


@query("enrolment_window", """
SELECT p.patient_program_id, e.encounter_id FROM patient_program p JOIN adt e ON e.patient_id = p.patient_id
AND CAST(e.encounter_datetime AS DATE) >= CAST(p.date_enrolled AS DATE) AND (p.date_completed IS NULL OR CAST(e.encounter_datetime AS DATE) <= CAST(p.date_completed AS DATE))
WHERE e.encounter_type = 'vitals' AND NOT e.voided AND NOT p.voided
""")
def _(t):
    enc = not_voided(t.adt).filter(F.col("encounter_type") == "vitals").select("patient_id", "encounter_id", "encounter_datetime")
    spans = not_voided(t.patient_program).select("patient_id", "patient_program_id", "date_enrolled", "date_completed")
    return iv.enrolment_window(spans, enc, moment(NOW), unit="day").select("patient_program_id", "encounter_id")


@query("enrolment_of_encounter", """
WITH m AS (SELECT e.encounter_id, p.patient_program_id, row_number() OVER (PARTITION BY e.encounter_id ORDER BY p.date_enrolled DESC, p.patient_program_id DESC) AS r
  FROM patient_program p JOIN adt e ON e.patient_id = p.patient_id AND CAST(e.encounter_datetime AS DATE) >= CAST(p.date_enrolled AS DATE)
  AND (p.date_completed IS NULL OR CAST(e.encounter_datetime AS DATE) <= CAST(p.date_completed AS DATE)) WHERE NOT p.voided AND program_id = 1)
SELECT e.encounter_id, m.patient_program_id FROM adt e LEFT JOIN (SELECT * FROM m WHERE r = 1) m ON e.encounter_id = m.encounter_id
""")
def _(t):
    spans = not_voided(t.patient_program).filter(F.col("program_id") == 1).select("patient_id", "patient_program_id", "date_enrolled", "date_completed")
    return iv.enrolment_of_encounter(t.adt, spans, moment(NOW), unit="day").select("encounter_id", "patient_program_id")


@query("exact_time_join", """
SELECT v.visit_id, e.encounter_id FROM visit v JOIN encounter e ON e.patient_id = v.patient_id AND e.encounter_datetime = v.date_started
""")
def _(t):
    visits = t.visit.select("visit_id", "patient_id", "date_started")
    return iv.exact_time_join(visits, t.encounter, "patient_id", "date_started", "encounter_datetime", ["encounter_id"]).select("visit_id", "encounter_id")


_ONE_NAME = """
names AS (SELECT person_id, concat_ws(' ', given_name, family_name) AS called FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY preferred DESC, date_created DESC, person_name_id) AS r
  FROM person_name WHERE NOT voided) WHERE r = 1)
"""


@query("relationship_join", f"""
WITH {_ONE_NAME}, l AS (SELECT person_b, string_agg(DISTINCT called, ', ' ORDER BY called) AS workers FROM relationship JOIN names ON person_a = person_id
  WHERE NOT voided AND relationship = 1 GROUP BY person_b)
SELECT patient_program_id, workers FROM patient_program LEFT JOIN l ON patient_id = person_b
""")
def _(t):
    from wardline.operators.dictionary import preferred_name

    return iv.relationship_join(t.patient_program, t.relationship, preferred_name(t.person_name), 1, "workers").select("patient_program_id", "workers")


@query("uuid_text_join", "SELECT o.obs_id, p.person_id AS other_person_id FROM eobs o JOIN person p ON o.comments = p.uuid")
def _(t):
    return iv.uuid_text_join(t.eobs, t.person).select("obs_id", "other_person_id")


@query("hash_agg", """
SELECT patient_id, count(*) AS n, min(encounter_datetime) AS first_visit, max(encounter_datetime) AS last_visit FROM encounter WHERE NOT voided GROUP BY patient_id
""")
def _(t):
    return not_voided(t.encounter).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("encounter_datetime").alias("first_visit"), F.max("encounter_datetime").alias("last_visit")
    )


@query("conditional_counts", """
SELECT location_id, count(*) FILTER (WHERE encounter_type = 'admission') AS admissions, count(*) FILTER (WHERE encounter_type = 'transfer') AS transfers,
  count(*) FILTER (WHERE encounter_type = 'discharge') AS discharges FROM adt WHERE NOT voided GROUP BY location_id
""")
def _(t):
    kind = F.col("encounter_type")
    return ag.conditional_counts(not_voided(t.adt), ["location_id"], {
        "admissions": kind == "admission", "transfers": kind == "transfer", "discharges": kind == "discharge",
    })


@query("group_by_derived", """
SELECT CASE WHEN location_id IN (8, 9) THEN 'Theatre' WHEN location_id = 2 AND bed_number ILIKE '%inborn%' THEN 'Nursery inborn' WHEN location_id = 2 THEN 'Nursery other' ELSE 'Ward ' || CAST(location_id AS VARCHAR) END AS ward,
  count(*) AS beds FROM bed_location_map m JOIN bed b ON m.bed_id = b.bed_id GROUP BY 1
""")
def _(t):
    rows = t.bed_location_map.join(t.bed, "bed_id")
    place = F.col("location_id")
    cases = [
        (place.isin(8, 9), F.lit("Theatre")),
        ((place == 2) & F.col("bed_number").ilike("%inborn%"), F.lit("Nursery inborn")),
        (place == 2, F.lit("Nursery other")),
    ]
    otherwise = F.concat(F.lit("Ward "), place.cast("string"))
    return ag.group_by_case(rows, cases, otherwise, "ward", [F.count(F.lit(1)).alias("beds")])


@query("count_distinct_rows", "SELECT DISTINCT concept_id, value_coded FROM obs WHERE NOT voided")
def _(t):
    return not_voided(t.obs).select("concept_id", "value_coded").distinct()


@query("string_agg", """
SELECT encounter_id, string_agg(label, ',' ORDER BY obs_id, label) AS plain, string_agg(label, ' | ' ORDER BY obs_id, label) AS spaced
FROM obs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id = 3 GROUP BY encounter_id
""")
def _(t):
    rows = with_labels(not_voided(t.obs).filter(F.col("concept_id") == 3), english(t))
    return ag.string_agg(rows, ["encounter_id"], "label", "obs_id", "plain", ",").join(
        ag.string_agg(rows, ["encounter_id"], "label", "obs_id", "spaced", " | "), "encounter_id"
    )


@query("total_row", """
SELECT CASE WHEN grouping(location_id) = 1 THEN 'Total' ELSE CAST(location_id AS VARCHAR) END AS ward, CAST(sum(CASE WHEN encounter_type = 'admission' THEN 1 ELSE 0 END) AS BIGINT) AS admissions,
  CAST(sum(CASE WHEN encounter_type = 'discharge' THEN 1 ELSE 0 END) AS BIGINT) AS discharges FROM adt GROUP BY ROLLUP (location_id)
""")
def _(t):
    rows = t.adt.select(
        F.col("location_id").cast("string").alias("ward"),
        (F.col("encounter_type") == "admission").cast("int").alias("admissions"),
        (F.col("encounter_type") == "discharge").cast("int").alias("discharges"),
    )
    return ag.total_row(rows, "ward", ["admissions", "discharges"])


@query("scaffold_zero_fill", """
WITH c AS (SELECT l.name AS ward, count(*) AS admissions FROM adt a JOIN location l ON a.location_id = l.location_id WHERE encounter_type = 'admission' GROUP BY 1),
f AS (SELECT name AS ward, coalesce(admissions, 0) AS admissions FROM location LEFT JOIN c ON name = ward)
SELECT * FROM f WHERE NOT (admissions = 0 AND ward IN ('NATION_20', 'NATION_21', 'NATION_1'))
""")
def _(t):
    wards = t.location.select("location_id", F.col("name").alias("ward"))
    counts = t.adt.filter(F.col("encounter_type") == "admission").join(wards, "location_id").groupBy("ward").agg(F.count(F.lit(1)).alias("admissions"))
    return ag.scaffold_zero_fill(wards.select("ward"), counts, "ward", ["admissions"], ["NATION_20", "NATION_21", "NATION_1"])


@query("presence_flag_max", """
SELECT person_id, bool_or(CASE WHEN concept_id = 2 THEN TRUE END) AS ever_missed, bool_or(CASE WHEN concept_id = 3 AND value_coded = 4 THEN TRUE END) AS heart FROM pobs WHERE NOT voided GROUP BY person_id
""")
def _(t):
    q = F.col("concept_id")
    return ag.presence_flags(not_voided(t.pobs), ["person_id"], {"ever_missed": q == 2, "heart": (q == 3) & (F.col("value_coded") == 4)})


@query("row_number_by", """
SELECT encounter_id, visit_id, row_number() OVER (PARTITION BY visit_id ORDER BY encounter_datetime, encounter_id) AS index_asc FROM encounter
""")
def _(t):
    return sw.number_rows(t.encounter, ["visit_id"], "encounter_datetime", ["encounter_id"], desc=None).select("encounter_id", "visit_id", "index_asc")


@query("user_var_rank", """
SELECT obs_id, row_number() OVER (PARTITION BY person_id, encounter_id ORDER BY obs_datetime, obs_group_id NULLS FIRST, obs_id) AS rank FROM pobs WHERE NOT voided AND concept_id = 3
""")
def _(t):
    rows = not_voided(t.pobs).filter(F.col("concept_id") == 3)
    return sw.number_rows(rows, ["person_id", "encounter_id"], "obs_datetime", ["obs_group_id", "obs_id"], "rank", None).select("obs_id", "rank")


@query("index_asc_desc", """
SELECT encounter_id, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime, encounter_id) AS index_asc,
  row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS index_desc FROM encounter
UNION ALL SELECT -encounter_id, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime, encounter_id),
  row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime DESC, encounter_id DESC) FROM adt
""")
def _(t):
    orders = sw.number_rows(t.encounter, ["patient_id"], "encounter_datetime", ["encounter_id"])
    events = sw.number_rows(t.adt, ["patient_id"], "encounter_datetime", ["encounter_id"])
    return orders.select("encounter_id", "index_asc", "index_desc").unionByName(
        events.select((-F.col("encounter_id")).alias("encounter_id"), "index_asc", "index_desc")
    )


@query("pivot_ranked", """
WITH r AS (SELECT visit_id, label, value_numeric, row_number() OVER (PARTITION BY visit_id ORDER BY obs_id, obs_datetime) AS n FROM pobs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided)
SELECT visit_id, """ + ", ".join(f"max(CASE WHEN n = {i} THEN label END) AS test_{i}, max(CASE WHEN n = {i} THEN value_numeric END) AS result_{i}" for i in range(1, 17)) + """
FROM r WHERE n <= 16 GROUP BY visit_id
""")
def _(t):
    rows = with_labels(not_voided(t.pobs), english(t))
    return rk.pivot_ranked(rows, ["visit_id"], ["obs_id", "obs_datetime"], {"test": "label", "result": "value_numeric"}, 16)


@query("latest_previous_baseline", """
WITH r AS (SELECT person_id, value_numeric, obs_datetime, row_number() OVER (PARTITION BY person_id ORDER BY obs_datetime DESC, obs_id DESC) AS d,
  row_number() OVER (PARTITION BY person_id ORDER BY obs_datetime, obs_id) AS a FROM pobs WHERE NOT voided AND concept_id = 1 AND value_numeric IS NOT NULL)
SELECT person_id, max(CASE WHEN d = 1 THEN value_numeric END) AS latest_value_numeric, max(CASE WHEN d = 1 THEN obs_datetime END) AS latest_obs_datetime,
  max(CASE WHEN d = 2 THEN value_numeric END) AS previous_value_numeric, max(CASE WHEN d = 2 THEN obs_datetime END) AS previous_obs_datetime,
  max(CASE WHEN a = 1 THEN value_numeric END) AS baseline_value_numeric, max(CASE WHEN a = 1 THEN obs_datetime END) AS baseline_obs_datetime FROM r GROUP BY person_id
""")
def _(t):
    rows = not_voided(t.pobs).filter((F.col("concept_id") == 1) & F.col("value_numeric").isNotNull())
    return rk.latest_previous_baseline(rows, ["person_id"], ["obs_datetime", "obs_id"], ["value_numeric", "obs_datetime"])


@query("latest_per_key", """
SELECT patient_id, encounter_id, location_id FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS r FROM encounter WHERE NOT voided) WHERE r = 1
""")
def _(t):
    return rk.latest_per_key(not_voided(t.encounter), ["patient_id"], ["encounter_datetime", "encounter_id"], ["encounter_id", "location_id"])


@query("adjacent_duplicates", """
WITH p AS (SELECT *, lag(date_created) OVER w AS pd, lag(dispenser) OVER w AS p1, lag(concept) OVER w AS p2, lag(drug_id) OVER w AS p3 FROM dispense WHERE NOT voided AND status = 1
  WINDOW w AS (PARTITION BY drug_order_id ORDER BY date_created, medication_dispense_id))
SELECT medication_dispense_id FROM p WHERE dispenser = p1 AND concept = p2 AND drug_id = p3 AND abs(trunc((epoch_us(date_created) - epoch_us(pd)) / 1000000.0)) < 14400
""")
def _(t):
    from wardline.operators.changes import adjacent_duplicates

    rows = not_voided(t.dispense).filter(F.col("status") == 1)
    return adjacent_duplicates(
        rows, ["drug_order_id"], "date_created", "medication_dispense_id", ["dispenser", "concept", "drug_id"], 14400
    ).select("medication_dispense_id")


@query("top_n_per_patient", """
SELECT 'newest 5' AS pick, obs_id FROM (SELECT obs_id, row_number() OVER (PARTITION BY person_id ORDER BY obs_datetime DESC, obs_id DESC) AS r FROM pobs WHERE NOT voided) WHERE r <= 5
UNION ALL SELECT 'newest 2 days', obs_id FROM (SELECT obs_id, dense_rank() OVER (PARTITION BY person_id ORDER BY CAST(obs_datetime AS DATE) DESC) AS r FROM pobs WHERE NOT voided) WHERE r <= 2
""")
def _(t):
    live = not_voided(t.pobs)
    five = rk.first_rows(live, ["person_id"], [F.col("obs_datetime").desc(), F.col("obs_id").desc()], 5)
    days = rk.newest_dates(live, ["person_id"], "obs_datetime", 2)
    return five.select(F.lit("newest 5").alias("pick"), "obs_id").unionByName(days.select(F.lit("newest 2 days").alias("pick"), "obs_id"))


@query("order_output", "SELECT patient_program_id, patient_id, date_enrolled FROM patient_program WHERE NOT voided ORDER BY date_enrolled, patient_program_id")
def _(t):
    return not_voided(t.patient_program).select("patient_program_id", "patient_id", "date_enrolled").orderBy("date_enrolled", "patient_program_id")


@query("field_order", """
WITH r AS (SELECT encounter_id, label, row_number() OVER (PARTITION BY encounter_id ORDER BY CASE value_coded WHEN 8 THEN 1 WHEN 3 THEN 2 WHEN 21 THEN 3 WHEN 30 THEN 4 END, obs_id) AS n
  FROM obs o LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided AND o.concept_id = 3 AND value_coded IN (8, 3, 21, 30)),
v AS (SELECT patient_id, encounter_type, row_number() OVER (PARTITION BY patient_id ORDER BY CASE encounter_type WHEN '3-MEDIUM' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, encounter_datetime, encounter_id) AS n FROM encounter)
SELECT 'answer' AS pick, encounter_id AS id, label AS value FROM r WHERE n = 1 UNION ALL SELECT 'type', patient_id, encounter_type FROM v WHERE n = 1
""")
def _(t):
    typed = first_by_preference(not_voided(t.obs), "encounter_id", 3, [8, 3, 21, 30], english(t), "value")
    kinds = rk.first_by_order_list(t.encounter, ["patient_id"], "encounter_type", ["3-MEDIUM", "1-URGENT"], ["encounter_datetime", "encounter_id"])
    return typed.select(F.lit("answer").alias("pick"), F.col("encounter_id").alias("id"), "value").unionByName(
        kinds.select(F.lit("type").alias("pick"), F.col("patient_id").alias("id"), F.col("encounter_type").alias("value"))
    )


@query("limit_offset", """
WITH r AS (SELECT encounter_id, value_coded, row_number() OVER (PARTITION BY encounter_id ORDER BY obs_id) AS n FROM obs WHERE NOT voided AND concept_id = 3)
SELECT encounter_id, value_coded AS second_answer FROM r WHERE n = 2
""")
def _(t):
    rows = not_voided(t.obs).filter(F.col("concept_id") == 3)
    return rk.nth_row(rows, ["encounter_id"], ["obs_id"], 2).select("encounter_id", F.col("value_coded").alias("second_answer"))


@query("union_distinct", """
SELECT obs_id, encounter_id FROM obs WHERE concept_id = 3 AND value_coded = 4 AND NOT voided
UNION SELECT o.obs_id, o.encounter_id FROM obs o JOIN encounter e ON o.encounter_id = e.encounter_id WHERE o.obs_group_id IS NULL AND NOT o.voided AND e.encounter_type IN ('1-URGENT', '2-HIGH')
""")
def _(t):
    live = not_voided(t.obs)
    one = live.filter((F.col("concept_id") == 3) & (F.col("value_coded") == 4)).select("obs_id", "encounter_id")
    enc = t.encounter.filter(F.col("encounter_type").isin("1-URGENT", "2-HIGH")).select("encounter_id")
    two = live.filter(F.col("obs_group_id").isNull()).join(enc, "encounter_id", "left_semi").select("obs_id", "encounter_id")
    return one.unionByName(two).distinct()


@query("append_sets", """
SELECT obs_id, encounter_id, value_coded, CAST(NULL AS VARCHAR) AS entered, 1 AS coded FROM obs WHERE concept_id = 3 AND NOT voided
UNION ALL SELECT obs_id, encounter_id, NULL, value_text, 0 FROM obs WHERE concept_id = 4 AND NOT voided
""")
def _(t):
    live = not_voided(t.obs)
    coded = live.filter(F.col("concept_id") == 3).select("obs_id", "encounter_id", "value_coded", F.lit(1).alias("coded"))
    free = live.filter(F.col("concept_id") == 4).select("obs_id", "encounter_id", F.col("value_text").alias("entered"), F.lit(0).alias("coded"))
    return ag.append_sets(coded, free)


@query("synthetic_events", """
SELECT encounter_type, location_id, count(*) AS n FROM (
  SELECT encounter_type, location_id FROM adt WHERE NOT voided
  UNION ALL SELECT 'transfer out', prev FROM (SELECT encounter_type, lag(location_id) OVER (PARTITION BY patient_id ORDER BY encounter_datetime, encounter_id) AS prev FROM adt
    WHERE NOT voided AND encounter_type IN ('admission', 'transfer')) WHERE encounter_type = 'transfer' AND prev IS NOT NULL) GROUP BY 1, 2
""")
def _(t):
    from wardline.operators.programs import previous_location

    live = not_voided(t.adt)
    moves = previous_location(live.filter(F.col("encounter_type").isin("admission", "transfer")))
    outs = moves.filter((F.col("encounter_type") == "transfer") & F.col("previous_location").isNotNull()).select(
        F.lit("transfer out").alias("encounter_type"), F.col("previous_location").alias("location_id")
    )
    return live.select("encounter_type", "location_id").unionByName(outs).groupBy("encounter_type", "location_id").agg(F.count(F.lit(1)).alias("n"))


@query("previous_location", """
WITH l AS (SELECT encounter_id, patient_id, location_id, encounter_datetime FROM adt WHERE NOT voided AND encounter_type IN ('admission', 'transfer')),
t AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY encounter_datetime DESC, encounter_id DESC) AS r FROM l)
SELECT 'before' AS rule, encounter_id, lag(location_id) OVER (PARTITION BY patient_id ORDER BY encounter_datetime, encounter_id) AS previous_location FROM l
UNION ALL SELECT 'latest other', l.encounter_id, CASE WHEN l.encounter_id = a.encounter_id THEN b.location_id ELSE a.location_id END FROM l
  LEFT JOIN t a ON l.patient_id = a.patient_id AND a.r = 1 LEFT JOIN t b ON l.patient_id = b.patient_id AND b.r = 2
""")
def _(t):
    from wardline.operators.programs import previous_location

    rows = not_voided(t.adt).filter(F.col("encounter_type").isin("admission", "transfer"))
    before = previous_location(rows).select(F.lit("before").alias("rule"), "encounter_id", "previous_location")
    other = previous_location(rows, quirk=True).select(F.lit("latest other").alias("rule"), "encounter_id", "previous_location")
    return before.unionByName(other)
