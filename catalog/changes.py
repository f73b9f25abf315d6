"""Corrections as change sets, shown as the next version of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from wardline.functions.dates import moment
from wardline.operators import changes as ch
from wardline.operators.filters import not_voided

AS_OF = "2024-02-01 00:00:00"
_AT = f"TIMESTAMP '{AS_OF}'"


def whole_obs(t) -> DataFrame:
    """Observations with their audit columns."""
    empty = {"previous_version": "bigint", "void_reason": "string", "date_voided": "timestamp_ntz", "voided_by": "int", "creator": "int"}
    return t.obs.withColumns({name: F.lit(None).cast(kind) for name, kind in empty.items()}).withColumn("uuid", F.col("obs_id").cast("string"))


_SHOWN = ["encounter_id", "concept_id", "value_coded", "value_numeric", "previous_version", "voided", "void_reason"]


def applied(t, change) -> DataFrame:
    """The next version.  New rows show no id of their own (it is any free one) but whether it is free, and the concept of a new group."""
    before = whole_obs(t)
    after = ch.apply_changeset(before, change)
    # Old rows carry their id as UUID here; derived UUIDs have dashes.
    new = F.col("uuid").contains("-")
    top = before.agg(F.max("obs_id")).scalar()
    if change.parent is None:
        # No new row is a group.
        grouped = after.withColumn("group_concept", F.lit(None).cast("int"))
    else:
        heads = after.filter(new).select(F.col("obs_id").alias("obs_group_id"), F.col("concept_id").alias("group_concept"))
        grouped = after.join(heads, "obs_group_id", "left")
    return grouped.select(
        F.when(~new, F.col("obs_id")).alias("obs_id"), F.when(F.col("group_concept").isNull(), F.col("obs_group_id")).alias("obs_group_id"),
        "group_concept", (new & (F.col("obs_id") <= top)).alias("taken"), *_SHOWN,
    )


_OLD = """SELECT o.obs_id, o.obs_group_id, CAST(NULL AS INT) AS group_concept, FALSE AS taken, o.encounter_id, o.concept_id, o.value_coded, o.value_numeric, CAST(NULL AS BIGINT) AS previous_version,
  CASE WHEN c.obs_id IS NULL THEN o.voided ELSE TRUE END AS voided, CASE WHEN c.obs_id IS NULL THEN NULL ELSE '{reason}' END AS void_reason FROM obs o LEFT JOIN cand c ON o.obs_id = c.obs_id"""


def replaced_sql(candidates: str, concept: str, coded: str, numeric: str, reason: str) -> str:
    """The next version: every old row, candidates voided, plus their replacements."""
    return f"""
WITH cand AS ({candidates})
{_OLD.format(reason=reason)}
UNION ALL SELECT NULL, obs_group_id, NULL, FALSE, encounter_id, {concept}, {coded}, {numeric}, obs_id, FALSE, NULL FROM cand
"""


@query("recode_concept", replaced_sql(
    "SELECT o.* FROM obs o JOIN encounter e ON o.encounter_id = e.encounter_id WHERE o.concept_id IN (1, 2) AND NOT o.voided AND e.encounter_type IN ('1-URGENT', '2-HIGH')",
    "CASE concept_id WHEN 1 THEN 51 WHEN 2 THEN 52 END", "value_coded", "value_numeric", "moved to new concepts",
))
def _(t):
    change = ch.recode_concept(whole_obs(t), t.encounter, {1: 51, 2: 52}, ["1-URGENT", "2-HIGH"], "moved to new concepts", moment(AS_OF))
    return applied(t, change)


@query("recode_and_scale", replaced_sql(
    "SELECT o.* FROM obs o JOIN encounter e ON o.encounter_id = e.encounter_id WHERE o.concept_id IN (1, 2, 3) AND NOT o.voided AND e.encounter_type = '3-MEDIUM'",
    "concept_id + 60", "value_coded", "CASE WHEN value_numeric < 4 THEN value_numeric * 1000 ELSE value_numeric END", "litres to millilitres",
))
def _(t):
    change = ch.recode_and_scale(
        whole_obs(t), t.encounter, {1: 61, 2: 62, 3: 63}, ["3-MEDIUM"], 4, 1000, "litres to millilitres", moment(AS_OF)
    )
    return applied(t, change)


@query("override_answer", replaced_sql(
    "SELECT * FROM obs WHERE concept_id IN (4, 5) AND NOT voided", "concept_id", "39", "value_numeric", "wrong tag",
))
def _(t):
    return applied(t, ch.override_answer(whole_obs(t), [4, 5], 39, "wrong tag", moment(AS_OF)))


def grouped_sql(candidates: str, parts, reason: str) -> str:
    made = " ".join(
        f"""UNION ALL SELECT NULL, NULL, NULL, FALSE, encounter_id, {group}, NULL, NULL, NULL, FALSE, NULL FROM cand
UNION ALL SELECT NULL, NULL, {group}, FALSE, encounter_id, {child}, {answer}, NULL, NULL, FALSE, NULL FROM cand"""
        for _, group, child, answer in parts
    )
    return f"""
WITH cand AS ({candidates})
{_OLD.format(reason=reason)}
{made}
"""


@query("wrap_in_group", grouped_sql(
    """SELECT * FROM obs WHERE NOT voided AND concept_id = 3 AND value_coded = 5
UNION SELECT o.* FROM obs o JOIN encounter e ON o.encounter_id = e.encounter_id WHERE NOT o.voided AND o.obs_group_id IS NULL AND o.concept_id = 4 AND o.value_coded = 6 AND e.encounter_type IN ('1-URGENT', '2-HIGH', '5-LOW')""",
    [("wrap", 71, 4, 6)], "grouped rapid test",
))
def _(t):
    change = ch.wrap_in_group(
        whole_obs(t), t.encounter, (3, 5), (4, 6), 71, ["1-URGENT", "2-HIGH", "5-LOW"], "grouped rapid test", moment(AS_OF)
    )
    return applied(t, change)


_PARTS = [("first", 81, 82, 11), ("second", 91, 92, 12)]


@query("split_to_groups", grouped_sql("SELECT * FROM obs WHERE NOT voided AND concept_id = 6 AND value_coded = 8", _PARTS, "split result"))
def _(t):
    obs = whole_obs(t)
    candidates = not_voided(obs).filter((F.col("concept_id") == 6) & (F.col("value_coded") == 8))
    return applied(t, ch.split_to_groups(candidates, _PARTS, "split result", moment(AS_OF)))


_LOOSE = """
loose AS (SELECT encounter_id, patient_id, encounter_type, encounter_datetime + INTERVAL 2 HOUR AS at_time FROM encounter WHERE NOT voided AND location_id IN (3, 4, 5, 6) AND encounter_type <> '5-LOW'),
closed AS (SELECT * FROM visit WHERE date_stopped IS NOT NULL),
used AS (SELECT DISTINCT encounter_id FROM obs),
keep AS (SELECT * FROM loose WHERE encounter_id IN (SELECT encounter_id FROM used)),
ins AS (SELECT * FROM (SELECT k.encounter_id, c.visit_id, c.date_stopped, row_number() OVER (PARTITION BY k.encounter_id ORDER BY c.date_stopped DESC, c.visit_id DESC) AS r FROM keep k
  JOIN closed c ON c.patient_id = k.patient_id AND c.date_started <= k.at_time AND c.date_stopped >= k.at_time) WHERE r = 1),
bef AS (SELECT * FROM (SELECT k.encounter_id, c.visit_id, c.date_stopped, row_number() OVER (PARTITION BY k.encounter_id ORDER BY c.date_stopped DESC, c.visit_id DESC) AS r FROM keep k
  JOIN closed c ON c.patient_id = k.patient_id AND CAST(c.date_stopped AS DATE) = CAST(k.at_time AS DATE) AND c.date_stopped < k.at_time) WHERE r = 1),
slot AS (SELECT k.encounter_id, k.at_time, coalesce(ins.visit_id, bef.visit_id) AS visit_id, coalesce(ins.date_stopped, bef.date_stopped) AS date_stopped FROM keep k LEFT JOIN ins ON k.encounter_id = ins.encounter_id LEFT JOIN bef ON k.encounter_id = bef.encounter_id),
longer AS (SELECT visit_id, max(at_time) AS stop FROM slot WHERE at_time > date_stopped GROUP BY visit_id)
"""


@query("slot_encounters", f"""
WITH {_LOOSE}
SELECT 'encounter' AS kind, e.encounter_id AS id, CASE WHEN location_id IN (3, 4, 5, 6) THEN s.visit_id ELSE e.visit_id END AS visit_id,
  CASE WHEN l.encounter_id IS NOT NULL AND l.encounter_id NOT IN (SELECT encounter_id FROM used) THEN TRUE ELSE e.voided END AS voided, CAST(NULL AS TIMESTAMP) AS date_stopped
FROM encounter e LEFT JOIN loose l ON e.encounter_id = l.encounter_id LEFT JOIN slot s ON e.encounter_id = s.encounter_id
UNION ALL SELECT 'visit', v.visit_id, v.visit_id, FALSE, coalesce(longer.stop, v.date_stopped) FROM visit v LEFT JOIN longer ON v.visit_id = longer.visit_id
""")
def _(t):
    lost = F.col("location_id").isin(3, 4, 5, 6)
    enc = t.encounter.select(
        "encounter_id", "patient_id", "encounter_type", "location_id", "voided",
        F.when(lost, F.col("encounter_datetime") + F.expr("INTERVAL '2' HOUR")).otherwise(F.col("encounter_datetime")).alias("encounter_datetime"),
        F.when(lost, None).otherwise(F.col("visit_id")).alias("visit_id"),
    )
    audit = {"void_reason": "string", "date_voided": "timestamp_ntz", "voided_by": "int"}
    enc = enc.withColumns({n: F.lit(None).cast(k) for n, k in audit.items()})
    slots = ch.slot_encounters(enc, t.obs, t.visit, ["5-LOW"], moment(AS_OF))
    moved = ch.apply_changeset(enc, slots.encounters).select(
        F.lit("encounter").alias("kind"), F.col("encounter_id").alias("id"), "visit_id", "voided",
        F.lit(None).cast("timestamp_ntz").alias("date_stopped"),
    )
    visits = ch.apply_changeset(t.visit, slots.visits).select(
        F.lit("visit").alias("kind"), F.col("visit_id").alias("id"), "visit_id", F.lit(False).alias("voided"), "date_stopped"
    )
    return moved.unionByName(visits)


@query("insert_missing_attribute", """
SELECT visit_attribute_id, visit_id, attribute_type_id, value_reference, voided FROM visit_attribute
UNION ALL SELECT NULL, visit_id, 1, 'true', FALSE FROM (SELECT DISTINCT v.visit_id FROM adt_visit v JOIN ev ON v.patient_id = ev.user_id AND v.date_started = ev.ts
  WHERE ev.event_type IN ('signup', 'click')) b WHERE visit_id NOT IN (SELECT visit_id FROM visit_attribute WHERE attribute_type_id = 1 AND value_reference = 'true')
""")
def _(t):
    # Births recorded by another encounter: the newborn is named by UUID and the time matches a visit start.
    births = t.ev.filter(F.col("event_type").isin("signup", "click")).join(
        t.person.select(F.col("person_id").alias("user_id"), "uuid"), "user_id"
    )
    link = births.select(
        (F.col("event_id") * 2).alias("obs_id"), F.col("event_id").alias("encounter_id"), F.lit(400).alias("concept_id"),
        F.col("event_id").alias("obs_group_id"), F.col("uuid").alias("comments"), F.lit(None).cast("timestamp_ntz").alias("value_datetime"),
    )
    time = births.select(
        (F.col("event_id") * 2 + 1).alias("obs_id"), F.col("event_id").alias("encounter_id"), F.lit(401).alias("concept_id"),
        F.col("event_id").alias("obs_group_id"), F.lit(None).cast("string").alias("comments"), F.col("ts").alias("value_datetime"),
    )
    inborn = ch.visits_started_at_birth(link.unionByName(time), t.adt, t.person, t.adt_visit, ["admission", "delivery"], 400, 401)
    change = ch.insert_missing_attribute(t.visit_attribute, inborn, 1, "true", moment(AS_OF))
    after = ch.apply_changeset(t.visit_attribute, change)
    # New ids are any above the table's; these show as null.
    top = t.visit_attribute.agg(F.max("visit_attribute_id")).scalar()
    old = F.when(F.col("visit_attribute_id") <= top, F.col("visit_attribute_id"))
    return after.select(old.alias("visit_attribute_id"), "visit_id", "attribute_type_id", "value_reference", "voided")


@query("void_adjacent_duplicates", """
WITH r AS (SELECT d.* FROM dispense d JOIN dispense_order o ON d.drug_order_id = o.order_id WHERE NOT o.voided AND o.num_refills = 0 AND d.status = 1 AND NOT d.voided),
p AS (SELECT *, lag(date_created) OVER w AS pd, lag(dispenser) OVER w AS p1, lag(drug_id) OVER w AS p3, lag(quantity) OVER w AS p4 FROM r
  WINDOW w AS (PARTITION BY drug_order_id ORDER BY date_created, medication_dispense_id)),
dup AS (SELECT medication_dispense_id FROM p WHERE dispenser = p1 AND drug_id = p3 AND quantity = p4 AND abs(trunc((epoch_us(date_created) - epoch_us(pd)) / 1000000.0)) < 36000)
SELECT d.medication_dispense_id, CASE WHEN dup.medication_dispense_id IS NULL THEN d.voided ELSE TRUE END AS voided, CASE WHEN dup.medication_dispense_id IS NULL THEN NULL ELSE 'duplicate' END AS void_reason
FROM dispense d LEFT JOIN dup ON d.medication_dispense_id = dup.medication_dispense_id
""")
def _(t):
    rows = t.dispense.withColumns({
        "void_reason": F.lit(None).cast("string"), "date_voided": F.lit(None).cast("timestamp_ntz"), "voided_by": F.lit(None).cast("int"),
    })
    change = ch.void_adjacent_duplicates(
        rows, t.dispense_order, t.dispense_order, 1, ["dispenser", "drug_id", "quantity"], "duplicate", moment(AS_OF), max_seconds=36000
    )
    return ch.apply_changeset(rows, change).select("medication_dispense_id", "voided", "void_reason")


@query("apply_changeset_twice", """
SELECT count(*) AS n, count(*) FILTER (WHERE previous_version IS NOT NULL) AS replaced FROM (
  SELECT obs_id, CAST(NULL AS BIGINT) AS previous_version FROM obs UNION ALL SELECT -obs_id, obs_id FROM obs WHERE concept_id = 7 AND NOT voided)
""")
def _(t):
    def run(table):
        return ch.apply_changeset(table, ch.recode_concept(table, t.encounter, {7: 57}, None, "moved", moment(AS_OF)))

    return run(run(whole_obs(t))).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("previous_version").isNotNull()).alias("replaced")
    )


@query("split_packed_address", """
SELECT person_id, CASE WHEN contains(country, '|') THEN split_part(country, '|', 1) WHEN length(country) = 1 THEN 'ASIA' ELSE country END AS country,
  CASE WHEN contains(country, '|') THEN split_part(country, '|', 2) WHEN length(country) = 1 THEN '' ELSE county_district END AS county_district,
  CASE WHEN contains(country, '|') THEN split_part(country, '|', 3) WHEN length(country) = 1 THEN '' END AS state_province,
  CASE WHEN contains(country, '|') THEN split_part(country, '|', 4) WHEN length(country) = 1 THEN '' END AS address1,
  CASE WHEN contains(country, '|') THEN split_part(country, '|', 5) WHEN length(country) = 1 THEN '' END AS city_village FROM packed_address
""")
def _(t):
    parts = ["country", "county_district", "state_province", "address1", "city_village"]
    return ch.split_packed_address(t.packed_address, "country", parts, default="ASIA")
