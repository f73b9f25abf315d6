"""Dictionary lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import NOW, english, query, years_sql
from wardline.functions.dates import moment
from wardline.functions.text import format_address
from wardline.operators import dictionary as dc

_LABEL_FR = """
labels_fr AS (SELECT concept_id, coalesce(min(CASE WHEN locale = 'fr' THEN name END), min(CASE WHEN locale = 'en' THEN name END)) AS label
              FROM concept_name GROUP BY concept_id)
"""


@query("resolve_uuid", """
SELECT e.encounter_id, w.name FROM encounter e JOIN location w ON e.location_id = w.location_id
WHERE w.uuid IN (SELECT uuid FROM location WHERE name IN ('NATION_3', 'NATION_8'))
""")
def _(t):
    wanted = t.location.filter(F.col("name").isin("NATION_3", "NATION_8")).select("uuid")
    uuids = [r["uuid"] for r in wanted.collect()]
    found = dc.resolve_ids(t.location.select("uuid", "location_id", "name"), uuids, "location_id")
    return t.encounter.join(found, "location_id").join(t.location.select("location_id", "name"), "location_id").select("encounter_id", "name")


@query("concept_from_mapping", """
SELECT source, code, min(concept_id) AS concept_id FROM concept_map
WHERE (source, code) IN (('NAMES', 'small ring'), ('NAMES', 'red widget'), ('Brand#2', '0'), ('Brand#4', '2')) GROUP BY source, code
""")
def _(t):
    return dc.concept_from_mapping(
        t.concept_map, [("NAMES", "small ring"), ("NAMES", "red widget"), ("Brand#2", "0"), ("Brand#4", 2)]
    )


@query("concept_name", f"""
WITH {_LABEL_FR}
SELECT obs_id, value_coded, label AS answer FROM obs LEFT JOIN labels_fr l ON value_coded = l.concept_id
""")
def _(t):
    rows = t.obs.select("obs_id", "value_coded")
    return dc.concept_label(rows, dc.labels(t.concept_name, "fr"), "value_coded", "answer")


@query("concept_in_set", """
WITH f AS (SELECT concept_id, max(CASE WHEN concept_set = 'ECONOMY' THEN 1 ELSE 0 END) AS economy, max(CASE WHEN concept_set = 'BIG' THEN 1 ELSE 0 END) AS big,
  max(CASE WHEN concept_set = 'PROMO' THEN 1 ELSE 0 END) AS promo FROM concept_set WHERE concept_set IN ('ECONOMY', 'BIG', 'PROMO') GROUP BY concept_id)
SELECT obs_id, coalesce(economy, 0) AS economy, coalesce(big, 0) AS big, coalesce(promo, 0) AS promo FROM obs LEFT JOIN f ON value_coded = f.concept_id
""")
def _(t):
    rows = dc.concept_in_sets(t.obs, t.concept_set, "value_coded", {"economy": "ECONOMY", "big": "BIG", "promo": "PROMO"})
    return rows.select("obs_id", "economy", "big", "promo")


@query("retrieve_code_system", """
WITH c AS (SELECT concept_id, min(code) AS code FROM concept_map WHERE source = 'NAMES' GROUP BY concept_id)
SELECT obs_id, code AS external_code FROM obs LEFT JOIN c ON value_coded = c.concept_id
""")
def _(t):
    return dc.retrieve_code(t.obs, t.concept_map, "value_coded", "NAMES", "external_code").select("obs_id", "external_code")


@query("value_coded_name", "SELECT obs_id, label AS answer FROM obs LEFT JOIN label_en l ON value_coded = l.concept_id WHERE NOT voided")
def _(t):
    live = t.obs.filter(~F.col("voided")).select("obs_id", "value_coded")
    return dc.concept_label(live, english(t), "value_coded", "answer").select("obs_id", "answer")


@query("patient_identifier", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY patient_id, identifier_type ORDER BY preferred DESC, patient_identifier_id) AS r
  FROM patient_identifier WHERE NOT voided)
SELECT patient_id, max(CASE WHEN identifier_type = 1 THEN identifier END) AS emr_id, max(CASE WHEN identifier_type = 2 THEN identifier END) AS clinic_id,
  max(CASE WHEN identifier_type = 3 THEN identifier END) AS national_id FROM ranked WHERE r = 1 GROUP BY patient_id
""")
def _(t):
    return dc.patient_identifiers(t.patient_identifier, {"emr_id": 1, "clinic_id": 2, "national_id": 3})


@query("config_value", """
SELECT concept_id, label FROM (SELECT concept_id, coalesce(min(CASE WHEN locale = 'fr' THEN name END), min(CASE WHEN locale = 'en' THEN name END)) AS label
  FROM concept_name GROUP BY concept_id)
""")
def _(t):
    properties = t.nation.select(
        F.concat(F.lit("locale."), "n_name").alias("property"),
        F.when(F.col("n_regionkey") == 1, "fr").otherwise("en").alias("value"),
    )
    locale = dc.config_value(properties, "locale.NATION_1", "en")
    return dc.labels(t.concept_name, locale, dc.config_value(properties, "locale.none", "en"))


_NAMES = """
names AS (SELECT person_id, given_name, family_name, row_number() OVER (PARTITION BY person_id ORDER BY preferred DESC, date_created DESC, person_name_id) AS r
  FROM person_name WHERE NOT voided)
"""
_ATTRIBUTES = """
attrs AS (SELECT person_id, max(CASE WHEN attribute_type = 'phone' THEN value END) AS phone, max(CASE WHEN attribute_type = 'unknown' THEN value END) AS unknown_patient
  FROM person_attribute WHERE NOT voided AND attribute_type IN ('phone', 'unknown') GROUP BY person_id)
"""


@query("person_profile", f"""
WITH {_NAMES}, {_ATTRIBUTES}
SELECT p.person_id, given_name, family_name, concat_ws(' ', given_name, family_name) AS person_name, gender, birthdate, birthdate_estimated,
  death_date IS NOT NULL AS dead, death_date, {years_sql('birthdate', f"TIMESTAMP '{NOW}'")} AS current_age, phone, unknown_patient
FROM person p LEFT JOIN (SELECT * FROM names WHERE r = 1) n ON p.person_id = n.person_id LEFT JOIN attrs a ON p.person_id = a.person_id
""")
def _(t):
    return dc.person_profile(t.person, t.person_name, t.person_attribute, moment(NOW))


@query("latest_preferred_address", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY preferred DESC, date_created DESC, person_address_id) AS rn FROM person_address WHERE NOT voided),
     a AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY preferred DESC, date_created DESC, person_address_id) AS rn FROM person_address)
SELECT 'live' AS rows_used, person_id, country, county_district, city_village FROM r WHERE rn = 1
UNION ALL SELECT 'all', person_id, country, county_district, city_village FROM a WHERE rn = 1
""")
def _(t):
    columns = ["country", "county_district", "city_village"]
    live = dc.latest_address(t.person_address, columns).withColumn("rows_used", F.lit("live"))
    every = dc.latest_address(t.person_address, columns, include_voided=True).withColumn("rows_used", F.lit("all"))
    return live.unionByName(every).select("rows_used", "person_id", *columns)


@query("format_address", """
SELECT person_address_id, concat_ws(', ', nullif(city_village, ''), nullif(address1, ''), nullif(address2, ''), nullif(county_district, ''), nullif(country, '')) AS address
FROM person_address
""")
def _(t):
    parts = ["city_village", "address1", "address2", "county_district", "country"]
    return t.person_address.select("person_address_id", format_address(*[F.col(p) for p in parts]).alias("address"))


@query("location_name", "SELECT encounter_id, name AS location FROM encounter e LEFT JOIN location l ON e.location_id = l.location_id")
def _(t):
    return dc.attach(t.encounter, "location_id", t.location, "location_id", {"location": "name"}).select("encounter_id", "location")


@query("encounter_type_name", """
SELECT e.encounter_id, y.name AS encounter_type_name FROM (SELECT *, CAST(substring(encounter_type, 1, 1) AS INT) AS type_id FROM encounter) e
LEFT JOIN (SELECT CAST(r_regionkey AS INT) AS id, r_name AS name FROM region) y ON e.type_id = y.id
""")
def _(t):
    rows = t.encounter.withColumn("type_id", F.substring("encounter_type", 1, 1).cast("int"))
    return dc.attach(rows, "type_id", t.region, "r_regionkey", {"encounter_type_name": "r_name"}).select("encounter_id", "encounter_type_name")


@query("username", "SELECT encounter_id, username FROM encounter LEFT JOIN users ON creator = user_id")
def _(t):
    return dc.attach(t.encounter, "creator", t.users, "user_id", {"username": "username"}).select("encounter_id", "username")


@query("person_name_of_user", "SELECT encounter_id, person_name AS user_entered FROM encounter LEFT JOIN users ON creator = user_id")
def _(t):
    return dc.attach(t.encounter, "creator", t.users, "user_id", {"user_entered": "person_name"}).select("encounter_id", "user_entered")


@query("provider", """
WITH f AS (SELECT encounter_id, min(provider_id) AS provider_id FROM encounter_provider WHERE NOT voided GROUP BY encounter_id)
SELECT e.encounter_id, p.name AS provider FROM encounter e LEFT JOIN f ON e.encounter_id = f.encounter_id LEFT JOIN provider p ON f.provider_id = p.provider_id
""")
def _(t):
    found = dc.provider_of_encounter(t.encounter_provider, t.provider)
    return dc.attach(t.encounter, "encounter_id", found, "encounter_id", {"provider": "provider"}).select("encounter_id", "provider")


@query("drug_id", """
SELECT d.reference, count(*) AS n FROM obs JOIN (
  SELECT name AS reference, min(drug_id) AS drug_id FROM drug WHERE drug_id IN (1, 2) GROUP BY name
  UNION ALL SELECT uuid, min(drug_id) FROM drug WHERE drug_id IN (4, 5) GROUP BY uuid) d ON value_drug = d.drug_id GROUP BY d.reference
""")
def _(t):
    known = t.drug.filter(F.col("drug_id").isin(1, 2, 4, 5)).select(F.when(F.col("drug_id") < 3, F.col("name")).otherwise(F.col("uuid")).alias("r"))
    found = dc.drug_ids(t.drug, [r["r"] for r in known.collect()])
    return t.obs.join(found, F.col("value_drug") == F.col("drug_id")).groupBy("reference").agg(F.count(F.lit(1)).alias("n"))


@query("lookup_dedup", """
SELECT obs_id, label, coalesce(big, 0) AS big FROM obs LEFT JOIN label_en l ON value_coded = l.concept_id
LEFT JOIN (SELECT concept_id, 1 AS big FROM concept_set WHERE concept_set = 'BIG') s ON value_coded = s.concept_id
""")
def _(t):
    def derive(keys):
        named = dc.concept_label(keys, english(t), "value_coded", "label")
        return dc.concept_in_sets(named, t.concept_set, "value_coded", {"big": "BIG"})

    return dc.lookup_dedup(t.obs.select("obs_id", "value_coded"), "value_coded", derive).select("obs_id", "label", "big")
