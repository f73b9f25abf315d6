"""Sources, sinks, parameters, filters and predicates."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType

from catalog.base import NOW, query, years_sql
from wardline.functions.dates import moment
from wardline.functions.text import site_key
from wardline.operators import filters as fl
from wardline.session import scratch_dir
from wardline.sources import months as mt
from wardline.sources.entities import load_entities, materialize_table
from wardline.sources.export import export_csv, read_report
from wardline.sources.parameters import bind_parameters
from wardline.sources.reference import load_reference_csv, unpivot_tags


def fresh_folder(spark, name: str) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/wardline/{name}-{uuid.uuid4().hex}"


def _fields(**columns):
    return StructType([StructField(n, t) for n, t in columns.items()])


@query("load_entities", """
SELECT 'customer' AS entity, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem
UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders
""")
def _(t):
    schemas = {
        "customer": _fields(c_custkey=LongType(), c_name=StringType(), c_acctbal=DoubleType()),
        "lineitem": _fields(l_orderkey=LongType(), l_linenumber=IntegerType(), l_shipdate=TimestampNTZType()),
        "orders": _fields(o_orderkey=LongType(), o_orderdate=TimestampNTZType()),
    }
    tables = load_entities(t.spark, t.path, schemas=schemas, suffix=".parquet")
    out = None
    for name, key in (("customer", "c_custkey"), ("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        part = tables[name].agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))
        out = part if out is None else out.unionByName(part)
    return out


@query("load_reference_csv", """
SELECT 'site-' || r_name || '-id' AS uuid, n_name AS name, 'unknown ${nobody}' AS note
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 11 <> 0
""")
def _(t):
    folder = fresh_folder(t.spark, "reference")
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("${site."), "r_name", F.lit("}")).alias("uuid"), F.col("n_name").alias("name"),
        F.lit("unknown ${nobody}").alias("note"),
        F.when(F.col("n_nationkey") % 11 == 0, "TRUE").alias("Void/Retire"),
    )
    rows.write.option("header", True).csv(folder)
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
    return load_reference_csv(t.spark, folder, {f"site.{n}": f"site-{n}-id" for n in names})


@query("unpivot_tags", """
SELECT n_name AS location, 'Even ward' AS tag FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT n_name, 'Third ward' FROM nation WHERE n_nationkey % 3 = 0
UNION ALL SELECT n_name, 'Region ward' FROM nation WHERE n_regionkey = 1
""")
def _(t):
    wide = t.nation.select(
        F.col("n_name").alias("location"),
        F.when(F.col("n_nationkey") % 2 == 0, "TRUE").alias("Even ward"),
        F.when(F.col("n_nationkey") % 3 == 0, "true").otherwise("").alias("Third ward"),
        (F.col("n_regionkey") == 1).alias("Region ward"),
    )
    return unpivot_tags(wide, "location")


@query("export_csv", r"""
SELECT doc_id, regexp_replace(text, '[^\x00-\x7F\p{L}]', '', 'g') AS text, lang FROM documents
""")
def _(t):
    # Written as a report and read back from its files.
    rows = t.documents.select("doc_id", "text", "lang")
    folder = export_csv(rows, fresh_folder(t.spark, "reports"), "documents", datetime(2024, 6, 1, 8, 30))
    return read_report(t.spark, folder, "doc_id long, text string, lang string")


@query("bind_parameters", """
SELECT encounter_id, encounter_datetime, location_id FROM encounter
WHERE encounter_datetime >= TIMESTAMP '1996-02-01 00:00:00' AND encounter_datetime < TIMESTAMP '1997-07-01 00:00:00' AND location_id = 4
""")
def _(t):
    given = bind_parameters({"startDate": "1996-02-01", "endDate": date(1997, 6, 30)}, {"locationUUID": 4})
    rows = fl.date_range(t.encounter, "encounter_datetime", given.start_date, given.end_date)
    return rows.filter(F.col("location_id") == given.location).select("encounter_id", "encounter_datetime", "location_id")


@query("materialize_table", """
SELECT patient_id, count(*) AS n, max(encounter_datetime) AS last_seen FROM encounter WHERE NOT voided GROUP BY patient_id
""")
def _(t):
    rows = fl.not_voided(t.encounter).groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("encounter_datetime").alias("last_seen")
    )
    return materialize_table(rows, fresh_folder(t.spark, "cohort"), "1")


@query("month_indexes", """
WITH held AS (SELECT p.*, e.visit_id, coalesce(strftime(e.encounter_datetime, '%Y-%m'), strftime(p.obs_datetime, '%Y-%m'), 'undated') AS enc_month
  FROM probs p LEFT JOIN encounter e ON p.encounter_id = e.encounter_id),
visits AS (SELECT DISTINCT visit_id, strftime(encounter_datetime, '%Y-%m') AS month FROM encounter WHERE encounter_datetime IS NOT NULL),
kept AS (SELECT DISTINCT visit_id, enc_month FROM held),
times AS (SELECT concept_id, 'obs_datetime' AS kind, strftime(obs_datetime, '%Y-%m') AS at_month, enc_month FROM held
  UNION SELECT concept_id, 'value_datetime', strftime(value_datetime, '%Y-%m'), enc_month FROM held),
members AS (SELECT DISTINCT obs_group_id, enc_month FROM held WHERE obs_group_id IS NOT NULL)
SELECT 'visit' AS found_by, CAST(v.visit_id AS VARCHAR) AS key, v.month AS near, k.enc_month FROM visits v JOIN kept k ON v.visit_id = k.visit_id
UNION ALL SELECT DISTINCT 'person', CAST(person_id AS VARCHAR), NULL, enc_month FROM held WHERE person_id IS NOT NULL
UNION ALL SELECT kind, CAST(concept_id AS VARCHAR), at_month, enc_month FROM times WHERE at_month IS NOT NULL
UNION ALL SELECT DISTINCT 'group', NULL, a.enc_month, b.enc_month FROM members a JOIN members b ON a.obs_group_id = b.obs_group_id AND a.enc_month <> b.enc_month
""")
def _(t):
    obs = mt.by_encounter_month(t.probs, t.encounter)

    def shown(df, found_by, key, near, month="enc_month"):
        return df.select(found_by.alias("found_by"), key.cast("string").alias("key"), near.alias("near"), F.col(month).alias("enc_month"))

    none = F.lit(None).cast("string")
    return (
        shown(mt.months_by_visit(obs, t.encounter), F.lit("visit"), F.col("visit_id"), F.col("month"))
        .unionByName(shown(mt.months_by_person(obs), F.lit("person"), F.col("person_id"), none))
        .unionByName(shown(mt.months_by_time(obs), F.col("kind"), F.col("concept_id"), F.col("at_month")))
        .unionByName(shown(mt.months_by_group(obs), F.lit("group"), none, F.col("enc_month"), "other_month"))
    )


@query("prefix_site_keys", """
SELECT '12-' || CAST(encounter_id AS VARCHAR) AS numeric_site, CAST(encounter_id AS VARCHAR) AS text_site,
       CAST(patient_id AS VARCHAR) AS no_site FROM encounter
""")
def _(t):
    return t.encounter.select(
        site_key(F.col("encounter_id"), "12").alias("numeric_site"),
        site_key(F.col("encounter_id"), "north").alias("text_site"),
        site_key(F.col("patient_id"), None).alias("no_site"),
    )


@query("not_voided", "SELECT obs_id, concept_id, value_coded FROM obs WHERE NOT voided")
def _(t):
    return fl.not_voided(t.obs).select("obs_id", "concept_id", "value_coded")


@query("date_range_optional", """
SELECT 'both' AS bounds, encounter_id FROM encounter WHERE CAST(encounter_datetime AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
UNION ALL SELECT 'start', encounter_id FROM encounter WHERE CAST(encounter_datetime AS DATE) >= DATE '2000-06-30'
UNION ALL SELECT 'end', encounter_id FROM encounter WHERE CAST(encounter_datetime AS DATE) <= DATE '1995-03-03'
UNION ALL SELECT 'none', encounter_id FROM encounter
""")
def _(t):
    cases = {"both": ("1996-01-01", "1996-12-31"), "start": ("2000-06-30", None), "end": (None, "1995-03-03"), "none": (None, None)}
    out = None
    for name, (start, end) in cases.items():
        part = fl.date_range(t.encounter, "encounter_datetime", start, end).select(F.lit(name).alias("bounds"), "encounter_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("type_in", """
SELECT encounter_id, patient_id, encounter_type FROM encounter WHERE encounter_type IN ('1-URGENT', '2-HIGH')
""")
def _(t):
    return fl.type_in(t.encounter, ["1-URGENT", "2-HIGH"]).select("encounter_id", "patient_id", "encounter_type")


@query("on_date_at_location", """
SELECT encounter_id, encounter_datetime FROM adt
WHERE encounter_type = 'discharge' AND CAST(encounter_datetime AS DATE) = DATE '2024-01-15' AND location_id = 3
""")
def _(t):
    return fl.on_date_at_location(t.adt, ["discharge"], "2024-01-15", 3).select("encounter_id", "encounter_datetime")


@query("shift_window", """
SELECT 'morning' AS shift, encounter_id FROM adt WHERE encounter_datetime >= TIMESTAMP '2024-01-09 08:00:00' AND encounter_datetime < TIMESTAMP '2024-01-10 08:00:00'
UNION ALL SELECT 'evening', encounter_id FROM adt WHERE encounter_datetime >= TIMESTAMP '2024-01-10 08:00:00' AND encounter_datetime <= TIMESTAMP '2024-01-10 20:00:00'
""")
def _(t):
    morning = fl.shift_window("2024-01-10", "morning")
    evening = fl.shift_window(date(2024, 1, 10), "evening", end_inclusive=True)
    at = F.col("encounter_datetime")
    return t.adt.filter(morning.covers(at)).select(F.lit("morning").alias("shift"), "encounter_id").unionByName(
        t.adt.filter(evening.covers(at)).select(F.lit("evening").alias("shift"), "encounter_id")
    )


@query("exclude_flagged_persons", """
SELECT 'live' AS flags, encounter_id, patient_id FROM encounter WHERE patient_id NOT IN
  (SELECT person_id FROM person_attribute WHERE attribute_type = 'test' AND value = 'true' AND NOT voided)
UNION ALL
SELECT 'all', encounter_id, patient_id FROM encounter WHERE patient_id NOT IN
  (SELECT person_id FROM person_attribute WHERE attribute_type = 'test' AND value = 'true')
""")
def _(t):
    live = fl.exclude_flagged_persons(t.encounter, t.person_attribute, "test")
    every = fl.exclude_flagged_persons(t.encounter, t.person_attribute, "test", include_voided=True)
    return live.select(F.lit("live").alias("flags"), "encounter_id", "patient_id").unionByName(
        every.select(F.lit("all").alias("flags"), "encounter_id", "patient_id")
    )


_AGE = years_sql("birthdate", f"TIMESTAMP '{NOW}'")


@query("age_gate", f"""
SELECT encounter_id, patient_id, location_id FROM adt JOIN person ON patient_id = person_id
WHERE birthdate IS NOT NULL AND CASE WHEN location_id IN (2) THEN {_AGE} <= 0 ELSE {_AGE} >= 10 END
""")
def _(t):
    rows = t.adt.join(t.person.select("person_id", "birthdate"), F.col("patient_id") == F.col("person_id"))
    return fl.age_gate(rows, "birthdate", "location_id", moment(NOW), [2]).select("encounter_id", "patient_id", "location_id")


@query("open_interval", "SELECT visit_id, patient_id, date_started FROM visit WHERE date_stopped IS NULL")
def _(t):
    return fl.open_interval(t.visit).select("visit_id", "patient_id", "date_started")


@query("year_overlap", """
SELECT visit_id, date_started, date_stopped FROM visit WHERE year(date_stopped) >= 1997 AND year(date_started) <= 1999
""")
def _(t):
    return fl.year_overlap(t.visit, "date_started", "date_stopped", 1997, 1999).select("visit_id", "date_started", "date_stopped")


@query("ilike_class", """
SELECT CASE WHEN bed_number ILIKE '%inborn%' THEN 'Inborn' WHEN bed_number ILIKE '%outborn%' THEN 'Outborn' ELSE 'Other' END AS class, count(*) AS n
FROM bed GROUP BY 1
""")
def _(t):
    rows = fl.ilike_class(t.bed, "bed_number", [("Inborn", ["%inborn%"]), ("Outborn", ["%outborn%"])], "class", "Other")
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("uuid_like", """
SELECT obs_id, comments FROM eobs
WHERE regexp_matches(comments, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
""")
def _(t):
    return fl.uuid_like(t.eobs, "comments").select("obs_id", "comments")


@query("identifier_format", """
SELECT i.identifier_type, count(*) FILTER (WHERE format = '' OR regexp_matches(identifier, format)) AS valid,
       count(*) FILTER (WHERE NOT (format = '' OR regexp_matches(identifier, format))) AS invalid
FROM patient_identifier i JOIN patient_identifier_type y ON i.identifier_type = y.identifier_type GROUP BY 1
""")
def _(t):
    return fl.identifier_format(t.patient_identifier, t.patient_identifier_type)
