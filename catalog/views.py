"""Entity tables derived from the given tables, for both SQL dialects.

Each view is one SELECT over the given tables or other views.  The dialect object
fills in the few expressions that are written differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


class SparkDialect:
    name = "spark"

    def ts(self, text: str) -> str:
        return f"TIMESTAMP_NTZ '{text}'"

    def plus_days(self, at: str, n: str) -> str:
        return f"({at} + make_dt_interval(CAST({n} AS INT), 0, 0, 0))"

    def plus_hours(self, at: str, n: str) -> str:
        return f"({at} + make_dt_interval(0, CAST({n} AS INT), 0, 0))"

    def plus_minutes(self, at: str, n: str) -> str:
        return f"({at} + make_dt_interval(0, 0, CAST({n} AS INT), 0))"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def ifloor(self, a: str) -> str:
        return f"CAST(floor({a}) AS INT)"


class DuckDialect:
    name = "duckdb"

    def ts(self, text: str) -> str:
        return f"TIMESTAMP '{text}'"

    def plus_days(self, at: str, n: str) -> str:
        return f"({at} + to_days(CAST({n} AS INTEGER)))"

    def plus_hours(self, at: str, n: str) -> str:
        return f"({at} + to_hours(CAST({n} AS INTEGER)))"

    def plus_minutes(self, at: str, n: str) -> str:
        return f"({at} + to_minutes(CAST({n} AS INTEGER)))"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} // {b})"

    def ifloor(self, a: str) -> str:
        return f"CAST(floor({a}) AS INTEGER)"


def _uuid(column: str) -> str:
    h = f"md5(CAST({column} AS STRING))"
    return " || '-' || ".join(f"substring({h}, {s}, {n})" for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def definitions(d) -> dict[str, str]:
    k = "CAST(regexp_extract(props, '[0-9]+', 0) AS INT)"
    obs_id = "((l_orderkey * 100000 + l_partkey) * 10000 + l_suppkey) * 10 + l_linenumber"
    event_type = (
        "CASE event_type WHEN 'signup' THEN 'admission' WHEN 'view' THEN 'transfer' WHEN 'purchase' THEN 'discharge' "
        "WHEN 'click' THEN 'delivery' ELSE 'vitals' END"
    )
    null_ts, null_int, null_str, null_dbl = (f"CAST(NULL AS {t})" for t in (
        "TIMESTAMP_NTZ" if d.name == "spark" else "TIMESTAMP", "INT", "STRING", "DOUBLE"))

    def eobs(factor: int, concept: int, value_coded=null_int, value_numeric=null_dbl, value_datetime=null_ts, comments=null_str,
             group="NULL", where="TRUE") -> str:
        group = "CAST(NULL AS BIGINT)" if group == "NULL" else f"CAST({group} AS BIGINT)"
        return (
            f"SELECT event_id * 100 + {factor} AS obs_id, user_id AS person_id, event_id AS encounter_id, {concept} AS concept_id, "
            f"{group} AS obs_group_id, ts AS obs_datetime, {value_coded} AS value_coded, {value_numeric} AS value_numeric, "
            f"{value_datetime} AS value_datetime, {comments} AS comments, value < 5 AS voided FROM ev WHERE {where}"
        )

    # One to three babies per delivery event: group 10*b, its children 10*b + 1..4.
    babies = []
    for b in (1, 2, 3):
        here = f"event_type = 'click' AND k % 3 >= {b - 1}"
        parent = f"event_id * 100 + {10 * b}"
        babies += [
            eobs(10 * b, 300, where=here),
            eobs(10 * b + 1, 301, value_datetime=d.plus_minutes("ts", f"k + {b}"), group=parent, where=here),
            eobs(10 * b + 2, 302, value_coded=f"311 + (k + {b}) % 5", group=parent, where=f"{here} AND k % 7 <> 0"),
            eobs(10 * b + 3, 303, value_coded=f"321 + (k + {b}) % 3", group=parent, where=f"{here} AND k % 11 <> 0"),
            eobs(10 * b + 4, 304, comments=f"CASE WHEN k % 4 = 0 THEN 'not linked' ELSE {_uuid(f'(user_id + {b})')} END",
                 group=parent, where=here),
        ]
    return {
        # events with the number in props spelled out
        "ev": f"SELECT event_id, ts, user_id, event_type, value, {k} AS k FROM events",
        "person": (
            f"SELECT c_custkey AS person_id, {_uuid('c_custkey')} AS uuid, "
            "CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, "
            f"CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN {d.plus_days(d.ts('2023-06-01 00:00:00'), '(c_custkey * 37) % 240')} "
            f"ELSE {d.plus_days(d.ts('1950-01-01 00:00:00'), '(c_custkey * 37) % 26000')} END AS birthdate, "
            "c_acctbal < 0 AS birthdate_estimated, "
            f"CASE WHEN c_mktsegment = 'MACHINERY' AND c_acctbal > 4000 THEN {d.plus_hours(d.ts('2024-01-20 00:00:00'), '(c_custkey * 13) % 96')} END AS death_date, "
            "CAST(c_custkey % 40 AS INT) AS cause_of_death, c_acctbal < -900 AS voided FROM customer"
        ),
        "person_name": (
            "SELECT c_custkey * 2 AS person_name_id, c_custkey AS person_id, c_mktsegment AS given_name, c_name AS family_name, "
            f"c_acctbal > 5000 AS preferred, {d.ts('2020-01-01 00:00:00')} AS date_created, c_acctbal < -950 AS voided FROM customer "
            "UNION ALL SELECT c_custkey * 2 + 1, c_custkey, n_name, c_name, c_acctbal <= 2500, "
            f"{d.ts('2021-01-01 00:00:00')}, c_mktsegment = 'BUILDING' FROM customer JOIN nation ON c_nationkey = n_nationkey"
        ),
        "person_address": (
            "SELECT c_custkey * 2 AS person_address_id, c_custkey AS person_id, c_acctbal > 3000 AS preferred, "
            f"{d.plus_days(d.ts('2020-01-01 00:00:00'), 'c_custkey % 500')} AS date_created, c_mktsegment = 'FURNITURE' AS voided, "
            "r_name AS country, n_name AS county_district, c_mktsegment AS state_province, "
            "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'V' || CAST(c_nationkey AS STRING) END AS city_village, "
            "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS address1, 'near ' || n_name AS address2, 'zone ' || CAST(c_nationkey AS STRING) AS address3 "
            "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
            f"UNION ALL SELECT c_custkey * 2 + 1, c_custkey, c_acctbal > 6000, {d.plus_days(d.ts('2020-06-01 00:00:00'), 'c_custkey % 90')}, "
            "c_acctbal < 0, 'ASIA', n_name, 'second', 'V2', 'line', 'mark', 'zone' FROM customer JOIN nation ON c_nationkey = n_nationkey"
        ),
        "person_attribute": (
            "SELECT c_custkey * 4 AS person_attribute_id, c_custkey AS person_id, 'phone' AS attribute_type, "
            "'07' || CAST(c_custkey % 700 AS STRING) AS value, c_acctbal < -500 AS voided FROM customer "
            "UNION ALL SELECT c_custkey * 4 + 1, c_custkey, 'test', CASE WHEN c_acctbal > 9000 THEN 'true' ELSE 'false' END, "
            "c_mktsegment = 'BUILDING' FROM customer "
            "UNION ALL SELECT c_custkey * 4 + 2, c_custkey, 'unknown', CASE WHEN c_acctbal > 9500 THEN 'true' ELSE 'false' END, FALSE FROM customer"
        ),
        "patient_identifier": (
            "SELECT c_custkey * 4 AS patient_identifier_id, c_custkey AS patient_id, 1 AS identifier_type, "
            "'A' || CAST(c_custkey AS STRING) AS identifier, FALSE AS preferred, FALSE AS voided FROM customer "
            "UNION ALL SELECT c_custkey * 4 + 1, c_custkey, 1, 'A' || CAST(c_custkey + 1 AS STRING) || 'x', c_acctbal > 7000, c_mktsegment = 'BUILDING' FROM customer "
            "UNION ALL SELECT c_custkey * 4 + 2, c_custkey, 2, 'B' || CAST(c_nationkey AS STRING), TRUE, c_acctbal < 1000 FROM customer "
            "UNION ALL SELECT c_custkey * 4 + 3, c_custkey, 3, c_name, TRUE, FALSE FROM customer"
        ),
        "patient_identifier_type": (
            "SELECT CAST(r_regionkey AS INT) AS identifier_type, CASE r_regionkey WHEN 1 THEN '^A[0-9]+$' WHEN 2 THEN '^B[0-9]{2}$' ELSE '' END AS format FROM region"
        ),
        "relationship": (
            "SELECT o_custkey AS person_a, o_custkey % 50 AS person_b, CAST(o_orderkey % 2 AS INT) AS relationship, o_orderstatus = 'F' AS voided FROM orders"
        ),
        "location": (
            "SELECT CAST(n_nationkey AS INT) AS location_id, n_name AS name, r_name AS parent, "
            f"{_uuid('n_nationkey')} AS uuid, n_nationkey % 11 = 0 AS retired FROM nation JOIN region ON n_regionkey = r_regionkey"
        ),
        "provider": "SELECT CAST(s_suppkey AS INT) AS provider_id, s_name AS name FROM supplier",
        "users": "SELECT CAST(s_suppkey AS INT) AS user_id, s_name AS username, 'Dr ' || s_name AS person_name FROM supplier",
        "concept_name": (
            "SELECT CAST(p_partkey AS INT) AS concept_id, 'en' AS locale, p_name || ' ' || CAST(p_partkey AS STRING) AS name FROM part "
            "UNION ALL SELECT CAST(p_partkey AS INT), 'fr', upper(p_name) FROM part WHERE p_size <= 25"
        ),
        "label_en": "SELECT concept_id, min(name) AS label FROM concept_name WHERE locale = 'en' GROUP BY concept_id",
        "concept_set": (
            "SELECT CAST(p_partkey AS INT) AS concept_id, p_type AS concept_set FROM part "
            "UNION ALL SELECT CAST(p_partkey AS INT), 'BIG' FROM part WHERE p_size > 25"
        ),
        "concept_map": (
            "SELECT p_brand AS source, CAST(p_partkey AS STRING) AS code, CAST(p_partkey AS INT) AS concept_id FROM part "
            "UNION ALL SELECT 'NAMES', p_name, CAST(p_partkey AS INT) FROM part"
        ),
        "drug": f"SELECT CAST(p_partkey AS INT) AS drug_id, p_name || ' ' || CAST(p_partkey AS STRING) AS name, {_uuid('p_partkey')} AS uuid FROM part",
        "encounter": (
            "SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, o_orderpriority AS encounter_type, "
            f"{d.plus_minutes('o_orderdate', '(o_orderkey * 7) % 1440')} AS encounter_datetime, CAST(o_orderkey % 25 AS INT) AS location_id, "
            f"o_custkey * 10000 + year(o_orderdate) AS visit_id, CAST(o_orderkey % 10 AS INT) AS creator, "
            f"{d.plus_minutes('o_orderdate', '(o_orderkey * 7) % 1440 + o_orderkey % 90')} AS date_created, o_totalprice < 25000 AS voided FROM orders"
        ),
        "visit": (
            "SELECT visit_id, min(patient_id) AS patient_id, min(encounter_datetime) AS date_started, "
            "CASE WHEN visit_id % 10000 = 2001 THEN NULL ELSE max(encounter_datetime) END AS date_stopped FROM encounter GROUP BY visit_id"
        ),
        "encounter_provider": (
            "SELECT l_orderkey AS encounter_id, CAST(l_suppkey AS INT) AS provider_id, l_returnflag = 'A' AS voided FROM lineitem"
        ),
        "obs": (
            f"SELECT {obs_id} AS obs_id, l_orderkey AS encounter_id, CAST(l_linenumber AS INT) AS concept_id, "
            "CASE WHEN l_tax = 0 THEN CAST(NULL AS BIGINT) ELSE l_orderkey * 10 + l_suppkey % 3 END AS obs_group_id, "
            f"l_shipdate AS obs_datetime, {d.plus_hours('l_shipdate', 'l_linenumber')} AS date_created, CAST(l_partkey % 40 AS INT) AS value_coded, "
            "CASE WHEN l_discount = 0 THEN NULL ELSE l_quantity END AS value_numeric, l_returnflag || l_linestatus || CAST(l_suppkey % 7 AS STRING) AS value_text, "
            f"{d.plus_days('l_shipdate', 'l_quantity')} AS value_datetime, CAST(l_partkey % 30 AS INT) AS value_drug, "
            "'note ' || CAST(l_suppkey AS STRING) AS comments, l_returnflag = 'R' AS voided FROM lineitem"
        ),
        # observations with their person and visit
        "pobs": (
            "SELECT obs.*, encounter.patient_id AS person_id, encounter.visit_id, encounter.encounter_datetime FROM obs JOIN encounter ON obs.encounter_id = encounter.encounter_id"
        ),
        # observations and the group rows above them
        "tobs": (
            "SELECT obs_id, encounter_id, concept_id, obs_group_id, obs_datetime, value_coded, value_numeric, value_text FROM obs WHERE NOT voided "
            "UNION ALL SELECT DISTINCT obs_group_id, encounter_id, CAST(101 + obs_group_id % 10 AS INT), CAST(NULL AS BIGINT), "
            f"{null_ts}, {null_int}, {null_dbl}, {null_str} FROM obs WHERE obs_group_id IS NOT NULL"
        ),
        # the same with every column, as reports read them
        "robs": (
            "SELECT obs_id, encounter_id, concept_id, obs_group_id, obs_datetime, date_created, value_coded, value_numeric, value_text, value_datetime, value_drug, comments, voided FROM obs "
            "UNION ALL SELECT DISTINCT obs_group_id, encounter_id, CAST(101 + obs_group_id % 10 AS INT), CAST(NULL AS BIGINT), "
            f"{null_ts}, {null_ts}, {null_int}, {null_dbl}, {null_str}, {null_ts}, {null_int}, {null_str}, FALSE FROM obs WHERE obs_group_id IS NOT NULL"
        ),
        "probs": "SELECT robs.*, encounter.patient_id AS person_id FROM robs JOIN encounter ON robs.encounter_id = encounter.encounter_id",
        "encounter_type": "SELECT DISTINCT o_orderpriority AS encounter_type_id, lower(o_orderpriority) AS name FROM orders",
        "program": "SELECT CAST(r_regionkey AS INT) AS program_id, r_name AS name FROM region",
        "birth_name": (
            "SELECT concept_id, locale, name FROM concept_name WHERE concept_id < 311 OR concept_id > 323 "
            "UNION ALL SELECT CAST(321 + r_regionkey AS INT), 'en', CASE r_regionkey WHEN 0 THEN 'Livebirth' WHEN 1 THEN 'Fresh Stillbirth' ELSE 'Macerated Stillbirth' END FROM region WHERE r_regionkey < 3 "
            "UNION ALL SELECT CAST(311 + r_regionkey AS INT), 'en', r_name FROM region"
        ),
        "birth_label": "SELECT concept_id, min(name) AS label FROM birth_name WHERE locale = 'en' GROUP BY concept_id",
        "orders_placed": (
            f"SELECT {obs_id} AS order_id, l_orderkey AS encounter_id, CAST(l_partkey % 40 AS INT) AS concept_id, "
            "CAST(l_linenumber % 2 AS INT) AS order_type_id, l_returnflag = 'R' AS voided FROM lineitem"
        ),
        # admissions, transfers and discharges
        "adt": (
            f"SELECT event_id AS encounter_id, user_id AS patient_id, {event_type} AS encounter_type, ts AS encounter_datetime, "
            f"CAST(k % 12 AS INT) AS location_id, user_id * 10 + {d.idiv('day(ts)', '10')} AS visit_id, k AS creator, "
            f"{d.plus_minutes('ts', 'k')} AS date_created, value < 5 AS voided FROM ev"
        ),
        "adt_visit": (
            "SELECT visit_id, min(patient_id) AS patient_id, min(encounter_datetime) AS date_started, "
            "CASE WHEN max(creator) >= 95 THEN NULL ELSE max(encounter_datetime) END AS date_stopped FROM adt GROUP BY visit_id"
        ),
        "visit_attribute": (
            "SELECT visit_id * 10 AS visit_attribute_id, visit_id, 1 AS attribute_type_id, CASE WHEN visit_id % 3 = 0 THEN 'true' ELSE 'false' END AS value_reference, "
            f"visit_id % 4 = 0 AS voided, {_uuid('visit_id')} AS uuid, date_started AS date_created FROM adt_visit"
        ),
        "patient_program": (
            "SELECT event_id AS patient_program_id, user_id AS patient_id, CAST(k % 2 AS INT) AS program_id, ts AS date_enrolled, "
            f"CASE WHEN k >= 70 THEN NULL ELSE {d.plus_hours('ts', d.ifloor('value') + ' * 2')} END AS date_completed, "
            "CASE WHEN k >= 70 THEN NULL ELSE CAST(k % 40 AS INT) END AS outcome_concept_id, CAST(k % 12 AS INT) AS location_id, "
            "CAST(k % 10 AS INT) AS creator, value < 5 AS voided FROM ev WHERE event_type = 'signup'"
        ),
        "patient_state": (
            "SELECT patient_program_id * 2 AS patient_state_id, patient_program_id, CAST(patient_program_id % 4 AS INT) AS state, "
            f"date_enrolled AS start_date, {d.plus_days('date_enrolled', '3')} AS end_date, FALSE AS voided FROM patient_program "
            "UNION ALL SELECT patient_program_id * 2 + 1, patient_program_id, CAST((patient_program_id + 1) % 4 AS INT), "
            f"{d.plus_days('date_enrolled', '3')}, date_completed, voided FROM patient_program"
        ),
        "program_workflow_state": (
            "SELECT CAST(r_regionkey AS INT) AS program_workflow_state_id, CAST(r_regionkey % 2 AS INT) AS program_workflow_id, CAST(r_regionkey + 10 AS INT) AS concept_id FROM region"
        ),
        # observations made at events: 201 a number, 202 a time, 203 an answer; deliveries 300 to 304
        "eobs": " UNION ALL ".join(
            [
                eobs(1, 201, value_numeric="value"),
                eobs(2, 202, value_datetime=d.plus_hours("ts", "k"), where="k % 3 <> 0"),
                eobs(3, 203, value_coded="k % 40"),
                *babies,
            ]
        ),
        "dispense": (
            f"SELECT event_id AS medication_dispense_id, user_id * 10 + k % 5 AS drug_order_id, CAST(k % 2 AS INT) AS dispenser, "
            "CASE WHEN k % 10 = 0 THEN NULL ELSE CAST(user_id % 3 AS INT) END AS concept, CAST(user_id % 7 AS INT) AS drug_id, "
            "CAST(k % 3 AS INT) AS quantity, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS status, ts AS date_created, value < 5 AS voided, user_id AS patient_id FROM ev"
        ),
        "dispense_order": "SELECT DISTINCT drug_order_id AS order_id, drug_order_id % 13 = 0 AS voided, CAST(drug_order_id % 4 AS INT) AS num_refills FROM dispense",
        "vitals": (
            "SELECT event_id, user_id, ts, "
            f"CASE WHEN k % 10 = 0 THEN NULL ELSE 30 + {d.ifloor('value')} % 160 END AS heart_rate, 8 + ({d.ifloor('value')} + k) % 80 AS respiratory_rate, "
            f"CAST(340 + ({d.ifloor('value * 10')} + k) % 70 AS DOUBLE) / 10 AS temperature_c, 85 + ({d.ifloor('value')} + k) % 16 AS o2_sat, "
            f"CAST({d.ifloor('value * 7')} % 100 AS DOUBLE) / 10 AS glucose, 60 + ({d.ifloor('value')} * 3 + k) % 130 AS bp_systolic, "
            f"40 + ({d.ifloor('value')} + 3 * k) % 90 AS bp_diastolic, CASE WHEN event_type = 'click' THEN 90 + ({d.ifloor('value')} + k) % 90 END AS fhr, "
            "CASE WHEN event_type = 'view' THEN 90 + k END AS fhr_second FROM ev"
        ),
        "bed": "SELECT CAST(s_suppkey AS INT) AS bed_id, CASE s_nationkey % 3 WHEN 0 THEN 'Inborn ' WHEN 1 THEN 'OUTBORN ' ELSE 'Bed ' END || CAST(s_suppkey AS STRING) AS bed_number, s_acctbal < 0 AS voided FROM supplier",
        "bed_location_map": "SELECT CAST(s_suppkey AS INT) AS bed_id, CAST(s_suppkey % 12 AS INT) AS location_id FROM supplier",
        "bed_patient_assignment_map": (
            "SELECT k AS bed_id, user_id AS patient_id, CASE WHEN value > 420 THEN NULL ELSE ts END AS date_stopped, value > 470 AS voided FROM ev"
        ),
        "packed_address": (
            "SELECT c_custkey AS person_id, CASE WHEN c_mktsegment = 'BUILDING' THEN substring(r_name, 1, 1) WHEN c_mktsegment = 'MACHINERY' THEN r_name "
            "WHEN c_acctbal > 5000 THEN r_name || '|' || n_name || '|' || c_mktsegment ELSE r_name || '|' || n_name || '|' || c_mktsegment || '|' || c_name || '|' END AS country, "
            "n_name AS county_district FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
        ),
        "lookalike": (
            "SELECT c_custkey AS person_id, c_nationkey AS village, c_mktsegment AS section, "
            "CASE WHEN c_acctbal < 0 THEN NULL ELSE substring(c_name, length(c_name), 1) END AS mothers_first_name, "
            "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 400 AS STRING) END AS phone FROM customer"
        ),
    }


def _needs(sql: str, known) -> list[str]:
    words = set(re.findall(r"\b(?:FROM|JOIN)\s+([A-Za-z_]+)", sql, flags=re.I))
    return [name for name in known if name in words]


def oracle(sql: str) -> str:
    """The statement with the views it reads spelled out in front."""
    views = definitions(DuckDialect())
    ordered: list[str] = []

    def add(text: str) -> None:
        for name in _needs(text, views):
            if name not in ordered:
                add(views[name])
                ordered.append(name)

    add(sql)
    body = sql.strip().rstrip(";")
    if not ordered:
        return body
    prelude = ", ".join(f"{name} AS ({views[name]})" for name in ordered)
    if body[:5].upper() == "WITH ":
        return f"WITH {prelude}, {body[5:]}"
    return f"WITH {prelude} {body}"


class Tables:
    """The views as DataFrames, by attribute; built on first use."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path
        self._made: dict[str, DataFrame] = {}
        self._views = definitions(SparkDialect())

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in self._views:
                sql = self._views[name]
                parts = {part: getattr(self, part) for part in _needs(sql, [*self._views, *BASE_TABLES])}
                for part in parts:
                    sql = re.sub(rf"\b(FROM|JOIN)\s+{part}\b", rf"\1 {{{part}}} {part}", sql, flags=re.I)
                # Regex quantifiers in literals must not read as placeholders.
                sql = re.sub(r"\{(\d+)\}", r"{{\1}}", sql)
                self._made[name] = self.spark.sql(sql, **parts)
            elif name in BASE_TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.path}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]
