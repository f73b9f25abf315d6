"""Filters, clinical rules, scores and ranges on boundary values."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wardline.functions import clinical as cl
from wardline.functions import dates as dt
from wardline.functions import scoring as sc
from wardline.functions.text import format_address, is_uuid, printable, reword, site_key
from wardline.operators import filters as fl
from wardline.operators import ranges as rg
from wardline.sources.parameters import bind_parameters


def column(spark, values, expression, kind):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


def test_ages_on_leap_days_and_month_ends(spark):
    df = spark.createDataFrame([
        (1, at("2020-02-29"), at("2021-02-28")), (2, at("2020-02-29"), at("2021-03-01")), (3, at("2024-01-31"), at("2024-02-29")),
        (4, at("2010-05-05"), at("2020-05-05")), (5, None, at("2020-05-05")), (6, at("2010-05-05T08:00"), at("2020-05-05T07:59")),
    ], "i int, a timestamp_ntz, b timestamp_ntz")
    rows = df.select("i", cl.age_at(F.col("a"), F.col("b")).alias("y"), dt.complete_units("MONTH", F.col("a"), F.col("b")).alias("m")).orderBy("i").collect()
    assert [(r["y"], r["m"]) for r in rows] == [(0, 11), (1, 12), (0, 0), (10, 120), (None, None), (9, 119)]


def test_age_text_reads_months_after_the_dot(spark):
    out = column(spark, [at("2020-01-15")], dt.years_dot_months(F.col("v"), dt.moment("2023-12-20")), "timestamp_ntz")
    assert out == ["3.11"]


def test_readable_forms(spark):
    out = column(spark, [at("2024-03-05T19:05"), at("2024-11-15T00:30")], F.concat_ws("; ", dt.readable_datetime(F.col("v")), dt.readable_date(F.col("v")), dt.readable_time(F.col("v"))), "timestamp_ntz")
    assert out == ["Mar 5, 2024 7:05pm; 5 Mar 2024; 07:05 PM", "Nov 15, 2024 12:30am; 15 Nov 2024; 12:30 AM"]


def test_shift_bounds(spark):
    stamps = [at("2024-01-09T07:59:59"), at("2024-01-09T08:00"), at("2024-01-10T07:59:59"), at("2024-01-10T08:00"), at("2024-01-10T20:00"), at("2024-01-10T20:00:01")]

    def hits(shift, inclusive):
        window = fl.shift_window("2024-01-10", shift, inclusive)
        return column(spark, stamps, window.covers(F.col("v")), "timestamp_ntz")

    assert hits("morning", False) == [False, True, True, False, False, False]
    assert hits("morning", True) == [False, True, True, True, False, False]
    assert hits("evening", False) == [False, False, False, True, False, False]
    assert hits("evening", True) == [False, False, False, True, True, False]
    with pytest.raises(ValueError):
        fl.shift_window("2024-01-10", "night")


def test_date_range_keeps_the_whole_end_day(spark):
    df = spark.createDataFrame([(at("2024-01-01"),), (at("2024-01-05T23:59:59"),), (at("2024-01-06"),)], "t timestamp_ntz")
    assert fl.date_range(df, "t", "2024-01-01", date(2024, 1, 5)).count() == 2
    assert fl.date_range(df, "t", end="2023-12-31").count() == 0
    assert fl.date_range(df, "t").count() == 3


def test_age_gate(spark):
    now = dt.moment("2024-01-31")
    df = spark.createDataFrame([
        (1, None, 1), (2, at("2014-02-01"), 1), (3, at("2014-01-31"), 1), (4, at("2023-06-01"), 2), (5, at("2023-01-31"), 2), (6, None, 2), (7, at("1990-01-01"), 2),
    ], "id int, birthdate timestamp_ntz, ward int")
    assert sorted(r["id"] for r in fl.age_gate(df, "birthdate", "ward", now, [2]).collect()) == [3, 4]


def test_flagged_persons(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "patient_id bigint")
    attributes = spark.createDataFrame([(1, "test", "true", False), (2, "test", "true", True), (3, "test", "false", False)], "person_id bigint, attribute_type string, value string, voided boolean")
    assert sorted(r[0] for r in fl.exclude_flagged_persons(rows, attributes, "test").collect()) == [2, 3]
    assert sorted(r[0] for r in fl.exclude_flagged_persons(rows, attributes, "test", include_voided=True).collect()) == [3]


def test_uuid_forms(spark):
    good = "0F8FAD5B-d9cb-469f-a165-70867728950e"
    assert column(spark, [good, good[:-1], good + "0", "x" + good[1:], None], is_uuid(F.col("v")), "string") == [True, False, False, False, None]


def test_site_keys(spark):
    def keys(site):
        return column(spark, [5], site_key(F.col("v"), site), "int")

    assert keys("12") == ["12-5"] and keys("") == ["5"] and keys("north") == ["5"] and keys(None) == ["5"] and keys("1a") == ["5"]


def test_text_helpers(spark):
    assert column(spark, ["Héllo → “x”\n1"], printable(F.col("v")), "string") == ["Héllo  x\n1"]
    assert column(spark, ["Hospitalized | Primary care clinic"], reword(F.col("v"), {"Hospitalized": "Ward", "Primary care clinic": "OPD"}), "string") == ["Ward | OPD"]
    assert column(spark, ["a"], format_address(F.col("v"), F.lit(None), F.lit(" "), F.lit("b")), "string") == ["a, b"]


def test_symptom_control(spark):
    items = [(1, 1, 1, 1), (1, 1, 1, 0), (1, 1, 0, 0), (1, 0, 0, 0), (0, 0, 0, 0), (1, 1, 1, None), (None,) * 4]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(items)], "i int, a int, b int, c int, d int")
    out = [r[0] for r in df.orderBy("i").select(cl.symptom_control([F.col(c) for c in "abcd"], F.lit(1))).collect()]
    assert out == ["Uncontrolled", "Uncontrolled", "Partly controlled", "Partly controlled", "Well controlled", None, None]


def test_reporting_outcome(spark):
    now = dt.moment("2024-12-31")
    day = lambda n: dt.shift_days(now, -n)
    cases = [(90, 181), (91, 180), (91, 181), (91, None)]
    one = spark.range(1)
    for (visit, appointment), want in zip(cases, ["kept", "kept", cl.LOST, "kept"]):
        nothing = F.lit(None).cast("timestamp_ntz")
        due = day(appointment) if appointment else nothing
        out = cl.reporting_outcome(F.lit("kept"), nothing, day(visit), nothing, due, now)
        assert one.select(out).head()[0] == want
    closed = cl.reporting_outcome(F.lit("done"), day(5), day(400), day(500), day(400), now)
    by_enrolment = cl.reporting_outcome(F.lit("x"), F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("timestamp_ntz"), day(400), day(400), now)
    assert [v for v in one.select(closed.alias("c"), by_enrolment.alias("e")).head()] == ["done", cl.LOST]


def test_followup_flags(spark):
    now = dt.moment("2024-12-31")
    df = spark.createDataFrame([(0, 14), (1, 15), (2, 91), (3, 92), (4, 182), (5, 183)], "i int, days int")
    last = F.date_sub(F.to_date(now), F.col("days")).cast("timestamp_ntz")
    flags = cl.followup_flags(last, F.lit("x"), now)
    rows = df.orderBy("i").select(*[c.alias(n) for n, c in flags.items()]).collect()
    assert [r["came_within_14_days"] for r in rows] == ["Oui", "No", "No", "No", "No", "No"]
    assert [r["over_three_months"] for r in rows] == ["No", "No", "No", "Oui", "Oui", "Oui"]
    assert [r["over_six_months"] for r in rows] == ["No", "No", "No", "No", "No", "Oui"]
    none = cl.followup_flags(last, F.lit(None).cast("string"), now)
    assert df.select(*none.values()).head()[0] is None


def test_retrospective_entry(spark):
    df = spark.createDataFrame([
        (1, at("2024-01-01T10:00"), at("2024-01-01T10:30")), (2, at("2024-01-01T10:00"), at("2024-01-01T10:30:01")), (3, at("2024-01-01T10:00"), at("2024-01-02T10:00")),
    ], "i int, event timestamp_ntz, made timestamp_ntz")
    rows = df.orderBy("i").select(cl.retrospective(F.col("made"), F.col("event")), cl.retrospective(F.col("made"), F.col("event"), True)).collect()
    assert [tuple(r) for r in rows] == [(False, False), (True, True), (True, False)]


@pytest.mark.parametrize("profile,vital,cases", [
    ("infant", "heart_rate", {79: 3, 79.5: 0, 80: 1, 99: 1, 99.5: 0, 100: 0, 159: 0, 159.5: 0, 160: 1, 174: 1, 174.5: 0, 175: 3, None: 0}),
    ("infant", "respiratory_rate", {25: 3, 26: 1, 29: 1, 29.5: 0, 30: 0, 59: 0, 60: 1, 79: 1, 79.5: 0, 80: 3}),
    ("infant", "temperature_c", {36: 3, 36.1: 1, 36.5: 1, 36.6: 0, 37.5: 1, 37.9: 1, 37.95: 0, 38: 3}),
    ("infant", "o2_sat", {89: 3, 89.5: 0, 90: 1, 94: 1, 95: 0}),
    ("infant", "glucose", {2.5: 3, 2.6: 0, 8.3: 0, 8.4: 3}),
    ("maternal", "bp_systolic", {79: 3, 80: 0, 139: 0, 139.5: 1, 159: 1, 160: 3}),
    ("maternal", "bp_diastolic", {50: 3, 51: 0, 89: 0, 90: 1, 109: 1, 110: 3}),
    ("maternal", "heart_rate", {39: 3, 40: 2, 49: 2, 50: 0, 119: 0, 120: 2, 130: 2, 131: 3}),
    ("maternal", "respiratory_rate", {11: 2, 12: 0, 26: 0, 27: 2}),
    ("maternal", "temperature_c", {34.9: 3, 35: 0, 37.9: 0, 38: 1, 38.2: 1, 38.3: 2, 39.9: 2, 40: 3}),
    ("maternal", "o2_sat", {93: 3, 94: 2, 95: 2, 96: 0}),
    ("maternal", "fhr", {109: 3, 110: 0, 160: 0, 161: 3}),
])
def test_bands(spark, profile, vital, cases):
    values = [None if v is None else float(v) for v in cases]
    out = column(spark, values, sc.band_score(F.col("v"), sc.PROFILES[profile][vital]), "double")
    assert out == list(cases.values())


def test_priority_labels(spark):
    assert column(spark, [0, 1, 2, 3, 9], sc.priority_label(F.col("v")), "int") == ["Normal", "Prompt", "Urgent", "STAT", "STAT"]


def test_newborn_days(spark):
    born = dt.moment("2024-01-01T23:00")
    out = column(spark, [at("2023-12-31"), at("2024-01-01"), at("2024-01-30"), at("2024-01-31")], rg.newborn(born, F.col("v")), "timestamp_ntz")
    assert out == [False, True, True, False]


def test_range_flags_worst_first(spark):
    bounds = (30, 79, 80, 159, 160, 300)
    values = [29.0, 30.0, 79.0, 79.5, 80.0, 159.0, 159.5, 160.0, 300.0, 301.0, None]
    assert column(spark, values, rg.range_flag(F.col("v"), bounds), "double") == [
        "below_absolute", "critical_low", "critical_low", "low", "normal", "normal", "high", "critical_high", "critical_high", "above_absolute", None,
    ]
    assert column(spark, [100.0, 101.0], rg.range_flag(F.col("v"), (30, 89, 90, 100, None, 100)), "double") == ["normal", "above_absolute"]


def test_body_mass_index(spark):
    df = spark.createDataFrame([(70.0, 175.0), (70.0, 0.0), (None, 175.0)], "w double, h double")
    assert [r[0] for r in df.select(cl.body_mass_index(F.col("w"), F.col("h"))).collect()] == [22.9, None, None]


def test_similar_patients_stays_linear_and_loses_no_pair(spark):
    rows = [(i, "v", "s", f"m{i % 3}", "placeholder" if i < 300 else f"p{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "person_id bigint, village string, section string, mothers_first_name string, phone string")
    out = rg.similar_patients(df).collect()
    assert len(out) <= 2 * len(rows)
    links = {}

    def root(x):
        while links.get(x, x) != x:
            x = links[x]
        return x

    for r in out:
        links[root(r["person_id"])] = root(r["anchor_id"])
        a, b = rows[r["anchor_id"]], rows[r["person_id"]]
        assert r["score"] == sum(w for f, w in zip((1, 2, 3, 4), (1, 1, 3, 20)) if a[f] == b[f])
    for a in rows:
        for b in rows[a[0] + 1:]:
            if sum(w for f, w in zip((1, 2, 3, 4), (1, 1, 3, 20)) if a[f] == b[f]) >= 5:
                assert root(a[0]) == root(b[0])


def test_sufficient_fields():
    assert rg.sufficient_fields({"a": 1, "b": 1, "c": 3, "d": 20}, 5) == [("d",), ("a", "b", "c")]
    assert rg.sufficient_fields({"a": 1, "b": 1}, 5) == []


def test_parameters():
    given = bind_parameters({"startDate": "2024-01-01", "endDate": None, "who": 3}, {"shift": "evening"})
    assert (given.start_date, given.end_date, given.shift, given.extra) == (date(2024, 1, 1), None, "evening", {"who": 3})
    with pytest.raises(ValueError):
        given.window()


def test_letter_case_of_flags_and_uuids(spark):
    """The compared texts match in any letter case."""
    from wardline.operators.intervals import uuid_text_join
    from wardline.operators.programs import born_in_facility

    name = "ABCDEF00-1234-4abc-8def-0123456789AB"
    obs = spark.createDataFrame([(1, name), (2, name.lower()), (3, "text")], "obs_id int, comments string")
    persons = spark.createDataFrame([(7, name.lower()), (8, "other")], "person_id int, uuid string")
    assert sorted((r["obs_id"], r["other_person_id"], r["comments"]) for r in uuid_text_join(obs, persons).collect()) == [(1, 7, name), (2, 7, name.lower())]
    people = spark.createDataFrame([(1,), (2,), (3,)], "patient_id int")
    flags = spark.createDataFrame([(1, "test", "True", False), (2, "test", "TRUE", True), (3, "test", "false", False)], "person_id int, attribute_type string, value string, voided boolean")
    assert sorted(r["patient_id"] for r in fl.exclude_flagged_persons(people, flags, "test").collect()) == [2, 3]
    visits = spark.createDataFrame([(1,), (2,)], "visit_id int")
    marks = spark.createDataFrame([(1, 5, "True", False), (2, 5, "no", False)], "visit_id int, attribute_type_id int, value_reference string, voided boolean")
    assert {r["visit_id"]: r["inborn_outborn"] for r in born_in_facility(visits, marks, 5).collect()} == {1: "inborn", 2: "outborn"}
