"""Aggregates, ward rules, programs, files and plan shapes."""

import gzip
import re
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from catalog.reports import PLACES, clinic, ward_clinic
from catalog.views import Tables
from tests.conftest import at
from wardline.functions.dates import moment
from wardline.operators import aggregates as ag
from wardline.operators import dictionary as dc
from wardline.operators import intervals as iv
from wardline.operators import programs as pg
from wardline.operators import ranking as rk
from wardline.operators.filters import date_range, shift_window
from wardline.plans import maternity, patients, programs, wards
from wardline.plans.clinic import Clinic
from wardline.sources.entities import load_between, load_entities, publish_view, store_entities
from wardline.sources.export import export_bundle, export_csv
from wardline.sources.reference import load_constants, load_reference_csv, unpivot_tags
from wardline.streaming import live

SMALL = "/root/testdata/sf0.001"
ADT = "encounter_id bigint, patient_id bigint, encounter_type string, encounter_datetime timestamp_ntz, location_id int, visit_id bigint, voided boolean"


def adt(spark, rows):
    return spark.createDataFrame([(i, p, k, at(w), loc, p * 10, False) for i, (p, k, w, loc) in enumerate(rows, 1)], ADT)


MOVES = [
    (1, "admission", "2024-01-01T08:00", 1), (1, "transfer", "2024-01-02T08:00", 2), (1, "transfer", "2024-01-03T08:00", 1),
    (2, "admission", "2024-01-01T08:00", 1), (2, "discharge", "2024-01-02T08:00", 1),
    (3, "admission", "2024-01-01T08:00", 2), (3, "transfer", "2024-02-10T08:00", 3),
    (4, "discharge", "2024-01-01T08:00", 1), (4, "admission", "2024-01-05T08:00", 4),
]


def test_current_location_and_census(spark):
    enc = adt(spark, MOVES)
    here = {r["patient_id"]: r["location_id"] for r in pg.current_location(enc, ["admission", "transfer"], ["discharge"]).collect()}
    assert here == {1: 1, 2: None, 3: 3, 4: 4}
    visits = spark.createDataFrame([(10,), (20,), (30,), (40,)], "visit_id bigint")
    present = pg.present_patients(enc, visits, ["admission", "transfer"], ["discharge"], [1, 2, 4])
    assert sorted(map(tuple, present.collect())) == [(1, 1), (4, 4)]
    # The same balance as the rows that have no later leave or entry elsewhere.
    enter = enc.filter("encounter_type <> 'discharge'")
    kept = iv.no_later(enter, enc, "patient_id", "encounter_datetime", "encounter_datetime", "location_id", F.col("encounter_type") == "discharge")
    assert {(r["location_id"], r["patient_id"]) for r in kept.collect()} == {(1, 1), (3, 3), (4, 4)}


def test_previous_location_default_and_quirk(spark):
    enc = adt(spark, MOVES).filter("encounter_type <> 'discharge'")
    before = {r["encounter_id"]: r["previous_location"] for r in pg.previous_location(enc).collect()}
    other = {r["encounter_id"]: r["previous_location"] for r in pg.previous_location(enc, quirk=True).collect()}
    assert before == {1: None, 2: 1, 3: 2, 4: None, 6: None, 7: 2, 9: None}
    assert other == {1: 1, 2: 1, 3: 2, 4: None, 6: 3, 7: 2, 9: None}


def test_scaffold_drops_only_named_empty_rows(spark):
    rows = spark.createDataFrame([("A",), ("B",), ("C",)], "ward string")
    counts = spark.createDataFrame([("A", 2, None), ("Z", 1, 1)], "ward string, x int, y int")
    out = ag.scaffold_zero_fill(rows, counts, "ward", ["x", "y"], ["B"])
    assert sorted(map(tuple, out.collect())) == [("A", 2, 0), ("C", 0, 0)]


def test_total_row_and_string_agg(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 3, "y"), ("b", 1, "z")], "k string, n int, s string")
    assert sorted(map(tuple, ag.total_row(df, "k", ["n"]).collect())) == [("Total", 7), ("a", 3), ("b", 4)]
    assert sorted(map(tuple, ag.string_agg(df, ["k"], "s", "n", "l", " | ").collect())) == [("a", "x"), ("b", "z | y")]


def test_one_visit_has_no_previous(spark):
    df = spark.createDataFrame([(1, at("2024-01-01"), 5.0)], "p int, t timestamp_ntz, v double")
    got = rk.latest_previous_baseline(df, ["p"], ["t"], ["v"]).head()
    assert (got["latest_v"], got["previous_v"], got["baseline_v"]) == (5.0, None, 5.0)


def test_labels_fall_back_to_the_default_locale(spark):
    names = spark.createDataFrame([(1, "en", "one"), (1, "fr", "un"), (2, "en", "two"), (3, "es", "tres")], "concept_id int, locale string, name string")
    got = {r["concept_id"]: r["label"] for r in dc.labels(names, "fr").collect()}
    assert got == {1: "un", 2: "two"}


def test_codebook_names_missing_roles(spark):
    mapping = spark.createDataFrame([("S", "1", 11), ("S", "1", 10), ("S", "two", 12)], "source string, code string, concept_id int")
    assert dc.codebook(mapping, {"a": ("S", "1"), "b": ("S", "two")}) == {"a": 10, "b": 12}
    try:
        dc.codebook(mapping, {"c": ("S", "3")})
        raise AssertionError("expected a KeyError")
    except KeyError as error:
        assert "c" in str(error)


def test_states(spark):
    enrolments = spark.createDataFrame([(1, 7), (2, 8)], "patient_program_id bigint, patient_id bigint")
    states = spark.createDataFrame([
        (1, 1, 5, at("2024-01-01"), at("2024-01-10"), False), (2, 1, 6, at("2024-01-10"), None, False), (3, 1, 5, at("2024-01-11"), None, True),
    ], "patient_state_id bigint, patient_program_id bigint, state int, start_date timestamp_ntz, end_date timestamp_ntz, voided boolean")
    flow = spark.createDataFrame([(5, 1, 55), (6, 1, 66)], "program_workflow_state_id int, program_workflow_id int, concept_id int")
    labels = spark.createDataFrame([(55, "first"), (66, "second")], "concept_id int, label string")
    now = {r["patient_program_id"]: r["program_state"] for r in pg.current_program_state(enrolments, states, flow, 1, labels).collect()}
    assert now == {1: "second", 2: None}
    then = pg.current_program_state(enrolments, states, flow, 1, labels, at=moment("2024-01-05"))
    assert {r["patient_program_id"]: r["program_state"] for r in then.collect()} == {1: "first", 2: None}


def test_delivery_summary_counts_listed_kinds_only(spark):
    t = Tables(spark, SMALL)
    base = ward_clinic(t)
    codes = base.codes
    rows = []

    def baby(group, kind=None, outcome=None):
        encounter = group
        rows.append((group * 10, encounter, codes["delivery_datetime"], group, at("2024-01-10T08:00"), None))
        if kind:
            rows.append((group * 10 + 1, encounter, codes["delivery_type"], group, None, kind))
        if outcome:
            rows.append((group * 10 + 2, encounter, codes["birth_outcome"], group, None, outcome))

    baby(1, 311, 321)
    baby(2, 315, 321)  # a kind without a column
    baby(3, None, 322)
    baby(4, 313, 999)  # an outcome without a row
    obs = spark.createDataFrame(rows, "obs_id bigint, encounter_id bigint, concept_id int, obs_group_id bigint, value_datetime timestamp_ntz, value_coded int")
    obs = obs.withColumns({"voided": F.lit(False), "obs_datetime": moment("2024-01-10")})
    enc = spark.createDataFrame([(i, 1, "delivery", at("2024-01-10"), 1, 10, False) for i in range(1, 5)], ADT)
    names = spark.createDataFrame([(321, "en", "Livebirth"), (322, "en", "Fresh Stillbirth"), (999, "en", "Other")], "concept_id int, locale string, name string")
    small = Clinic({**base.tables, "obs": obs, "encounter": enc, "concept_name": names}, base.as_of, codes, base.types, base.identifiers, PLACES)
    out = {r["outcome"]: tuple(r)[1:] for r in wards.delivery_summary(small, shift_window("2024-01-10", "evening", True)).collect()}
    assert out == {
        "Livebirth": (1, 0, 0, 0, 1), "Fresh Stillbirth": (0, 0, 0, 1, 1), "Macerated Stillbirth": (0, 0, 0, 0, 0), "Total": (1, 0, 0, 1, 2),
    }


def test_reports_keep_their_anchor_rows(spark):
    t = Tables(spark, SMALL)
    live_rows = t.encounter.filter("not voided")
    assert maternity.maternal_register(clinic(t)).count() == live_rows.filter("encounter_type = '2-HIGH'").count()
    # Sections that are not given are null columns.
    chronic = programs.chronic_encounters(clinic(t), {"diabetes_section_populated": {"questions": [1, 2, 3, 4, 5, 6, 7]}})
    assert chronic.filter("diabetes_section_populated").count() > 0 and chronic.filter("lung_section_populated is not null").count() == 0
    chronic = programs.chronic_encounters(clinic(t), {})
    assert chronic.count() == live_rows.filter("encounter_type in ('1-URGENT', '3-MEDIUM', '5-LOW')").count()
    assert chronic.select("encounter_id").distinct().count() == chronic.count()


def test_bundles_are_lazy_and_named(spark):
    base = ward_clinic(Tables(spark, SMALL))
    assert list(wards.evening_handoff(base, "2024-01-21")) == ["Current_Census", "Deliveries", "Ward_Activity", "Deaths"]
    assert list(wards.morning_handoff(base, "2024-01-21")) == list(wards.evening_handoff(base, "2024-01-21"))
    base.places = {**base.places, "postnatal": 3, "quiet": 5}
    assert list(wards.discharge_presets(base, "2024-01-15", ["postnatal", "quiet"])) == ["postnatal", "quiet"]
    assert list(maternity.register_bundle(clinic(Tables(spark, SMALL)))) == ["maternal_register", "newborn_register"]


def test_csv_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'Zoë "x" →, y', at("2024-03-05T19:05:01"), True)], "id int, name string, t timestamp_ntz, ok boolean").coalesce(1)
    target = export_csv(df, str(tmp_path), "all", datetime(2024, 3, 5, 19, 30))
    assert target.endswith("all.20240305.1930")
    parts = list(Path(target).glob("*.gz"))
    text = b"".join(gzip.open(p).read() for p in parts).decode("ISO-8859-1")
    assert text == 'id,name,t,ok\n1,"Zoë ""x"" , y",05-Mar-2024 19:05:01,true\n'
    made = export_bundle({"a": df, "b": df}, str(tmp_path), "set", datetime(2024, 3, 5, 19, 30), compress=False)
    assert set(made) == {"a", "b"} and all(list(Path(p).glob("*.csv")) for p in made.values())


def test_reference_files(spark, tmp_path):
    (tmp_path / "constants.properties").write_text("# comment\n\nprogram.a = uuid-a\nprogram.b=x=y\n")
    constants = load_constants(spark, str(tmp_path / "constants.properties"))
    assert constants == {"program.a": "uuid-a", "program.b": "x=y"}
    (tmp_path / "programs.csv").write_text('Uuid,Name,Void/Retire,Note\n${program.a},A,,"a, ""b"""\n${program.b},B,TRUE,\n${program.c},C,false,\n')
    got = load_reference_csv(spark, str(tmp_path / "programs.csv"), constants).collect()
    assert [(r["Uuid"], r["Name"], r["Note"]) for r in got] == [("uuid-a", "A", 'a, "b"'), ("${program.c}", "C", None)]
    (tmp_path / "tags.csv").write_text("Location,Visit Location,Lab 1.0\nX,TRUE,\nY,,TRUE\nZ,false,\n")
    wide = spark.read.option("header", True).csv(str(tmp_path / "tags.csv"))
    assert sorted(map(tuple, unpivot_tags(wide, "Location").collect())) == [("X", "Visit Location"), ("Y", "Lab 1.0")]


def test_entities_round_trip(spark, tmp_path):
    from wardline.sources.schemas import ENTITIES

    one = spark.createDataFrame([tuple([None] * len(ENTITIES["encounter"]))], ENTITIES["encounter"]).withColumn("encounter_datetime", moment("2024-01-05"))
    people = spark.createDataFrame([tuple([None] * len(ENTITIES["person"]))], ENTITIES["person"])
    store_entities({"encounter": one, "person": people}, str(tmp_path))
    back = load_entities(spark, str(tmp_path), ["encounter", "person"])
    assert back["encounter"].columns == ENTITIES["encounter"].fieldNames() and back["encounter"].count() == 1
    assert list(tmp_path.glob("encounter/month=2024-01"))
    assert load_between(spark, str(tmp_path), "encounter", "2024-01-01", "2024-01-05").count() == 1
    other = load_between(spark, str(tmp_path), "encounter", "2024-02-01")
    assert other.count() == 0 and "PartitionFilters: [isnotnull(month" in plan(other)
    publish_view(people, "people_now", str(tmp_path / "people"), "2")
    assert spark.table("people_now").count() == 1


def test_distinct_dispenses(spark, tmp_path):
    rows = [(1, 7, at("2024-01-01T10:00:00")), (2, 7, at("2024-01-01T10:00:30")), (3, 8, at("2024-01-01T10:00:30"))]
    df = spark.createDataFrame(rows, "id int, drug int, t timestamp_ntz").withColumn("t", F.col("t").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    live.run_to_folder(live.distinct_dispenses(stream, "t", ["drug"], 60), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 3]


# ---- plan shapes

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pivot_is_one_shuffle_and_prunes(spark):
    from wardline.operators import observations as ob

    t = Tables(spark, SMALL)
    text = plan(ob.collect_obs(t.obs, "encounter_id", [ob.number("a", 1), ob.peak("b", 2), ob.answered("c", 3, 4)]))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert "l_extendedprice" not in text and "PushedFilters: [In(l_linenumber" in text
    many = plan(ob.group_matrix(t.obs, "encounter_id", [ob.number("a", 1)], drugs={f"d{i}": i for i in range(27)}))
    assert len(re.findall(r"Exchange hashpartitioning", many)) == 2 and "Join" not in many


def test_observations_of_anchors_come_by_encounter_once(spark):
    """One shuffle of the observations, one that finds their groups, one of the anchors; repeated anchors double nothing."""
    from wardline.operators import observations as ob

    base = clinic(Tables(spark, SMALL))
    anchors = base.encounters("chronic").select("encounter_id")
    odd = anchors.unionAll(anchors).unionAll(spark.createDataFrame([(None,)], "encounter_id bigint"))
    wants = [ob.tally("n", list(range(8))), *[ob.number(f"c{i}", i) for i in range(1, 8)], *[ob.peak(f"p{i}", i) for i in range(30)]]
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(re.findall(r"Exchange hashpartitioning", plan(ob.collect_obs(base.live_obs(anchors), "encounter_id", wants)))) == 3
        made = sorted(map(tuple, ob.collect_obs(base.live_obs(odd), "encounter_id", wants).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    live_rows = base["obs"].filter("not voided").join(anchors, "encounter_id", "left_semi")
    assert made == sorted(map(tuple, ob.collect_obs(live_rows, "encounter_id", wants).collect()), key=str)


def test_top_n_limits_before_the_shuffle(spark):
    t = Tables(spark, SMALL)
    text = plan(rk.first_rows(t.obs, ["encounter_id"], [F.col("obs_id").desc()], 3))
    assert "Partial" in text.split("Exchange")[1] and text.count("WindowGroupLimit") == 2


def test_date_range_reaches_the_scan(spark):
    t = Tables(spark, SMALL)
    text = plan(date_range(t.adt, "encounter_datetime", "2024-01-03", "2024-01-04").select("encounter_id"))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text


def test_no_report_uses_nested_loops_or_python(spark):
    from catalog.registry import QUERIES

    for name, build in QUERIES.items():
        if name.startswith("stream_") or name in ("materialize_table", "load_reference_csv"):
            continue
        text = plan(build(spark, SMALL))
        assert "NestedLoop" not in text and "CartesianProduct" not in text, name
        assert "Python" not in text and "Pandas" not in text, name


def test_triage_is_sorted_out_by_dates(spark):
    t = Tables(spark, SMALL)
    sets = {c: "BIG" for c in patients.TRIAGE_CATEGORIES}
    every = patients.triage_export(clinic(t), sets).count()
    some = patients.triage_export(clinic(t), sets, "1996-01-01", "1996-12-31")
    assert 0 < some.count() < every
    assert some.filter(~F.year("encounter_datetime").isin(1996)).count() == 0


def test_streams_read_folders_of_part_files(spark, tmp_path):
    """Every event of a table stored as part files reaches the streams."""
    import shutil

    from catalog.registry import QUERIES
    from catalog.views import BASE_TABLES

    source = "/root/testdata/sf0.001"
    for name in BASE_TABLES:
        if name != "events":
            shutil.copy(f"{source}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{source}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    for name in ("stream_vitals_priority", "stream_current_location"):
        want = sorted(map(str, QUERIES[name](spark, source).collect()))
        assert sorted(map(str, QUERIES[name](spark, str(tmp_path)).collect())) == want and want


def test_a_version_is_written_once(spark, tmp_path):
    from wardline.sources.entities import materialize_table

    rows = spark.range(3)
    assert materialize_table(rows, str(tmp_path / "t"), "1").count() == 3
    with pytest.raises(Exception, match="already exists"):
        materialize_table(rows, str(tmp_path / "t"), "1")
    assert materialize_table(spark.range(5), str(tmp_path / "t"), "2").count() == 5


def test_dated_reports_open_their_months_only(spark, tmp_path):
    """Stored observations lie in the month of their encounter; a dated report reads those folders and loses nothing."""
    from dataclasses import replace

    whole = clinic(Tables(spark, SMALL))
    facts = {n: whole[n] for n in ("encounter", "obs")}
    store_entities(facts, str(tmp_path))
    stored = replace(whole, tables={**whole.tables, **{n: spark.read.parquet(f"{tmp_path}/{n}") for n in facts}})
    sets = {c: "BIG" for c in patients.TRIAGE_CATEGORIES}
    day = whole.encounters("triage").agg(F.min("encounter_datetime")).first()[0].date()
    month = f"{day:%Y-%m}"
    days = (f"{month}-01", f"{month}-28")
    reports = {
        "triage": (lambda c: patients.triage_export(c, sets, *days)), "maternal": (lambda c: maternity.maternal_register(c, *days)),
        "newborn": (lambda c: maternity.newborn_register(c, *days)),
    }
    for name, make in reports.items():
        one, two = make(whole), make(stored)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect())), name
        scans = [line for line in plan(two).split("\n") if "FileScan" in line and str(tmp_path) in line]
        bounded = [re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", line) for line in scans]
        bounded = [f">= {month})" in b[1] and f"<= {month})" in b[1] if b else False for b in bounded]
        facts_read = [b for b, line in zip(bounded, scans, strict=True) if "concept_id" in line]
        assert facts_read and all(facts_read), [(name, line[line.find("PartitionFilters"):][:300]) for line in scans]
        assert sum(bounded) > len(facts_read)


def _folders(df, path) -> set[str]:
    """The months whose folders the plan opens for observations, wherever it filters by them."""
    found = set()
    for line in plan(df).split("\n"):
        if "FileScan" in line and f"{path}/obs" in line and "concept_id" in line:
            filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", line)[1]
            found |= set(re.findall(r"\d{4}-\d\d", filters)) or {"all"}
    return found


def test_reports_by_visit_time_and_person_open_named_months_only(spark, tmp_path):
    """Lists that look by visit, own time, group or person find the folders in side tables and lose nothing."""
    from dataclasses import replace

    from catalog.reports import ward_clinic
    from wardline.sources.months import load_indexes

    tables = Tables(spark, SMALL)
    ward, general = ward_clinic(tables), clinic(tables, True)
    shift = shift_window("2024-01-21", "morning", True)

    def kept(c, path):
        facts = {n: c[n] for n in ("encounter", "obs")}
        store_entities(facts, path)
        read = {n: spark.read.parquet(f"{path}/{n}") for n in facts}
        return replace(c, tables={**c.tables, **read, **load_indexes(spark, path)})

    ward_path, path = f"{tmp_path}/ward", f"{tmp_path}/general"
    ward_kept, kept_ = kept(ward, ward_path), kept(general, path)
    day = general.encounters("dispensing").agg(F.min("encounter_datetime")).first()[0].date()
    from catalog import reports as rp

    cases = [
        (ward, ward_kept, ward_path, lambda c: maternity.discharge_list(c, "2024-01-15", 3)),
        (ward, ward_kept, ward_path, lambda c: wards.delivery_summary(c, shift)),
        (ward, ward_kept, ward_path, lambda c: wards.death_list(c, shift)),
        (general, kept_, path, lambda c: rp.patients.diagnosis_export(c, rp._DX_SETS, "NAMES", day, day)),
    ]
    everywhere = {p.name.split("=")[1] for p in Path(path).glob("obs/enc_month=*")}
    for before, after, where, make in cases:
        one, two = make(before), make(after)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        assert "all" not in _folders(two, where)
    assert len(_folders(two, path)) <= 4 < len(everywhere)


def test_month_indexes_find_what_lies_apart(spark, tmp_path):
    """Visits over several months, groups over two encounters, events of another month, and rows without any time."""
    from wardline.sources import months as mt

    encounter = spark.sql("""SELECT * FROM VALUES (1L, 10L, TIMESTAMP_NTZ'2024-01-31 23:00:00'), (2L, 10L, TIMESTAMP_NTZ'2024-03-01 00:00:00'),
        (3L, 11L, CAST(NULL AS TIMESTAMP_NTZ)), (4L, CAST(NULL AS BIGINT), TIMESTAMP_NTZ'2024-05-05 00:00:00') AS t(encounter_id, visit_id, encounter_datetime)""")
    obs = spark.sql("""SELECT * FROM VALUES
        (1L, 7L, 1L, 50, 100L, TIMESTAMP_NTZ'2024-02-02 00:00:00', TIMESTAMP_NTZ'2024-12-24 00:00:00'),
        (2L, 7L, 2L, 51, 100L, TIMESTAMP_NTZ'2024-03-01 00:00:00', CAST(NULL AS TIMESTAMP_NTZ)),
        (3L, 8L, 3L, 50, CAST(NULL AS BIGINT), CAST(NULL AS TIMESTAMP_NTZ), TIMESTAMP_NTZ'2023-07-01 00:00:00'),
        (4L, 8L, 99L, 52, 101L, TIMESTAMP_NTZ'2022-02-02 00:00:00', CAST(NULL AS TIMESTAMP_NTZ)),
        (5L, CAST(NULL AS BIGINT), 4L, 52, 101L, TIMESTAMP_NTZ'2022-02-02 00:00:00', CAST(NULL AS TIMESTAMP_NTZ))
        AS t(obs_id, person_id, encounter_id, concept_id, obs_group_id, obs_datetime, value_datetime)""")
    path = str(tmp_path)
    store_entities({"encounter": encounter, "obs": obs}, path)
    index = mt.load_indexes(spark, path)
    assert {r["enc_month"] for r in spark.read.parquet(f"{path}/obs").collect()} == {"2024-01", "2024-03", "undated", "2022-02", "2024-05"}
    visits = spark.sql("SELECT 10L AS visit_id")
    assert mt.of_visits(index["obs_months_by_visit"], visits, "2024-03-01", "2024-03-31") == ["2024-01", "2024-03"]
    assert mt.of_visits(index["obs_months_by_visit"], visits, "2024-02-01", "2024-02-28") == []
    times = index["obs_months_by_time"]
    assert mt.of_times(times, [50], "value_datetime", "2024-12-24", "2024-12-24") == ["2024-01"]
    assert mt.of_times(times, [50], "value_datetime", None, "2023-12-31") == ["undated"]
    assert mt.of_times(times, [51], "obs_datetime") == ["2024-03"]
    assert mt.of_persons(index["obs_months_by_person"], spark.sql("SELECT 8L AS person_id")) == ["2022-02", "undated"]
    assert mt.with_groups(index["obs_months_by_group"], ["2024-01"]) == ["2024-01", "2024-03"]
    assert mt.with_groups(index["obs_months_by_group"], []) == []
    store_entities({"obs": obs}, f"{path}/alone")
    assert mt.load_indexes(spark, f"{path}/alone") == {} == mt.load_indexes(spark, f"{path}/nothing")


def test_dated_reports_keep_observations_of_other_months(spark, tmp_path):
    """Observations stored alone, or with a month of the user's own, are cut by their encounters only."""
    from dataclasses import replace

    whole = clinic(Tables(spark, SMALL))
    day = whole.encounters("triage").agg(F.min("encounter_datetime")).first()[0].date()
    days = (f"{day:%Y-%m}-01", f"{day:%Y-%m}-28")
    late = whole["obs"].withColumn("obs_datetime", F.col("obs_datetime") + F.expr("interval 70 days"))
    store_entities({"obs": late}, f"{tmp_path}/alone")
    sets = {c: "BIG" for c in patients.TRIAGE_CATEGORIES}
    want, *found = (
        sorted(map(str, patients.triage_export(replace(whole, tables={**whole.tables, "obs": obs}), sets, *days).collect()))
        for obs in (late, spark.read.parquet(f"{tmp_path}/alone/obs"), late.withColumn("month", F.lit("1999-12")))
    )
    assert want and found == [want, want]
    store_entities({"encounter": whole["encounter"], "obs": late}, f"{tmp_path}/both")
    assert list(tmp_path.glob("both/obs/enc_month=*"))
    with pytest.raises(ValueError, match="together"):
        store_entities({"encounter": whole["encounter"]}, f"{tmp_path}/both")


def test_facts_over_jdbc_need_bounds(spark):
    from wardline.sources.entities import load_entities_jdbc

    with pytest.raises(ValueError, match="obs"):
        load_entities_jdbc(spark, "jdbc:none", ["obs", "person"], {})


@pytest.mark.parametrize(("name", "first", "last"), [
    ("chronic_encounters", "CHRONIC_ENCOUNTERS", None), ("maternal_register", "MATERNAL_REGISTER", None), ("newborn_register", "NEWBORN_REGISTER", None),
    ("delivery_form", "DELIVERY_FORM", None), ("delivery_register", "DELIVERY_REGISTER", None), ("mental_health_encounters", "MENTAL_HEALTH_ENCOUNTERS", "MENTAL_HEALTH_LAST"),
])
def test_columns_come_in_the_files_order(spark, name, first, last):
    from catalog.registry import QUERIES
    from wardline.plans import columns

    shown = QUERIES[name](spark, SMALL).columns
    front, back = getattr(columns, first), getattr(columns, last) if last else []
    assert shown[: len(front)] == front and (not back or shown[-len(back):] == back)
    assert len(set(shown)) == len(shown)
