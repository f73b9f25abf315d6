"""Change sets: what they touch, and that a second run changes nothing."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import at
from wardline.functions.dates import moment
from wardline.operators import changes as ch

def now():
    return moment("2024-06-01")


OBS = (
    "obs_id bigint, person_id bigint, encounter_id bigint, concept_id int, obs_group_id bigint, obs_datetime timestamp_ntz, value_coded int, "
    "value_numeric double, creator int, date_created timestamp_ntz, voided boolean, voided_by int, date_voided timestamp_ntz, void_reason string, "
    "previous_version bigint, uuid string"
)


def row(obs_id, encounter=1, concept=5, coded=None, number=None, group=None, voided=False):
    return (obs_id, 1, encounter, concept, group, at("2024-01-01"), coded, number, 3, at("2024-01-01"), voided, None, None, None, None, f"u{obs_id}")


@pytest.fixture
def encounters(spark):
    return spark.createDataFrame([(1, "a"), (2, "b")], "encounter_id bigint, encounter_type string")


def twice(table, make):
    one = ch.apply_changeset(table, make(table))
    two = ch.apply_changeset(one, make(one))
    return one, two


def same_rows(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("threshold,want", [(1, [500.0, 1.0, 3.9, 4.0]), (4, [500.0, 1000.0, 3900.0, 4.0])])
def test_recode_and_scale(spark, encounters, threshold, want):
    table = spark.createDataFrame([row(i, number=v) for i, v in enumerate([0.5, 1.0, 3.9, 4.0], 1)] + [row(9, encounter=2, number=0.1), row(10, number=0.1, voided=True)], OBS)
    one, two = twice(table, lambda t: ch.recode_and_scale(t, encounters, {5: 6}, ["a"], threshold, 1000, "units", now()))
    made = one.filter("concept_id = 6").orderBy("previous_version").collect()
    assert [r["value_numeric"] for r in made] == want
    assert [r["previous_version"] for r in made] == [1, 2, 3, 4]
    old = one.filter("obs_id <= 4").collect()
    assert all(r["voided"] and r["void_reason"] == "units" and r["date_voided"] == at("2024-06-01") for r in old)
    kept = {r["obs_id"]: r for r in one.filter("obs_id in (9, 10)").collect()}
    assert not kept[9]["voided"] and kept[10]["void_reason"] is None
    assert same_rows(one, two)


def test_recode_keeps_values(spark, encounters):
    table = spark.createDataFrame([row(1, number=7.0, coded=3, group=88)], OBS)
    one, two = twice(table, lambda t: ch.recode_concept(t, encounters, {5: 6}, ["a"], "moved", now(), user=42))
    new = one.filter("concept_id = 6").head()
    assert (new["value_numeric"], new["value_coded"], new["obs_group_id"], new["creator"], new["voided"]) == (7.0, 3, 88, 42, False)
    assert new["uuid"] != "u1" and len(new["uuid"]) == 36
    assert same_rows(one, two)


def test_override_answer(spark):
    table = spark.createDataFrame([row(1, coded=3), row(2, coded=9), row(3, concept=7, coded=3)], OBS)
    one, two = twice(table, lambda t: ch.override_answer(t, [5], 9, "tag", now()))
    live = one.filter("not voided")
    assert sorted((r["concept_id"], r["value_coded"], r["previous_version"]) for r in live.filter("concept_id = 5").collect()) == [(5, 9, 1), (5, 9, 2)]
    assert live.filter("concept_id = 7").count() == 1
    assert same_rows(one, two)


def test_wrap_in_group(spark, encounters):
    table = spark.createDataFrame([row(1, concept=5, coded=1), row(2, concept=6, coded=2), row(3, concept=6, coded=2, group=70), row(4, 2, 6, coded=2)], OBS)
    one, two = twice(table, lambda t: ch.wrap_in_group(t, encounters, (5, 1), (6, 2), 50, ["a"], "wrap", now()))
    heads = one.filter("concept_id = 50").collect()
    leaves = one.filter("concept_id = 6 and obs_id > 4").collect()
    assert {r["obs_id"] for r in heads} == {r["obs_group_id"] for r in leaves} and len(heads) == 2
    assert sorted(r["obs_id"] for r in one.filter("voided").collect()) == [1, 2]
    assert all(r["voided_by"] == 3 for r in one.filter("voided").collect())
    assert same_rows(one, two)


def test_split_to_groups(spark):
    table = spark.createDataFrame([row(1, coded=1)], OBS)

    def make(t):
        rows = t.filter("not voided and concept_id = 5 and value_coded = 1")
        return ch.split_to_groups(rows, [("x", 10, 11, 12), ("y", 20, 21, 22)], "split", now())

    one, two = twice(table, make)
    assert sorted(r["concept_id"] for r in one.filter("not voided").collect()) == [10, 11, 20, 21]
    pairs = one.alias("c").join(one.alias("p"), F.col("c.obs_group_id") == F.col("p.obs_id")).select("p.concept_id", "c.concept_id", "c.value_coded")
    assert sorted(map(tuple, pairs.collect())) == [(10, 11, 12), (20, 21, 22)]
    assert same_rows(one, two)


def test_new_ids_are_free(spark, encounters):
    """Any id may be taken already: no row is lost, no id is used twice."""
    taken = [row(i, concept=9) for i in (5, 6, 7, 1 << 40, (1 << 60) - 1)]
    table = spark.createDataFrame([row(1, coded=1), row(2, coded=1), *taken], OBS)
    one, two = twice(table, lambda t: ch.recode_concept(t, encounters, {5: 6}, None, "moved", now()))
    assert one.count() == 9 and one.select("obs_id").distinct().count() == 9
    assert sorted(r["previous_version"] for r in one.filter("concept_id = 6").collect()) == [1, 2]
    assert same_rows(one, two)


def test_an_insert_already_there_is_known_by_uuid(spark):
    table = spark.createDataFrame([row(1, coded=1), row(2, coded=1)], OBS)
    parts = [("x", 10, 11, 12)]

    def make(t, only):
        return ch.split_to_groups(t.filter(only), parts, "split", now())

    one = ch.apply_changeset(table, make(table, "obs_id = 1"))
    # The first candidate once more and the second anew: only the second's rows are added, and groups hold.
    two = ch.apply_changeset(one, make(table, "obs_id in (1, 2)"))
    assert two.count() == one.count() + 2
    heads = {r["obs_id"] for r in two.filter("concept_id = 10").collect()}
    assert {r["obs_group_id"] for r in two.filter("concept_id = 11").collect()} == heads and len(heads) == 2
    # Two sources that share an id lose nothing.
    double = spark.createDataFrame([row(1, coded=1), row(1, coded=1)], OBS)
    assert ch.apply_changeset(double, ch.ChangeSet("obs_id", make(double, "obs_id = 1").inserts)).select("obs_id").distinct().count() == 5


def test_candidates_are_read_once(spark):
    table = spark.createDataFrame([row(1, coded=1)], OBS)
    made = ch.split_to_groups(table.filter("concept_id = 5"), [(f"p{i}", 10 + i, 20 + i, 30 + i) for i in range(5)], "split", now())
    plan = made.inserts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "Union" not in plan


def test_slot_encounters(spark):
    enc = spark.createDataFrame([
        (1, 7, "a", at("2024-01-01T10:00"), None, False), (2, 7, "a", at("2024-01-01T18:00"), None, False), (3, 7, "a", at("2024-01-01T10:00"), None, False),
        (4, 7, "skip", at("2024-01-01T10:00"), None, False), (5, 7, "a", at("2024-01-03T10:00"), None, False), (6, 7, "a", at("2024-01-01T10:00"), 99, False),
        (7, 7, "a", at("2024-01-01T20:00"), None, False),
    ], "encounter_id bigint, patient_id bigint, encounter_type string, encounter_datetime timestamp_ntz, visit_id bigint, voided boolean")
    enc = enc.withColumns({"void_reason": F.lit(None).cast("string"), "date_voided": F.lit(None).cast("timestamp_ntz"), "voided_by": F.lit(None).cast("int")})
    obs = spark.createDataFrame([(1,), (2,), (5,), (6,), (7,)], "encounter_id bigint")
    visits = spark.createDataFrame([(50, 7, at("2024-01-01T09:00"), at("2024-01-01T12:00"))], "visit_id bigint, patient_id bigint, date_started timestamp_ntz, date_stopped timestamp_ntz")
    slots = ch.slot_encounters(enc, obs, visits, ["skip"], now())
    out = {r["encounter_id"]: r for r in ch.apply_changeset(enc, slots.encounters).collect()}
    assert {e: r["visit_id"] for e, r in out.items()} == {1: 50, 2: 50, 3: None, 4: None, 5: None, 6: 99, 7: 50}
    assert [e for e, r in out.items() if r["voided"]] == [3]
    stretched = ch.apply_changeset(visits, slots.visits).head()
    assert stretched["date_stopped"] == at("2024-01-01T20:00")


DISPENSE = (
    "medication_dispense_id bigint, drug_order_id bigint, dispenser int, dose double, status int, date_created timestamp_ntz, voided boolean, "
    "void_reason string, date_voided timestamp_ntz, voided_by int"
)


def dispense(i, order, when, dose=1.0, status=1, voided=False):
    return (i, order, 4, dose, status, at(when), voided, None, None, None)


def test_void_adjacent_duplicates(spark):
    table = spark.createDataFrame([
        dispense(1, 1, "2024-01-01T10:00:00"), dispense(2, 1, "2024-01-01T10:00:59"), dispense(3, 1, "2024-01-01T10:01:59"),  # 59 s, then 60 s
        dispense(4, 2, "2024-01-01T10:00:00"), dispense(5, 2, "2024-01-01T10:00:10", dose=2.0),  # other dose
        dispense(6, 3, "2024-01-01T10:00:00", dose=None), dispense(7, 3, "2024-01-01T10:00:10", dose=None),  # null equals nothing
        dispense(8, 4, "2024-01-31T23:59:50"), dispense(9, 4, "2024-02-01T00:00:10"),  # across a month border
        dispense(10, 5, "2024-01-01T10:00:00"), dispense(11, 5, "2024-01-01T10:00:10"),  # order with refills
        dispense(12, 6, "2024-01-01T10:00:00", status=0), dispense(13, 6, "2024-01-01T10:00:10"),  # first is not complete
    ], DISPENSE)
    orders = spark.createDataFrame([(i, False, 1 if i == 5 else 0) for i in range(1, 7)], "order_id bigint, voided boolean, num_refills int")
    make = lambda t: ch.void_adjacent_duplicates(t, orders, orders, 1, ["dispenser", "dose"], "dup", now())
    one = ch.apply_changeset(table, make(table))
    assert sorted(r["medication_dispense_id"] for r in one.filter("voided").collect()) == [2, 9]


def test_packed_addresses(spark):
    df = spark.createDataFrame([
        (1, "C|D|S", "old", "old"), (2, "C|D|S|Sec|Vil|", "old", "old"), (3, "C", "d", "s"), (4, "Plain", "d", "s"), (5, None, "d", "s"),
    ], "id int, country string, county_district string, state_province string")
    parts = ["country", "county_district", "state_province", "address1", "city_village"]
    out = {r["id"]: tuple(r[p] for p in parts) for r in ch.split_packed_address(df, "country", parts, default="Home").collect()}
    assert out == {
        1: ("C", "D", "S", "", ""), 2: ("C", "D", "S", "Sec", "Vil"), 3: ("Home", "", "", "", ""), 4: ("Plain", "d", "s", None, None), 5: (None, "d", "s", None, None),
    }


def test_few_rows_meet_a_change_set_and_none_is_missed(spark):
    table = spark.range(10_000).withColumnRenamed("id", "obs_id").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS obs_id"))
    keys = spark.createDataFrame([(5,), (77,), (77,), (None,), (20_000,)], "obs_id int")
    marked = ch._marked(table, "obs_id", keys)
    maybe = [r["obs_id"] for r in marked.filter("_maybe").collect()]
    assert {5, 77} <= set(maybe) and len(maybe) < 20 and marked.count() == 10_001


def test_updates_of_repeated_and_missing_keys_join_as_before(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "obs_id bigint, v string")
    updates = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (9, "q")], "obs_id int, v string")
    after = ch.apply_changeset(table, ch.ChangeSet("obs_id", None, updates))
    got = sorted((r["obs_id"] or 0, r["v"]) for r in after.collect())
    assert got == [(0, "d"), (1, "x"), (1, "x"), (1, "y"), (1, "y"), (2, "c"), (3, "e")]


def test_a_group_id_that_no_row_has_stays(spark):
    from types import SimpleNamespace

    from catalog.changes import applied, whole_obs

    obs = spark.createDataFrame(
        [(1, 10, 1, 2, 5, 1.0, False)], "obs_id bigint, encounter_id bigint, concept_id int, obs_group_id bigint, value_coded int, value_numeric double, voided boolean"
    )
    t = SimpleNamespace(obs=obs)
    change = ch.recode_concept(whole_obs(t), None, {1: 51}, None, "moved", now())
    rows = applied(t, change).collect()
    assert [(r["obs_group_id"], r["group_concept"]) for r in rows] == [(2, None), (2, None)]
