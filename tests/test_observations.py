"""Observation picks on hand-made edge cases."""

from pyspark.sql import functions as F

from tests.conftest import at
from wardline.operators import observations as ob
from wardline.operators.filters import not_voided

SCHEMA = (
    "obs_id bigint, person_id bigint, encounter_id bigint, concept_id int, obs_group_id bigint, obs_datetime timestamp_ntz, "
    "value_coded int, value_numeric double, value_text string, value_datetime timestamp_ntz, value_drug int, comments string, voided boolean"
)
T1, T2 = at("2024-01-01T08:00:00"), at("2024-01-01T09:00:00")


def row(obs_id, encounter, concept, when=T1, group=None, coded=None, number=None, text=None, moment=None, drug=None, comment=None, voided=False, person=1):
    return (obs_id, person, encounter, concept, group, when, coded, number, text, moment, drug, comment, voided)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark):
    return spark.createDataFrame([(c, f"L{c}") for c in range(1, 60)], "concept_id int, label string")


def as_dict(df, key="encounter_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_latest_breaks_ties_by_id_and_skips_nulls_and_voided(spark):
    obs = frame(spark, [
        row(1, 1, 5, number=10.0), row(2, 1, 5, number=20.0),  # same time: higher id
        row(3, 2, 5, number=30.0), row(4, 2, 5, T2),  # newest has no value
        row(5, 3, 5, number=50.0), row(6, 3, 5, T2, number=60.0, voided=True),  # newest is voided
        row(7, 4, 6, number=1.0),  # asked something else
    ])
    got = as_dict(ob.collect_obs(not_voided(obs), "encounter_id", [ob.number("n", 5), ob.number("m", 6)]))
    assert {e: got[e]["n"] for e in got} == {1: 20.0, 2: 30.0, 3: 50.0, 4: None}
    assert got[4]["m"] == 1.0


def test_result_does_not_depend_on_layout(spark):
    rows = [row(i, i % 7, 5, T1, number=float(i), coded=i % 4) for i in range(200)]
    wants = [ob.number("n", 5), ob.answer_list("l", 5), ob.tally("t", 5, 2), ob.first_obs("f", 5)]
    one = ob.collect_obs(frame(spark, rows).coalesce(1), "encounter_id", wants, labels(spark))
    many = ob.collect_obs(frame(spark, rows[::-1]).repartition(9), "encounter_id", wants, labels(spark))
    assert sorted(one.collect()) == sorted(many.collect())


def test_flags_keep_false_and_null_apart(spark):
    anchors = spark.createDataFrame([(1,), (2,), (3,), (4,)], "encounter_id bigint")
    obs = frame(spark, [row(1, 1, 5, coded=1), row(2, 2, 5, coded=2), row(3, 3, 5, coded=9)])
    wants = [ob.yes_no("yn", 5, 1, 2), ob.answered("has", 5, 1), ob.answered_or_null("null_has", 5, 1), ob.answer_label("lab", 5, 1), ob.tally("n", 5, 1)]
    got = as_dict(ob.register(anchors, obs, wants, label_table=labels(spark)))
    assert [got[e]["yn"] for e in (1, 2, 3, 4)] == [True, False, None, None]
    assert [got[e]["has"] for e in (1, 2, 3, 4)] == [True, False, False, False]
    assert [got[e]["null_has"] for e in (1, 2, 3, 4)] == [True, None, None, None]
    assert [got[e]["lab"] for e in (1, 2, 3, 4)] == ["L1", None, None, None]
    assert [got[e]["n"] for e in (1, 2, 3, 4)] == [1, 0, 0, 0]


def test_register_keeps_every_anchor_once(spark):
    anchors = spark.range(1, 50).withColumnRenamed("id", "encounter_id")
    obs = frame(spark, [row(i, i % 10, 5, number=float(i)) for i in range(100)])
    out = ob.register(anchors, obs, [ob.number("n", 5)])
    assert out.count() == 49 and out.select("encounter_id").distinct().count() == 49


def test_literals_are_quoted(spark):
    obs = frame(spark, [row(1, 1, 5, text="it's"), row(2, 1, 5, T2, text="a\\b")])
    got = ob.collect_obs(obs, "encounter_id", [ob.Want("x", "list", (5,), "value_text", separator="' \\ ")]).head()
    assert got["x"] == "a\\b' \\ it's"


def test_three_babies_one_without_outcome(spark):
    obs = frame(spark, [
        row(10, 1, 300), row(11, 1, 303, group=10, coded=21), row(20, 1, 300), row(21, 1, 303, group=20, coded=22),
        row(30, 1, 300), row(31, 1, 302, group=30, coded=11),
    ])
    got = as_dict(ob.group_values(obs, [ob.label("outcome", 303), ob.label("kind", 302)], labels(spark)), "obs_group_id")
    assert {g: (r["outcome"], r["kind"]) for g, r in got.items()} == {10: ("L21", None), 20: ("L22", None), 30: (None, "L11")}
    assert ob.nth_obs(obs, "encounter_id", 300, 2).head()["obs_id"] == 30
    assert ob.nth_obs(obs, "encounter_id", 300, 3).count() == 0


def test_constructs_share_a_child_question(spark):
    obs = frame(spark, [
        row(10, 1, 41), row(11, 1, 5, group=10, coded=1), row(12, 1, 5, group=10, coded=2), row(20, 1, 42), row(21, 1, 5, group=20, coded=3),
    ])
    got = ob.construct_children(obs, {"prior": 41, "final": 42}, [ob.answer_list("dx", 5, ",")], label_table=labels(spark)).head()
    assert (got["prior_dx"], got["final_dx"]) == ("L1,L2", "L3")


def test_group_matrix_by_head_lead_and_drug(spark):
    obs = frame(spark, [
        row(10, 1, 41), row(11, 1, 5, group=10, number=1.5), row(12, 1, 41), row(13, 1, 5, group=12, number=9.0),
        row(20, 1, 6, group=70, coded=8), row(21, 1, 5, group=70, number=2.5),
        row(30, 1, 7, group=80, drug=3), row(31, 1, 5, group=80, number=3.5), row(32, 1, 7, group=81, drug=3), row(33, 1, 5, group=81, number=7.0),
        row(40, 2, 5, number=4.0),
    ])
    out = ob.group_matrix(
        obs, "encounter_id", [ob.number("v", 5)], constructs={"head": 41, "none": 42}, leads={"lead": (6, 8)}, drugs={"drug": 3}
    )
    rows = out.collect()
    assert len(rows) == 1
    assert (rows[0]["head_v"], rows[0]["none_v"], rows[0]["lead_v"], rows[0]["drug_v"]) == (1.5, None, 2.5, 3.5)


def test_nested_construct_is_child_and_head(spark):
    obs = frame(spark, [row(10, 1, 41), row(11, 1, 42, group=10, number=5.0), row(12, 1, 5, group=11, number=6.0)])
    got = ob.group_matrix(obs, "encounter_id", [ob.number("inner", 42), ob.number("leaf", 5)], constructs={"a": 41, "b": 42}).head()
    assert (got["a_inner"], got["a_leaf"], got["b_inner"], got["b_leaf"]) == (5.0, None, None, 6.0)


def test_same_drug_twice_reads_the_first_group(spark):
    obs = frame(spark, [
        row(1, 1, 7, group=80, drug=3), row(2, 1, 5, group=80, number=1.0), row(3, 1, 7, group=81, drug=3), row(4, 1, 5, group=81, number=2.0),
        row(5, 1, 7, group=80, drug=4),
    ])
    got = ob.drug_attribute_matrix(obs, "encounter_id", {"a": 3, "b": 4}, [ob.number("dose", 5)]).head()
    assert (got["a_dose"], got["b_dose"]) == (1.0, 1.0)


def test_answer_in_two_sets_fills_both(spark):
    sets = spark.createDataFrame([(1, 91), (1, 92), (2, 92)], "concept_id int, concept_set int")
    obs = frame(spark, [row(5, 1, 6, coded=2), row(4, 1, 6, coded=1), row(6, 2, 6, coded=2)])
    got = as_dict(ob.category_symptoms(obs, "encounter_id", 6, sets, {"a": 91, "b": 92}, labels(spark)))
    assert (got[1]["a"], got[1]["b"]) == ("L1", "L1")
    assert (got[2]["a"], got[2]["b"]) == (None, "L2")


def test_preference_sections_and_yes_questions(spark):
    obs = frame(spark, [
        row(1, 1, 6, coded=3), row(2, 1, 6, coded=4), row(3, 1, 7, coded=1), row(4, 1, 8, coded=1, group=9), row(5, 2, 9, coded=7),
    ])
    wants = [ob.preferred("kind", 6, [4, 3]), ob.section("s", [7], [7]), ob.yes_questions("risk", [7, 8], 1)]
    got = as_dict(ob.collect_obs(obs, "encounter_id", wants, labels(spark)))
    assert (got[1]["kind"], got[1]["s"], got[1]["risk"]) == ("L4", True, "L7")
    assert (got[2]["kind"], got[2]["s"], got[2]["risk"]) == (None, True, None)


def test_latest_answer_list_takes_one_encounter(spark):
    obs = frame(spark, [row(1, 1, 5, T1, coded=1), row(2, 2, 5, T2, coded=2), row(3, 2, 5, T1, coded=3)])
    got = ob.latest_answer_lists(obs, "person_id", {"x": 5}, labels(spark)).head()
    assert got["x"] == "L2 | L3"


def test_latest_before_is_strict(spark):
    obs = frame(spark, [row(1, 1, 5, T1, coded=1), row(2, 1, 5, T2, coded=2)]).withColumn("visit_id", F.lit(1))
    enc = spark.createDataFrame([(1, 1, 100, T1), (1, 1, 101, T2), (1, 2, 102, T2)], "person_id bigint, visit_id int, encounter_id bigint, encounter_datetime timestamp_ntz")
    got = as_dict(ob.latest_before_encounter(enc, obs, 5, ["value_coded"]))
    assert {e: r["value_coded"] for e, r in got.items()} == {100: None, 101: 1, 102: 1}
    got = as_dict(ob.latest_before_encounter(enc, obs, 5, ["value_coded"], same_visit=True))
    assert {e: r["value_coded"] for e, r in got.items()} == {100: None, 101: 1, 102: None}


def test_both_ways_of_a_pivot_agree(spark):
    """Cells and the single aggregate give the same rows, at 24 and at 25 columns."""
    rows = [
        row(i, i % 9, 1 + i % 13, (T1, T2)[i % 2], number=float(i % 5), coded=1 + i % 4, text=f"t{i % 3}", comment=f"c{i % 2}", group=i % 3 or None) for i in range(400)
    ]
    kinds = [lambda n, c: ob.number(n, c), lambda n, c: ob.answer_list(n, c), lambda n, c: ob.tally(n, c, 2), lambda n, c: ob.yes_no(n, c, 1, 2), lambda n, c: ob.text(n, c)]
    wants = [kinds[i % 5](f"w{i}", 1 + i % 13) for i in range(25)]
    for count in (24, 25):
        one, two = (
            ob.collect_obs(frame(spark, rows), "encounter_id", wants[:count], labels(spark), wide_from=limit).collect() for limit in (0, 100)
        )
        assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == 9
