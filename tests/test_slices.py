"""Ordered operators and span joins against brute force, with one key holding most rows."""

import random
from datetime import datetime, timedelta

import pytest

from tests.conftest import at
from wardline.functions.dates import moment
from wardline.operators import intervals as iv
from wardline.operators import slices as sl
from wardline.operators import sweeps as sw
from wardline.operators.aggregates import ordered_text

START = datetime(2023, 11, 28)


def made(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 1 if rng.random() < 0.7 else rng.randint(2, 6)
        rows.append((i, key, START + timedelta(hours=rng.randint(0, 24 * 90)), rng.randint(0, 9)))
    return rows


@pytest.fixture
def rows(spark):
    data = made(1)
    return data, spark.createDataFrame(data, "id bigint, key int, at timestamp_ntz, v int")


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_number_rows(rows, ranges):
    data, df = rows
    got = {r["id"]: (r["index_asc"], r["index_desc"]) for r in sw.number_rows(df, ["key"], "at", ["id"], ranges=ranges).collect()}
    assert len(got) == len(data)
    for key in {r[1] for r in data}:
        ordered = sorted((r for r in data if r[1] == key), key=lambda r: (r[2], r[0]))
        for place, r in enumerate(ordered, 1):
            assert got[r[0]] == (place, len(ordered) - place + 1)


@pytest.mark.parametrize("ranges", [1, 30])
def test_previous_values(rows, ranges):
    data, df = rows
    got = {r["id"]: r["previous_v"] for r in sw.previous_values(df, ["key"], "at", ["id"], ["v"], ranges=ranges).collect()}
    for key in {r[1] for r in data}:
        ordered = sorted((r for r in data if r[1] == key), key=lambda r: (r[2], r[0]))
        assert got[ordered[0][0]] is None
        for before, r in zip(ordered, ordered[1:]):
            assert got[r[0]] == before[3]


@pytest.mark.parametrize("grain,strict", [("timestamp", False), ("timestamp", True), ("day", False)])
def test_asof_backward(spark, rows, grain, strict):
    data, df = rows
    points = made(2, 60)
    pdf = spark.createDataFrame(points, "pid bigint, key int, start timestamp_ntz, w int")
    out = sw.asof_backward(df, pdf, ["key"], "at", "start", ["pid"], order=["pid"], grain=grain, strict=strict).collect()
    assert len(out) == len(data)
    got = {r["id"]: r["pid"] for r in out}
    for i, key, when, _ in data:
        def before(p):
            if grain == "day":
                return p[2].date() <= when.date()
            return p[2] < when if strict else p[2] <= when
        fitting = [p for p in points if p[1] == key and before(p)]
        want = max(fitting, key=lambda p: (p[2], p[0]))[0] if fitting else None
        assert got[i] == want


@pytest.mark.parametrize("horizon", ["2023-12-15", "2024-01-10", "2030-01-01"])
@pytest.mark.parametrize("unit", ["day", "month"])
def test_range_join_does_not_depend_on_slices(spark, rows, horizon, unit):
    data, df = rows
    rng = random.Random(3)
    spans = []
    for i in range(60):
        start = START + timedelta(hours=rng.randint(0, 24 * 90))
        stop = None if i % 5 == 0 else start + timedelta(hours=rng.randint(-30, 24 * 40))
        spans.append((i, 1 if i % 3 else rng.randint(2, 6), start, stop))
    sdf = spark.createDataFrame(spans, "sid bigint, key int, start timestamp_ntz, stop timestamp_ntz")
    out = sl.range_join(df, sdf, ["key"], "at", "start", "stop", moment(horizon), unit)
    got = sorted((r["id"], r["sid"]) for r in out.collect())
    want = sorted(
        (i, s) for i, key, when, _ in data for s, skey, a, b in spans if key == skey and a <= when and (b is None or when <= b)
    )
    assert got == want


def test_interval_contains_prefers_inside_then_same_day(spark):
    visits = spark.createDataFrame([
        (1, 7, at("2024-01-01T08:00"), at("2024-01-01T12:00")), (2, 7, at("2024-01-01T09:00"), at("2024-01-02T10:00")),
        (3, 7, at("2024-01-05T09:00"), at("2024-01-05T10:00")), (4, 7, at("2024-01-09T09:00"), None),
    ], "visit_id bigint, patient_id bigint, date_started timestamp_ntz, date_stopped timestamp_ntz")
    events = spark.createDataFrame([
        (1, 7, at("2024-01-01T10:00")), (2, 7, at("2024-01-02T15:00")), (3, 7, at("2024-01-04T10:00")), (4, 7, at("2024-01-05T09:00")),
        (5, 7, at("2023-12-31T10:00")), (6, 7, at("2024-01-09T10:00")),
    ], "event_id bigint, patient_id bigint, at timestamp_ntz")
    out = iv.interval_contains(events, visits, "patient_id", "at")
    assert {r["event_id"]: r["visit_id"] for r in out.collect()} == {1: 2, 2: 2, 3: None, 4: 3, 5: None, 6: None}


def test_visit_of_event(spark):
    visits = spark.createDataFrame([(1, 7, at("2024-01-05T10:00")), (2, 7, at("2024-03-05T10:00"))], "visit_id bigint, patient_id bigint, date_started timestamp_ntz")
    events = spark.createDataFrame([
        (1, 7, at("2024-01-05T09:00")), (2, 7, at("2024-01-05T10:00")), (3, 7, at("2024-02-20T10:00")), (4, 8, at("2024-02-20T10:00")),
    ], "id bigint, patient_id bigint, event_at timestamp_ntz")
    stamp = {r["id"]: r["visit_id"] for r in iv.visit_of_event(events, visits).collect()}
    days = {r["id"]: r["visit_id"] for r in iv.visit_of_event(events, visits, grain="day").collect()}
    assert stamp == {1: None, 2: 1, 3: 1, 4: None}
    assert days == {1: 1, 2: 1, 3: 1, 4: None}


def test_enrolment_window_counts_whole_days(spark):
    spans = spark.createDataFrame([
        (1, 7, at("2024-01-05T10:00"), at("2024-01-05T10:30")), (2, 7, at("2024-01-05T23:00"), None), (3, 7, at("2024-01-01T00:00"), at("2024-01-06T01:00")),
    ], "patient_program_id bigint, patient_id bigint, date_enrolled timestamp_ntz, date_completed timestamp_ntz")
    enc = spark.createDataFrame([
        (1, 7, at("2024-01-05T01:00")), (2, 7, at("2024-01-06T23:00")), (3, 7, at("2024-05-01T00:00")),
    ], "encounter_id bigint, patient_id bigint, encounter_datetime timestamp_ntz")
    out = iv.enrolment_window(spans, enc, moment("2024-01-31"))
    assert sorted((r["patient_program_id"], r["encounter_id"]) for r in out.collect()) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)]
    best = iv.enrolment_of_encounter(enc, spans, moment("2024-01-31"))
    assert {r["encounter_id"]: r["patient_program_id"] for r in best.collect()} == {1: 2, 2: 2, 3: 2}


def test_no_later_elsewhere(spark):
    rows = spark.createDataFrame([
        (1, 7, "in", 1, at("2024-01-01T08:00")), (2, 7, "move", 2, at("2024-01-02T08:00")), (3, 7, "move", 1, at("2024-01-03T08:00")),
        (4, 8, "in", 1, at("2024-01-01T08:00")), (5, 8, "out", 9, at("2024-01-02T08:00")),
        (6, 9, "in", 1, at("2024-01-01T08:00")), (7, 9, "move", 1, at("2024-01-02T08:00")),
    ], "id bigint, patient bigint, kind string, place int, at timestamp_ntz")
    from pyspark.sql import functions as F

    enter = rows.filter("kind <> 'out'")
    kept = iv.no_later(enter, rows, "patient", "at", "at", elsewhere="place", leave=F.col("kind") == "out")
    assert sorted(r["id"] for r in kept.collect()) == [3, 6, 7]


def test_interval_contains_against_brute_force(spark):
    rng = random.Random(5)
    spans = []
    for i in range(80):
        start = START + timedelta(hours=rng.randint(0, 24 * 60))
        spans.append((i, 1 if i % 4 else 2, start, None if i % 9 == 0 else start + timedelta(hours=rng.randint(0, 200))))
    sdf = spark.createDataFrame(spans, "visit_id bigint, key int, date_started timestamp_ntz, date_stopped timestamp_ntz")
    data = made(6, 300)
    df = spark.createDataFrame(data, "id bigint, key int, at timestamp_ntz, v int")
    got = {r["id"]: r["visit_id"] for r in iv.interval_contains(df, sdf, "key", "at").collect()}
    for i, key, when, _ in data:
        closed = [s for s in spans if s[1] == key and s[3] is not None]
        inside = [s for s in closed if s[2] <= when <= s[3]]
        earlier = [s for s in closed if s[3].date() == when.date() and s[3] < when]
        fit = inside or earlier
        assert got[i] == (max(fit, key=lambda s: (s[3], s[0]))[0] if fit else None)


def test_rows_without_a_key(spark):
    df = spark.createDataFrame([(1, None, at("2024-01-01"), 5), (2, 7, at("2024-01-02"), 6)], "id bigint, key int, at timestamp_ntz, v int")
    numbered = {r["id"]: (r["index_asc"], r["index_desc"]) for r in sw.number_rows(df, ["key"], "at", ["id"]).collect()}
    assert numbered == {1: (None, None), 2: (1, 1)}
    found = sw.asof_backward(df, df.selectExpr("id as pid", "key", "at as start"), ["key"], "at", "start", ["pid"]).collect()
    assert {r["id"]: r["pid"] for r in found} == {1: None, 2: 2}


def test_the_large_side_moves_once(spark):
    df = spark.createDataFrame(made(9, 50), "id bigint, key int, at timestamp_ntz, v int")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = sw.number_rows(df, ["key"], "at", ["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    # One exchange of the rows; the border rows are counted, put in order and broadcast.
    rows_side = text.split("BroadcastExchange")[0]
    assert rows_side.count("Exchange hashpartitioning") == 1 and "BroadcastHashJoin" in rows_side
    assert text.count("Exchange hashpartitioning") == 3


@pytest.mark.parametrize("unit", ["hour", "day", "month"])
def test_range_join_with_missing_and_far_bounds(spark, unit):
    """Spans without a start match nothing; spans of all time and very old points still meet."""
    points = spark.createDataFrame(
        [(1, 1, at("2024-01-05T10:00:00")), (2, 1, at("0005-03-01")), (3, 1, None), (4, 1, at("9000-01-01")), (5, 1, at("1900-01-01"))], "id int, key int, at timestamp_ntz"
    )
    spans = spark.createDataFrame([
        (10, 1, None, at("2024-02-01")), (11, 1, at("2024-01-01"), None), (12, 1, at("0001-01-01"), at("9999-12-31")), (13, 1, at("0004-01-01"), at("0006-01-01")),
        (14, 1, at("1899-01-01"), at("1901-01-01")), (15, 1, at("2024-01-06"), at("2024-01-05")), (16, None, at("2024-01-01"), None),
    ], "span int, key int, start timestamp_ntz, stop timestamp_ntz")
    got = sl.range_join(points, spans, ["key"], "at", "start", "stop", moment("2024-02-01"), unit)
    assert sorted((r["id"], r["span"]) for r in got.collect()) == [(1, 11), (1, 12), (2, 12), (2, 13), (4, 11), (4, 12), (5, 12), (5, 14)]
    left = sl.range_join(points, spans, ["key"], "at", "start", "stop", moment("2024-02-01"), unit, how="left")
    assert {r["id"] for r in left.collect()} == {1, 2, 3, 4, 5}


def one_day(spark, n=3000):
    """One key holds nearly all rows, all of them at one instant."""
    noon = datetime(2024, 2, 1, 12)
    return spark.createDataFrame([(i, 1 if i % 50 else None if i % 100 else 2, noon, i % 7) for i in range(n)], "id bigint, key int, at timestamp_ntz, v int").repartition(4)


def test_one_instant_is_spread_over_ranges(spark):
    df = one_day(spark)
    splits = sw.split_points(df, ["key"], ["at", "id"], 32)
    sizes = [r["count"] for r in sw.deal(df, splits).filter("key = 1").groupBy("_part").count().collect()]
    assert len(sizes) >= 24 and max(sizes) < 600
    mine = sorted(r["id"] for r in df.filter("key = 1").collect())
    got = {r["id"]: r for r in sw.number_rows(df, ["key"], "at", ["id"], ranges=32).collect()}
    assert [got[i]["index_asc"] for i in mine] == list(range(1, len(mine) + 1))
    assert [got[i]["index_desc"] for i in mine] == list(range(len(mine), 0, -1))
    assert all(r["index_asc"] is None and r["index_desc"] is None for r in got.values() if r["key"] is None)
    before = {r["id"]: r["previous_id"] for r in sw.previous_values(df, ["key"], "at", ["id"], ["id"], ranges=32).collect()}
    assert [before[i] for i in mine] == [None, *mine[:-1]]
    # Every event of the instant sees the one point of that instant, whichever range it lies in.
    points = spark.createDataFrame([(7, 1, datetime(2024, 2, 1, 12)), (8, 1, datetime(2024, 1, 1)), (9, 1, datetime(2024, 2, 2))], "pid int, key int, start timestamp_ntz")
    for strict, want in ((False, 7), (True, 8)):
        found = sw.asof_backward(df, points, ["key"], "at", "start", ["pid"], ["pid"], strict=strict, ranges=32).collect()
        assert len(found) == 3000 and all(r["pid"] == (want if r["key"] == 1 else None) for r in found)


def test_odd_keys_and_empty_tables(spark):
    rows = [(0, "it's", None), (1, "a\\b", at("2024-01-01")), (2, "a\\b", None), (3, "", at("2023-01-01")), (4, None, None)] * 20
    df = spark.createDataFrame([(i, k, t) for i, (_, k, t) in enumerate(rows)], "id bigint, key string, at timestamp_ntz")
    got = {r["id"]: r["index_asc"] for r in sw.number_rows(df, ["key"], "at", ["id"], ranges=5).collect()}
    for key in {r[1] for r in rows}:
        own = sorted(((t is not None, t or START, i) for i, (_, k, t) in enumerate(rows) if k == key))
        assert [got[i] for _, _, i in own] == ([None] * len(own) if key is None else list(range(1, len(own) + 1)))
    assert sw.number_rows(df.limit(0), ["key"], "at", ["id"]).count() == 0
    assert sw.previous_values(df.limit(0), ["key"], "at", ["id"], ["id"]).count() == 0


def test_ordered_text_in_two_levels(spark):
    rows = [(i % 3 if i % 10 == 0 else 1, (i * 7919) % 500, None if i % 11 == 0 else f"v{i}") for i in range(500)] + [(9, 1, None)]
    df = spark.createDataFrame(rows, "key int, o int, v string").repartition(3)
    for ranges in (1, 16):
        got = {r["key"]: r["t"] for r in ordered_text(df, ["key"], "v", ["o"], "t", "; ", ranges).collect()}
        for key in {r[0] for r in rows}:
            kept = [v for _, v in sorted((o, v) for k, o, v in rows if k == key and v is not None)]
            assert got[key] == ("; ".join(kept) if kept else None)
