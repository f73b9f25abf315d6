"""Joins of events with visits, enrolments and other intervals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.aggregates import ordered_text
from wardline.operators.slices import range_join
from wardline.operators.sweeps import Points, asof_backward, look_back


def visit_of_event(events: DataFrame, visits: DataFrame, by: str = "patient_id", at: str = "event_at", grain: str = "timestamp") -> DataFrame:
    """Latest visit of the patient that started at or before the event."""
    return asof_backward(events, visits, [by], at, "date_started", ["visit_id"], order=["visit_id"], grain=grain)


def interval_contains(
    events: DataFrame, spans: DataFrame, by: str, at: str, span_id: str = "visit_id", start: str = "date_started",
    stop: str = "date_stopped",
) -> DataFrame:
    """Span holding each event: the one that stops last; failing that, the one that
    stopped earlier the same day.  Spans must be closed to count.

    Of the spans started by then the one that stops last either holds the event or
    no span does, so a running maximum answers without pairing events and spans.  Starts
    and stops are swept together with the events.
    """
    take = [span_id, start, stop]
    closed = spans.filter(F.col(stop).isNotNull()).select(by, *take)

    def named(prefix: str) -> list[Column]:
        return [F.col(c).alias(f"{prefix}{c}") for c in take]

    slim = events.drop(*take)
    kept = slim.columns
    sources = [
        Points(closed.select(by, *named("_in_")), f"_in_{start}", [f"_in_{c}" for c in take], best=[f"_in_{stop}", f"_in_{span_id}"]),
        Points(closed.select(by, *named("_day_")), f"_day_{stop}", [f"_day_{c}" for c in take], order=[f"_day_{span_id}"], strict=True),
    ]
    found = look_back(slim, sources, [by], at)
    inside = F.col(f"_in_{stop}") >= F.col(at)
    same_day = F.to_date(f"_day_{stop}") == F.to_date(at)
    return found.select(
        *kept, *[F.when(inside, F.col(f"_in_{c}")).when(same_day, F.col(f"_day_{c}")).alias(c) for c in take]
    )


def enrolment_window(
    enrolments: DataFrame, encounters: DataFrame, as_of: Column, by: str = "patient_id", unit: str = "month",
) -> DataFrame:
    """Encounters from the enrolment day to the completion day, per enrolment."""
    return range_join(
        encounters, enrolments, [by], "encounter_datetime", "date_enrolled", "date_completed", as_of, unit, grain="day"
    )


def enrolment_of_encounter(
    encounters: DataFrame, enrolments: DataFrame, as_of: Column, by: str = "patient_id", unit: str = "month",
) -> DataFrame:
    """The enrolment active at each encounter, latest enrolled first; null when none."""
    inside = enrolment_window(enrolments, encounters.select(by, "encounter_id", "encounter_datetime"), as_of, by, unit)
    best = inside.groupBy("encounter_id").agg(
        F.max(F.struct("date_enrolled", "patient_program_id"))["patient_program_id"].alias("patient_program_id")
    )
    return encounters.join(best, "encounter_id", "left")


def exact_time_join(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, take: Sequence[str]) -> DataFrame:
    """Rows of the right side whose time equals the left time, same key."""
    side = right.select(by, F.col(right_at).alias(at), *take)
    return left.join(side, [by, at])


def relationship_join(
    enrolments: DataFrame, relationships: DataFrame, names: DataFrame, kind, out: str, separator: str = ", ",
) -> DataFrame:
    """Names of persons related to the enrolled patient, listed in name order."""
    edges = relationships.filter(~F.col("voided") & (F.col("relationship") == kind)).select(
        F.col("person_a").alias("person_id"), F.col("person_b").alias("patient_id")
    ).distinct()
    called = edges.join(names.select("person_id", F.concat_ws(" ", "given_name", "family_name").alias("_name")), "person_id").select("patient_id", "_name")
    listed = ordered_text(called.distinct(), ["patient_id"], "_name", ["_name"], out, separator)
    return enrolments.join(listed, "patient_id", "left")


def uuid_text_join(obs: DataFrame, persons: DataFrame, column: str = "comments") -> DataFrame:
    """Persons whose UUID is written in a free-text column, in any letter case."""
    from wardline.functions.text import is_uuid

    side = persons.select(F.lower("uuid").alias("_uuid"), F.col("person_id").alias("other_person_id"))
    return obs.filter(is_uuid(F.col(column))).withColumn("_uuid", F.lower(column)).join(side, "_uuid").drop("_uuid")


def or_join(left: DataFrame, right: DataFrame, first: tuple[str, str], second: tuple[str, str], left_id: str, right_id: str) -> DataFrame:
    """Pairs that agree on the first key pair or on the second, each pair once.

    Two equi-joins; the second leaves out pairs the first already has.
    """
    a = left.alias("a")
    b = right.alias("b")
    one = a.join(b, F.col(f"a.{first[0]}") == F.col(f"b.{first[1]}"))
    also = F.coalesce(F.col(f"a.{first[0]}") == F.col(f"b.{first[1]}"), F.lit(False))
    two = a.join(b, F.col(f"a.{second[0]}") == F.col(f"b.{second[1]}")).filter(~also)
    pick = [F.col(f"a.{left_id}").alias("left_id"), F.col(f"b.{right_id}").alias("right_id")]
    return one.select(*pick).unionByName(two.select(*pick))


def update_from(df: DataFrame, source: DataFrame, keys: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Set columns from a matching source row; unmatched rows keep what they had.

    The source must hold one row per key.
    """
    side = source.select(*keys, *[F.col(src).alias(f"_new_{out}") for out, src in columns.items()], F.lit(True).alias("_hit"))
    joined = df.join(side, list(keys), "left")
    out = []
    for column in df.columns:
        if column in columns:
            out.append(F.when(F.col("_hit"), F.col(f"_new_{column}")).otherwise(F.col(column)).alias(column))
        else:
            out.append(F.col(column))
    added = [F.col(f"_new_{c}").alias(c) for c in columns if c not in df.columns]
    return joined.select(*out, *added)


def no_later(left: DataFrame, right: DataFrame, by: str, at: str, right_at: str, elsewhere: str | None = None, leave: Column | None = None) -> DataFrame:
    """Left rows with no later right row that is a leave or at another place.

    Replaces the anti join on an inequality: the right side shrinks to one row per
    key and place first, so no pairs are formed.  ``leave`` marks rows that count
    at any place; without ``elsewhere`` every right row counts.
    """
    leaving = F.lit(True) if elsewhere is None else (leave if leave is not None else F.lit(False))
    gone = right.groupBy(by).agg(F.max(F.when(leaving, F.col(right_at))).alias("_gone"))
    kept = left.join(gone, by, "left")
    test = F.coalesce(F.col("_gone") <= F.col(at), F.lit(True))
    if elsewhere is not None:
        seen = right.filter(~leaving).groupBy(by, elsewhere).agg(F.max(right_at).alias("_seen"))
        # The two latest places are enough: the best place other than the row's own is one of them.
        top = seen.groupBy(by).agg(
            F.slice(F.sort_array(F.collect_list(F.struct("_seen", F.col(elsewhere).alias("_place"))), asc=False), 1, 2).alias("_top")
        )
        kept = kept.join(top, by, "left")
        other = F.filter(F.col("_top"), lambda p: p["_place"] != F.col(elsewhere))
        latest_other = F.array_max(F.transform(other, lambda p: p["_seen"]))
        test = test & F.coalesce(latest_other <= F.col(at), F.lit(True))
    return kept.filter(test).select(*left.columns)
