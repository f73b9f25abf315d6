"""Audited corrections as change sets.

A change set is rows to insert plus updates by id.  Nothing is edited in place:
``apply_changeset`` reads one version of a table and yields the next, to be
written to a new path.  A new row is known by its UUID, which is derived from the
row it comes from; its id is given when the change set is applied, above all ids of
the table.  Candidates are live rows only, so a second run changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.text import is_uuid
from wardline.operators.filters import not_voided
from wardline.operators.intervals import interval_contains
from wardline.operators.sweeps import previous_values
from wardline.session import scratch_dir


@dataclass
class ChangeSet:
    """``inserts`` has rows with a ``uuid`` and no key; ``updates`` has the key and the columns to set.

    Where an insert refers to another insert, ``parent`` names the column that takes the
    other's id and the column that holds its UUID.
    """

    key: str
    inserts: DataFrame | None = None
    updates: DataFrame | None = None
    parent: tuple[str, str] | None = None


def derived_uuid(source: Column, role: str) -> Column:
    """The UUID of a row derived from another row in a given role."""
    digest = F.md5(F.concat_ws(":", source.cast("string"), F.lit(role)))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, start, length) for start, length in cuts])


# Bits that keys are hashed to, 64 to a row: at most a million rows are broadcast.
FILTER_BITS = 1 << 26


def _kept(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/wardline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _marked(table: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The table with ``_maybe``, false only where no key can equal the column.

    Keys set bits by their hash, so few rows of the table go on to an exact join and
    the others never move.
    """
    def place(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(FILTER_BITS))

    # Hashes differ by type.
    key = F.col(keys.columns[0]).try_cast(table.schema[column].dataType)
    bits = keys.select(place(key).alias("_h")).groupBy(F.shiftright("_h", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(_h & 63 AS INT))")).alias("_bits")
    )
    bits = F.broadcast(_kept(bits, "bits"))
    hit = F.expr("coalesce((shiftrightunsigned(_bits, CAST(_h & 63 AS INT)) & 1L) = 1L, false)")
    rows = table.withColumn("_h", place(F.col(column))).withColumn("_word", F.shiftright("_h", 6)).join(bits, "_word", "left")
    return rows.select(*table.columns, hit.alias("_maybe"))


def apply_changeset(table: DataFrame, change: ChangeSet) -> DataFrame:
    """The next version of the table."""
    out = table
    if change.updates is not None:
        columns = [c for c in change.updates.columns if c != change.key]
        side = change.updates.select(change.key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
        marked = _marked(table, change.key, change.updates.select(change.key))
        joined = marked.filter("_maybe").join(side, change.key, "left")
        out = joined.select(
            *[
                F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
                for c in table.columns
            ]
        ).unionByName(marked.filter("NOT _maybe").drop("_maybe"))
    if change.inserts is not None:
        fresh = _numbered(table, change)
        out = out.unionByName(fresh.select(*[c for c in table.columns if c in fresh.columns]), allowMissingColumns=True)
    return out


def _numbered(table: DataFrame, change: ChangeSet) -> DataFrame:
    """The inserts that the table does not hold yet, with ids above all of its own.

    The inserts are made once and written, so that every later read sees the same
    numbers, and so are those the table holds: whoever reads the next version would look
    through the table again.  Only rows whose UUID may be among them meet the inserts.
    Inserts of one UUID (sources that share an id) get an id each; what refers to them
    takes the lowest.
    """
    key = change.key
    made = _kept(change.inserts.withColumn("uuid", F.lower("uuid")).withColumn("_order", F.monotonically_increasing_id()), "inserts")
    top = table.agg(F.max(key)).first()[0] or 0
    numbered = made.withColumn(key, (F.lit(top) + 1 + F.col("_order")).cast(table.schema[key].dataType)).drop("_order")
    # Rows an earlier run put there, and the ids they have.
    maybe = _marked(table.select(key, F.lower("uuid").alias("uuid")), "uuid", made.select("uuid")).filter("_maybe")
    present = _kept(maybe.join(made.select("uuid"), "uuid", "left_semi").groupBy("uuid").agg(F.min(key).alias(key)), "present")
    fresh = numbered.join(present.select("uuid"), "uuid", "left_anti")
    if change.parent is not None:
        column, link = change.parent
        known = fresh.select("uuid", key).unionByName(present).groupBy("uuid").agg(F.min(key).alias(key))
        parents = known.select(F.col("uuid").alias(link), F.col(key).alias("_parent"))
        fresh = fresh.join(parents, link, "left").withColumn(column, F.coalesce("_parent", column)).drop("_parent", link)
    return fresh


def _void(candidates: DataFrame, key: str, reason: str, as_of: Column, user) -> DataFrame:
    return candidates.select(
        key, F.lit(True).alias("voided"), F.lit(reason).alias("void_reason"),
        as_of.alias("date_voided"), F.lit(user).alias("voided_by"),
    )


def _copies(candidates: DataFrame, changes: Mapping[str, Column], role: str, as_of: Column, user) -> DataFrame:
    """Replacement rows that point back at the row they replace."""
    return candidates.withColumns(
        {
            "previous_version": F.col("obs_id"),
            "uuid": derived_uuid(F.col("obs_id"), role),
            "creator": F.lit(user),
            "date_created": as_of,
            **changes,
        }
    ).drop("obs_id")


def _of_types(obs: DataFrame, encounters: DataFrame, types: Sequence | None) -> DataFrame:
    if types is None:
        return obs
    enc = encounters.filter(F.col("encounter_type").isin(list(types))).select("encounter_id")
    return obs.join(enc, "encounter_id", "left_semi")


def _mapped(column: Column, mapping: Mapping) -> Column:
    out = None
    for old, new in mapping.items():
        out = F.when(column == old, F.lit(new)) if out is None else out.when(column == old, F.lit(new))
    return out


def recode_concept(
    obs: DataFrame, encounters: DataFrame, mapping: Mapping, types: Sequence | None, reason: str, as_of: Column, user: int = 1,
    value: Callable[[Column], Column] | None = None,
) -> ChangeSet:
    """Move live observations to new concepts, linking and voiding the old rows.

    Values are copied as they are unless ``value`` converts them.
    """
    rows = not_voided(obs).filter(F.col("concept_id").isin(list(mapping)))
    rows = _of_types(rows, encounters, types)
    changes = {"concept_id": _mapped(F.col("concept_id"), mapping)}
    if value is not None:
        changes["value_numeric"] = value(F.col("value_numeric"))
    return ChangeSet("obs_id", _copies(rows, changes, "recode", as_of, user), _void(rows, "obs_id", reason, as_of, user))


def scale_below(threshold: float, factor: float) -> Callable[[Column], Column]:
    """Multiply values under the threshold; others were entered in the new unit already."""
    return lambda v: F.when(v < threshold, v * factor).otherwise(v)


def recode_and_scale(
    obs: DataFrame, encounters: DataFrame, mapping: Mapping, types: Sequence, threshold: float, factor: float,
    reason: str, as_of: Column, user: int = 1,
) -> ChangeSet:
    return recode_concept(obs, encounters, mapping, types, reason, as_of, user, scale_below(threshold, factor))


def override_answer(obs: DataFrame, questions: Sequence, answer, reason: str, as_of: Column, user: int = 1) -> ChangeSet:
    """Replace every live answer of the questions by one answer."""
    rows = not_voided(obs).filter(F.col("concept_id").isin(list(questions)))
    # Rows an earlier run made stay, so that a rerun finds nothing to do.
    done = F.col("previous_version").isNotNull() & F.col("value_coded").eqNullSafe(F.lit(answer))
    rows = rows.filter(~done)
    changes = {"value_coded": F.lit(answer)}
    return ChangeSet("obs_id", _copies(rows, changes, "override", as_of, user), _void(rows, "obs_id", reason, as_of, user))


def split_to_groups(candidates: DataFrame, parts: Sequence[tuple[str, int, int, int]], reason: str, as_of: Column) -> ChangeSet:
    """Replace each observation by groups of one child.

    ``parts`` lists (role, group concept, child concept, answer).  Each candidate
    unfolds into all its new rows at once, so candidates are read a single time.
    Voiding is credited to whoever entered the row.
    """
    rows = []
    for role, group, child, answer in parts:
        head = derived_uuid(F.col("obs_id"), f"{role}-group")
        for name, concept, value, parent in ((f"{role}-group", group, None, None), (f"{role}-child", child, answer, head)):
            rows.append(
                F.struct(
                    derived_uuid(F.col("obs_id"), name).alias("uuid"), F.lit(concept).cast("int").alias("concept_id"),
                    F.lit(value).cast("int").alias("value_coded"), (F.lit(None).cast("string") if parent is None else parent).alias("_group"),
                )
            )
    kept = [c for c in ("person_id", "encounter_id", "obs_datetime", "location_id", "creator") if c in candidates.columns]
    made = candidates.select(*kept, F.explode(F.array(*rows)).alias("_row")).select(
        *kept, "_row.*", F.lit(None).cast(candidates.schema["obs_id"].dataType).alias("obs_group_id"),
        as_of.alias("date_created"), F.lit(False).alias("voided"),
    )
    user = F.col("creator") if "creator" in candidates.columns else F.lit(1)
    voids = candidates.select(
        "obs_id", F.lit(True).alias("voided"), F.lit(reason).alias("void_reason"),
        as_of.alias("date_voided"), user.alias("voided_by"),
    )
    return ChangeSet("obs_id", made, voids, ("obs_group_id", "_group"))


def wrap_in_group(
    obs: DataFrame, encounters: DataFrame, old: tuple[int, int], new: tuple[int, int], group: int, types: Sequence,
    reason: str, as_of: Column,
) -> ChangeSet:
    """Put results under a new group: rows of the old (question, answer), and
    ungrouped rows of the new one in the given encounter types."""
    live = not_voided(obs)
    first = live.filter((F.col("concept_id") == old[0]) & (F.col("value_coded") == old[1]))
    loose = live.filter(
        F.col("obs_group_id").isNull() & (F.col("concept_id") == new[0]) & (F.col("value_coded") == new[1])
    )
    loose = _of_types(loose, encounters, types)
    if old == new:
        candidates = first.unionByName(loose.select(*first.columns)).dropDuplicates(["obs_id"])
    else:
        candidates = first.unionByName(loose.select(*first.columns))
    return split_to_groups(candidates, [("wrap", group, new[0], new[1])], reason, as_of)


# Fixed value: why an encounter without visit and observations is voided.
EMPTY_ENCOUNTER = "empty encounter with no visit"


@dataclass
class SlottedEncounters:
    encounters: ChangeSet
    visits: ChangeSet


def slot_encounters(
    encounters: DataFrame, obs: DataFrame, visits: DataFrame, skip_types: Sequence, as_of: Column,
    reason: str = EMPTY_ENCOUNTER, user: int = 1,
) -> SlottedEncounters:
    """Place encounters that have no visit.

    Those without any observation are voided.  The others join the visit around
    them, else the visit that stopped earlier the same day, which is extended to
    the latest encounter it takes in.
    """
    loose = not_voided(encounters).filter(F.col("visit_id").isNull() & ~F.col("encounter_type").isin(list(skip_types)))
    used = obs.select("encounter_id").distinct()
    empty = loose.join(used, "encounter_id", "left_anti")
    kept = loose.join(used, "encounter_id", "left_semi").select("encounter_id", "patient_id", "encounter_datetime")
    slots = interval_contains(kept, visits, "patient_id", "encounter_datetime")
    placed = slots.filter(F.col("visit_id").isNotNull())
    voids = empty.select(
        "encounter_id", F.col("visit_id"), F.lit(True).alias("voided"), F.lit(reason).alias("void_reason"),
        as_of.alias("date_voided"), F.lit(user).alias("voided_by"),
    )
    moves = placed.select(
        "encounter_id", "visit_id", F.lit(False).alias("voided"), F.lit(None).cast("string").alias("void_reason"),
        F.lit(None).cast("timestamp_ntz").alias("date_voided"), F.lit(None).cast("int").alias("voided_by"),
    )
    longer = placed.filter(F.col("encounter_datetime") > F.col("date_stopped")).groupBy("visit_id").agg(
        F.max("encounter_datetime").alias("date_stopped")
    )
    return SlottedEncounters(
        ChangeSet("encounter_id", None, voids.unionByName(moves)), ChangeSet("visit_id", None, longer)
    )


def insert_missing_attribute(attributes: DataFrame, visits: DataFrame, attribute, value: str, as_of: Column) -> ChangeSet:
    """Give the visits an attribute row where they have none with this value, in any letter case."""
    have = attributes.filter((F.col("attribute_type_id") == attribute) & (F.lower("value_reference") == value.lower()))
    need = visits.select("visit_id").distinct().join(have.select("visit_id"), "visit_id", "left_anti")
    rows = need.select(
        "visit_id",
        F.lit(attribute).alias("attribute_type_id"), F.lit(value).alias("value_reference"),
        F.lit(False).alias("voided"), derived_uuid(F.col("visit_id"), f"attribute-{attribute}").alias("uuid"),
        as_of.alias("date_created"),
    )
    return ChangeSet("visit_attribute_id", rows)


def visits_started_at_birth(
    obs: DataFrame, encounters: DataFrame, persons: DataFrame, visits: DataFrame, types: Sequence, link, birth_time,
) -> DataFrame:
    """Visits of linked newborns that start exactly at the recorded birth time."""
    own = _of_types(obs, encounters, types)
    links = own.filter(
        (F.col("concept_id") == link) & F.col("obs_group_id").isNotNull() & is_uuid(F.col("comments"))
    ).select("obs_group_id", F.lower("comments").alias("uuid"))
    births = obs.filter((F.col("concept_id") == birth_time) & F.col("obs_group_id").isNotNull()).select(
        "obs_group_id", F.col("value_datetime").alias("date_started")
    )
    babies = links.join(births, "obs_group_id").join(
        persons.select(F.lower("uuid").alias("uuid"), F.col("person_id").alias("patient_id")), "uuid"
    )
    return visits.join(babies.select("patient_id", "date_started").distinct(), ["patient_id", "date_started"], "left_semi")


def adjacent_duplicates(
    rows: DataFrame, by: Sequence[str], at: str, row_id: str, attributes: Sequence[str], max_seconds: int,
) -> DataFrame:
    """Rows equal to the row before them on every attribute, under max_seconds apart.

    Null equals nothing, so a missing attribute is never a duplicate.
    """
    paired = previous_values(rows, by, at, [row_id], [at, *attributes])
    test = F.abs(F.timestamp_diff("SECOND", F.col(f"previous_{at}"), F.col(at))) < max_seconds
    for attribute in attributes:
        test = test & (F.col(attribute) == F.col(f"previous_{attribute}"))
    return paired.filter(test).select(*rows.columns)


def void_adjacent_duplicates(
    dispenses: DataFrame, orders: DataFrame, drug_orders: DataFrame, complete, attributes: Sequence[str],
    reason: str, as_of: Column, max_seconds: int = 60, user: int = 1,
) -> ChangeSet:
    """Void complete dispenses repeated within a minute on orders without refills."""
    live_orders = not_voided(orders).select("order_id").join(
        drug_orders.filter(F.col("num_refills") == 0).select("order_id"), "order_id", "left_semi"
    )
    rows = not_voided(dispenses).filter(F.col("status") == complete).join(
        live_orders, F.col("drug_order_id") == F.col("order_id"), "left_semi"
    )
    doubled = adjacent_duplicates(rows, ["drug_order_id"], "date_created", "medication_dispense_id", attributes, max_seconds)
    return ChangeSet("medication_dispense_id", None, _void(doubled, "medication_dispense_id", reason, as_of, user))


def split_packed_address(addresses: DataFrame, column: str, parts: Sequence[str], default: str | None = None, separator: str = "|") -> DataFrame:
    """Spread a packed column over its parts.

    Rows that are packed or hold a single junk letter are rewritten: missing parts
    become blank, and junk becomes the default (blank without one).  Other rows
    keep what they had.
    """
    from wardline.functions.text import packed_parts

    whole = F.col(column)
    packed = whole.contains(separator)
    junk = F.length(whole) == 1
    pieces = packed_parts(whole, parts, separator)
    out = {}
    for position, (name, piece) in enumerate(pieces.items()):
        kept = F.col(name) if name in addresses.columns else F.lit(None).cast("string")
        spare = F.lit(default or "") if position == 0 else F.lit("")
        out[name] = F.when(packed, piece).when(junk, spare).otherwise(kept if name != column else whole)
    return addresses.withColumns(out)
