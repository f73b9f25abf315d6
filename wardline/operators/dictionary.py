"""Dictionary lookups as joins, each against one row per looked-up key.

No broadcast hints: Spark measures the dictionary side and broadcasts it only
below ``spark.sql.autoBroadcastJoinThreshold``; above it the join shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, on: str, lookup: DataFrame, key: str, columns: Mapping[str, str]) -> DataFrame:
    """Left join of chosen lookup columns, renamed; the lookup key must be unique."""
    side = lookup.select(F.col(key).alias("_key"), *[F.col(src).alias(out) for out, src in columns.items()])
    return df.join(side, df[on] == side["_key"], "left").drop("_key")


def resolve_ids(entity: DataFrame, uuids: Sequence[str], id_column: str, uuid: str = "uuid") -> DataFrame:
    """Ids of the entity rows with the given UUIDs."""
    return entity.filter(F.col(uuid).isin(list(uuids))).select(uuid, id_column)


def concept_from_mapping(mapping: DataFrame, references: Sequence[tuple[str, str]]) -> DataFrame:
    """One concept per (source, code); the lowest id where several are mapped."""
    wanted = F.lit(False)
    for source, code in references:
        wanted = wanted | ((F.col("source") == source) & (F.col("code") == str(code)))
    return mapping.filter(wanted).groupBy("source", "code").agg(F.min("concept_id").alias("concept_id"))


def codebook(mapping: DataFrame, roles: Mapping[str, tuple[str, str]]) -> dict[str, int]:
    """Concept ids by role name, fetched once per job.

    The rows fetched are bounded by the number of roles.
    """
    found = {
        (row["source"], row["code"]): row["concept_id"]
        for row in concept_from_mapping(mapping, list(roles.values())).collect()
    }
    missing = [role for role, (source, code) in roles.items() if (source, str(code)) not in found]
    if missing:
        raise KeyError(f"no concept mapped for {missing}")
    return {role: found[(source, str(code))] for role, (source, code) in roles.items()}


def labels(names: DataFrame, locale: str, default_locale: str = "en") -> DataFrame:
    """One label per concept: the locale's name, else the default locale's."""
    chosen = names.filter(F.col("locale").isin([locale, default_locale]))
    return chosen.groupBy("concept_id").agg(
        F.coalesce(
            F.min(F.when(F.col("locale") == locale, F.col("name"))),
            F.min(F.when(F.col("locale") == default_locale, F.col("name"))),
        ).alias("label")
    )


def concept_label(df: DataFrame, label_table: DataFrame, on: str, out: str) -> DataFrame:
    return attach(df, on, label_table, "concept_id", {out: "label"})


def set_flags(sets: DataFrame, flags: Mapping[str, object]) -> DataFrame:
    """One row per concept with a 0/1 column per concept set."""
    return sets.filter(F.col("concept_set").isin(list(flags.values()))).groupBy("concept_id").agg(
        *[F.max(F.when(F.col("concept_set") == value, 1).otherwise(0)).alias(name) for name, value in flags.items()]
    )


def concept_in_sets(df: DataFrame, sets: DataFrame, on: str, flags: Mapping[str, object]) -> DataFrame:
    """0/1 membership columns, one join for all sets."""
    out = attach(df, on, set_flags(sets, flags), "concept_id", {name: name for name in flags})
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in flags})


def code_system(mapping: DataFrame, source: str) -> DataFrame:
    """External code per concept; the lowest code where several are mapped."""
    return mapping.filter(F.col("source") == source).groupBy("concept_id").agg(F.min("code").alias("code"))


def retrieve_code(df: DataFrame, mapping: DataFrame, on: str, source: str, out: str) -> DataFrame:
    return attach(df, on, code_system(mapping, source), "concept_id", {out: "code"})


def patient_identifiers(identifiers: DataFrame, types: Mapping[str, object]) -> DataFrame:
    """One row per patient with a column per identifier type, in one pass.

    The preferred identifier wins, then the lowest id.
    """
    live = identifiers.filter(~F.col("voided") & F.col("identifier_type").isin(list(types.values())))
    rank = F.struct((~F.col("preferred")).alias("p"), F.col("patient_identifier_id"), F.col("identifier"))
    return live.groupBy("patient_id").agg(
        *[
            F.min(F.when(F.col("identifier_type") == value, rank))["identifier"].alias(name)
            for name, value in types.items()
        ]
    )


def config_value(properties: DataFrame, key: str, default: str | None = None) -> str | None:
    """A configured value, or the default; at most one row is fetched."""
    row = properties.filter(F.col("property") == key).select("value").head()
    return row["value"] if row and row["value"] is not None else default


def preferred_name(names: DataFrame) -> DataFrame:
    """One name per person: live, preferred first, then the newest."""
    rank = F.struct("preferred", "date_created", (-F.col("person_name_id")).alias("n"))
    return names.filter(~F.col("voided")).groupBy("person_id").agg(
        F.max_by(F.struct("given_name", "family_name"), rank).alias("n")
    ).select("person_id", "n.given_name", "n.family_name")


def latest_address(addresses: DataFrame, columns: Sequence[str], include_voided: bool = False) -> DataFrame:
    """One address per person: preferred first, then the newest."""
    rows = addresses if include_voided else addresses.filter(~F.col("voided"))
    rank = F.struct("preferred", "date_created", (-F.col("person_address_id")).alias("n"))
    return rows.groupBy("person_id").agg(F.max_by(F.struct(*columns), rank).alias("a")).select(
        "person_id", *[F.col(f"a.{c}") for c in columns]
    )


def person_attribute(attributes: DataFrame, attribute: str, out: str) -> DataFrame:
    """Newest live value of one attribute per person."""
    rows = attributes.filter(~F.col("voided") & (F.col("attribute_type") == attribute))
    return rows.groupBy("person_id").agg(F.max_by("value", "person_attribute_id").alias(out))


def person_profile(
    persons: DataFrame, names: DataFrame, attributes: DataFrame, as_of: Column,
    phone: str = "phone", unknown: str = "unknown", registration: DataFrame | None = None,
) -> DataFrame:
    """One profile row per person, joined once by every report."""
    from wardline.functions.clinical import age_at

    wanted = attributes.filter(~F.col("voided") & F.col("attribute_type").isin([phone, unknown]))

    def newest(kind: str) -> Column:
        return F.max(F.when(F.col("attribute_type") == kind, F.struct("person_attribute_id", "value")))["value"]

    extra = wanted.groupBy("person_id").agg(newest(phone).alias("phone"), newest(unknown).alias("unknown_patient"))
    out = (
        persons.join(preferred_name(names), "person_id", "left")
        .join(extra, "person_id", "left")
        .select(
            persons["person_id"], "given_name", "family_name",
            F.concat_ws(" ", "given_name", "family_name").alias("person_name"),
            "gender", "birthdate", "birthdate_estimated",
            F.col("death_date").isNotNull().alias("dead"), "death_date",
            age_at(F.col("birthdate"), as_of).alias("current_age"),
            "phone", "unknown_patient",
        )
    )
    if registration is not None:
        out = out.join(registration, "person_id", "left")
    return out


def provider_of_encounter(encounter_providers: DataFrame, providers: DataFrame) -> DataFrame:
    """One provider name per encounter: the lowest live provider id."""
    first = encounter_providers.filter(~F.col("voided")).groupBy("encounter_id").agg(F.min("provider_id").alias("provider_id"))
    return attach(first, "provider_id", providers, "provider_id", {"provider": "name"}).select("encounter_id", "provider")


def drug_ids(drugs: DataFrame, references: Sequence[str]) -> DataFrame:
    """Drug id per reference, given as name or UUID; the lowest id where several match."""
    wanted = list(references)
    by_name = drugs.filter(F.col("name").isin(wanted)).select(F.col("name").alias("reference"), "drug_id")
    by_uuid = drugs.filter(F.col("uuid").isin(wanted)).select(F.col("uuid").alias("reference"), "drug_id")
    return by_name.unionByName(by_uuid).groupBy("reference").agg(F.min("drug_id").alias("drug_id"))


def lookup_dedup(df: DataFrame, key: str, derive) -> DataFrame:
    """Derive columns once per distinct key and join them back.

    Worth it only where the derivation itself is a join that cannot be pushed
    below the fan-out; plain dictionary lookups need nothing of the kind.
    """
    derived = derive(df.select(key).distinct())
    return df.join(derived, key, "left")
