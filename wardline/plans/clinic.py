"""What every report needs: tables, codes and the shared lookups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.clinical import age_at
from wardline.functions.text import format_address, site_key
from wardline.operators import dictionary as dc
from wardline.operators.filters import date_range, in_months, not_voided, type_in
from wardline.sources.months import of_persons, of_times, of_visits, with_groups

# Fixed value: display order of the address parts.
ADDRESS_ORDER = ("address2", "city_village", "address1", "state_province", "county_district", "country")


@dataclass
class Clinic:
    """Entity tables plus the site's codes.

    ``codes`` maps role names to concept ids, ``types`` roles to encounter types,
    ``identifiers`` output columns to identifier types, and ``places`` / ``programs``
    / ``attributes`` roles to ids.  Reports name roles, never ids.
    """

    tables: Mapping[str, DataFrame]
    as_of: Column
    codes: Mapping[str, int] = field(default_factory=dict)
    types: Mapping[str, Sequence] = field(default_factory=dict)
    identifiers: Mapping[str, object] = field(default_factory=dict)
    places: Mapping[str, object] = field(default_factory=dict)
    programs: Mapping[str, object] = field(default_factory=dict)
    attributes: Mapping[str, object] = field(default_factory=dict)
    locale: str = "en"
    site: str | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    @cached_property
    def labels(self) -> DataFrame:
        return dc.labels(self["concept_name"], self.locale)

    def encounters(self, role: str, start=None, end=None, keep_voided: bool = False) -> DataFrame:
        """Encounters of a role's types in an optional date range."""
        rows = type_in(in_months(self["encounter"], start, end), self.types[role])
        if not keep_voided:
            rows = not_voided(rows)
        return date_range(rows, "encounter_datetime", start, end)

    def live_obs(self, anchors: DataFrame | None = None, start=None, end=None) -> DataFrame:
        """Live observations, cut to the anchor encounters.

        ``start`` and ``end`` are the days the anchors lie in: where observations are
        stored by their encounter's month, other months are not opened.  Any other month
        they may have says nothing about their encounter and cuts nothing.
        """
        rows = not_voided(in_months(self["obs"], start, end, "enc_month")).drop("month", "enc_month")
        # An inner join stays above the parts that the observations may be a union of, so they come by encounter
        # once and the aggregates by encounter need no further shuffle; a semi join is pushed into each part.
        return rows if anchors is None else rows.join(anchors.select("encounter_id").distinct(), "encounter_id")

    def _in_months(self, rows: DataFrame, index: str, months: Callable[[DataFrame], list[str]], column: str = "enc_month") -> DataFrame:
        """Rows of the folders a side table names; all rows where there is no such table."""
        if "enc_month" in self["obs"].columns and index in self.tables and column in rows.columns:
            # Encounters without a time lie in no month's folder.
            undated = F.col(column).isNull() if column == "month" else F.lit(False)
            rows = rows.filter(F.col(column).isin(months(self[index])) | undated)
        return rows

    def visit_obs(self, visits: DataFrame, start=None, end=None) -> DataFrame:
        """Live observations of all encounters of the visits, with their visit.

        Each visit has an encounter between the days.
        """
        visits = visits.select("visit_id").distinct()

        @cache
        def months(index: DataFrame) -> list[str]:
            return of_visits(index, visits, start, end)

        own = self._in_months(self["encounter"], "obs_months_by_visit", months, "month").select("encounter_id", "visit_id")
        obs = self._in_months(not_voided(self["obs"]), "obs_months_by_visit", months)
        return obs.drop("month", "enc_month", "visit_id").join(own.join(visits, "visit_id", "left_semi"), "encounter_id")

    def person_obs(self, persons: DataFrame) -> DataFrame:
        """Live observations of the persons, of any time."""
        obs = self._in_months(not_voided(self["obs"]), "obs_months_by_person", lambda index: of_persons(index, persons))
        return obs.drop("month", "enc_month").join(persons.select("person_id"), "person_id", "left_semi")

    def obs_at(self, concepts: Sequence[int], kind: str, start=None, end=None) -> tuple[DataFrame, DataFrame]:
        """Live answers to the questions whose own time may lie between the days, and what may be in their groups.

        ``kind`` names the time's column.  Both keep every row of the folders that
        are opened: the caller compares times and groups.
        """
        live, groups = not_voided(self["obs"]), self.tables.get("obs_months_by_group")

        @cache
        def months(index: DataFrame) -> list[str]:
            return of_times(index, list(concepts), kind, start, end)

        def wider(index: DataFrame) -> list[str]:
            return with_groups(groups, months(index))

        asked = self._in_months(live, "obs_months_by_time", months).filter(F.col("concept_id").isin(list(concepts)))
        members = live if groups is None else self._in_months(live, "obs_months_by_time", wider)
        return asked.drop("month", "enc_month"), members.drop("month", "enc_month")

    def keyed(self, df: DataFrame, *columns: str) -> DataFrame:
        """Ids as text with the site in front when it has a number."""
        return df.withColumns({c: site_key(F.col(c), self.site) for c in columns})

    # -- lookups by encounter or patient, each a left join of one row per key

    def with_identifiers(self, df: DataFrame, columns: Sequence[str] | None = None, patient: str = "patient_id") -> DataFrame:
        wanted = {c: self.identifiers[c] for c in (columns or self.identifiers)}
        table = dc.patient_identifiers(self["patient_identifier"], wanted)
        return dc.attach(df, patient, table, "patient_id", {c: c for c in wanted})

    def with_person(self, df: DataFrame, columns: Mapping[str, str], patient: str = "patient_id") -> DataFrame:
        return dc.attach(df, patient, self["person"], "person_id", columns)

    def with_name(self, df: DataFrame, out: str, patient: str = "patient_id") -> DataFrame:
        names = dc.preferred_name(self["person_name"])
        names = names.select("person_id", F.concat_ws(" ", "given_name", "family_name").alias("name"))
        return dc.attach(df, patient, names, "person_id", {out: "name"})

    def with_age(self, df: DataFrame, out: str, at: str = "encounter_datetime", patient: str = "patient_id") -> DataFrame:
        rows = self.with_person(df, {"_born": "birthdate"}, patient)
        return rows.withColumn(out, age_at(F.col("_born"), F.col(at))).drop("_born")

    def with_address(self, df: DataFrame, out: str, patient: str = "patient_id") -> DataFrame:
        table = dc.latest_address(self["person_address"], list(ADDRESS_ORDER))
        table = table.select("person_id", format_address(*[F.col(c) for c in ADDRESS_ORDER]).alias("address"))
        return dc.attach(df, patient, table, "person_id", {out: "address"})

    def with_attribute(self, df: DataFrame, kind: str, out: str, patient: str = "patient_id") -> DataFrame:
        table = dc.person_attribute(self["person_attribute"], self.attributes[kind], "value")
        return dc.attach(df, patient, table, "person_id", {out: "value"})

    def with_location(self, df: DataFrame, out: str, on: str = "location_id") -> DataFrame:
        return dc.attach(df, on, self["location"], "location_id", {out: "name"})

    def with_type_name(self, df: DataFrame, out: str) -> DataFrame:
        return dc.attach(df, "encounter_type", self["encounter_type"], "encounter_type_id", {out: "name"})

    def with_user(self, df: DataFrame, out: str, column: str = "person_name") -> DataFrame:
        return dc.attach(df, "creator", self["users"], "user_id", {out: column})

    def with_provider(self, df: DataFrame, out: str) -> DataFrame:
        table = dc.provider_of_encounter(self["encounter_provider"], self["provider"])
        return dc.attach(df, "encounter_id", table, "encounter_id", {out: "provider"})

    def with_registration(self, df: DataFrame, out: str, patient: str = "patient_id") -> DataFrame:
        """Place of the first registration encounter."""
        first = self.encounters("registration").groupBy("patient_id").agg(
            F.min(F.struct("encounter_datetime", "encounter_id", "location_id"))["location_id"].alias("location_id")
        )
        table = dc.attach(first, "location_id", self["location"], "location_id", {"name": "name"})
        return dc.attach(df, patient, table, "patient_id", {out: "name"})

    def with_label(self, df: DataFrame, on: str, out: str) -> DataFrame:
        return dc.concept_label(df, self.labels, on, out)
