"""Side tables that say in which months' folders observations lie.

Observations are stored by the month of their encounter.  A report that looks for them
by visit, by person, by their own time or by their group asks these tables first and
opens only the folders they name.  They are distinct pairs, so they hold few rows beside
the observations, and a report fetches no more than a list of months from them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.filters import in_months

# The month of an observation with neither an encounter's time nor one of its own.
UNDATED = "undated"
# The observations' own times by which they are found.
TIMES = ("obs_datetime", "value_datetime")
INDEXES = {
    "obs_months_by_visit": "visit_id long, enc_month string, month string",
    "obs_months_by_person": "person_id long, enc_month string",
    "obs_months_by_time": "concept_id int, kind string, at_month string, enc_month string",
    "obs_months_by_group": "enc_month string, other_month string",
}


def by_encounter_month(obs: DataFrame, encounter: DataFrame) -> DataFrame:
    """Observations with ``enc_month``: the month of their encounter, their own where that is unknown."""
    months = encounter.select("encounter_id", F.date_format("encounter_datetime", "yyyy-MM").alias("_month"))
    columns = [c for c in obs.columns if c != "enc_month"]
    month = F.coalesce("_month", F.date_format("obs_datetime", "yyyy-MM"), F.lit(UNDATED))
    return obs.select(*columns).join(months, "encounter_id", "left").withColumn("enc_month", month).select(*columns, "enc_month")


def months_by_visit(obs: DataFrame, encounter: DataFrame) -> DataFrame:
    """(visit_id, month, enc_month): a month of the visit's encounters, and one its observations lie in."""
    dated = encounter.select("visit_id", F.date_format("encounter_datetime", "yyyy-MM").alias("month")).filter(F.col("month").isNotNull())
    held = obs.select("encounter_id", "enc_month").distinct().join(encounter.select("encounter_id", "visit_id"), "encounter_id")
    return dated.distinct().join(held.select("visit_id", "enc_month").distinct(), "visit_id").select("visit_id", "enc_month", "month")


def months_by_person(obs: DataFrame) -> DataFrame:
    """(person_id, enc_month) of all persons with observations."""
    return obs.select("person_id", "enc_month").filter(F.col("person_id").isNotNull()).distinct()


def months_by_time(obs: DataFrame) -> DataFrame:
    """(concept_id, kind, at_month, enc_month): for either time of an observation, the folders that hold such times."""
    times = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.date_format(c, "yyyy-MM").alias("at_month")) for c in TIMES if c in obs.columns)))
    found = obs.select("concept_id", "enc_month", times.alias("_t")).filter(F.col("_t.at_month").isNotNull())
    return found.select("concept_id", "_t.kind", "_t.at_month", "enc_month").distinct()


def months_by_group(obs: DataFrame) -> DataFrame:
    """(enc_month, other_month): folders that hold members of one group; only groups of several months have any."""
    spread = obs.filter(F.col("obs_group_id").isNotNull()).groupBy("obs_group_id").agg(F.collect_set("enc_month").alias("all")).filter(F.size("all") > 1)
    pairs = spread.select(F.explode("all").alias("enc_month"), "all").select("enc_month", F.explode("all").alias("other_month"))
    return pairs.filter("enc_month <> other_month").distinct()


def store_indexes(obs: DataFrame, encounter: DataFrame, path: str) -> None:
    """Write the side tables of stored observations; the one by visit is partitioned by month.

    Without the columns that one of them is found by, it is empty, as nothing can ask for it.
    """
    root = path.rstrip("/")
    made = {
        "obs_months_by_visit": ("visit_id", encounter, lambda: months_by_visit(obs, encounter)), "obs_months_by_person": ("person_id", obs, lambda: months_by_person(obs)),
        "obs_months_by_time": ("concept_id", obs, lambda: months_by_time(obs)), "obs_months_by_group": ("obs_group_id", obs, lambda: months_by_group(obs)),
    }
    for name, (asked, source, make) in made.items():
        table = make() if asked in source.columns else obs.sparkSession.createDataFrame([], INDEXES[name])
        if name == "obs_months_by_visit":
            table.repartitionByRange("month", "visit_id").sortWithinPartitions("month", "visit_id").write.mode("overwrite").partitionBy("month").parquet(f"{root}/{name}")
        else:
            first = table.columns[0]
            table.repartitionByRange(first).sortWithinPartitions(first).write.mode("overwrite").parquet(f"{root}/{name}")


def load_indexes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The side tables stored with observations; none where the observations were stored alone.

    They hold for the observations they were written with: give a report both or neither.
    """
    root = path.rstrip("/")
    try:
        if "enc_month" not in spark.read.parquet(f"{root}/obs").columns:
            return {}
        return {name: spark.read.schema(schema).parquet(f"{root}/{name}") for name, schema in INDEXES.items()}
    except AnalysisException:
        return {}


def month_list(found: DataFrame, column: str = "enc_month") -> list[str]:
    """The months of the rows, on the driver: as many as there are months at most."""
    return sorted(r[0] for r in found.select(F.col(column)).distinct().collect())


def of_visits(index: DataFrame, visits: DataFrame, start=None, end=None) -> list[str]:
    """Months of the visits' observations; each visit has an encounter between the days."""
    return month_list(in_months(index, start, end).join(visits.select("visit_id"), "visit_id", "left_semi"))


def of_persons(index: DataFrame, persons: DataFrame) -> list[str]:
    return month_list(index.join(persons.select("person_id"), "person_id", "left_semi"))


def of_times(index: DataFrame, concepts: list[int], kind: str, start=None, end=None) -> list[str]:
    """Months that hold answers to the questions with their own time between the days."""
    asked = index.filter((F.col("kind") == kind) & F.col("concept_id").isin(concepts))
    return month_list(in_months(asked, start, end, "at_month"))


def with_groups(index: DataFrame, months: list[str]) -> list[str]:
    """The months, and those that hold other members of groups in them."""
    return sorted({*months, *month_list(index.filter(F.col("enc_month").isin(months)), "other_month")})
