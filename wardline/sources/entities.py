"""Reading entity tables and publishing new versions of tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardline.operators.filters import date_range, in_months
from wardline.sources.months import by_encounter_month, store_indexes
from wardline.sources.schemas import ENTITIES, FACT_TIMES


def load_entities(
    spark: SparkSession, path: str, names: Iterable[str] | None = None,
    schemas: Mapping[str, StructType] = ENTITIES, suffix: str = "",
) -> dict[str, DataFrame]:
    """Entity tables stored as ``<path>/<name><suffix>`` in parquet.

    Schemas are declared, so nothing is inferred and only used columns are read.
    """
    return {
        name: spark.read.schema(schemas[name]).parquet(f"{path.rstrip('/')}/{name}{suffix}").select(*schemas[name].fieldNames())
        for name in (names or schemas)
    }


def load_between(spark: SparkSession, path: str, name: str, start=None, end=None) -> DataFrame:
    """A stored fact table cut to a date range.

    Encounters of other months are not opened.  Observations may lie in the month of
    their encounter, which says nothing about their own time, so all are read.
    """
    rows = stored_facts(spark, path, name)
    if name == "encounter":
        rows = in_months(rows, start, end)
    return date_range(rows, FACT_TIMES[name], start, end).drop("month", "enc_month")


def stored_facts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored fact table with its month, by which dated reports open only the folders they need."""
    return spark.read.schema(ENTITIES[name]).parquet(f"{path.rstrip('/')}/{name}")


def load_entities_jdbc(
    spark: SparkSession, url: str, names: Iterable[str], options: Mapping[str, str],
    bounds: Mapping[str, tuple[str, int, int, int]] | None = None,
) -> dict[str, DataFrame]:
    """Entity tables read in place over JDBC.

    ``bounds`` gives (column, lowest, highest, partitions) per table so that large
    tables are read by many tasks.  Facts must have bounds; another table without them
    is read by one task.
    """
    tables = {}
    names = list(names)
    unbounded = [name for name in names if name in FACT_TIMES and name not in (bounds or {})]
    if unbounded:
        raise ValueError(f"facts need bounds to be read by many tasks: {', '.join(unbounded)}")
    for name in names:
        reader = spark.read.format("jdbc").options(**options).option("url", url).option("dbtable", name)
        if bounds and name in bounds:
            column, low, high, parts = bounds[name]
            reader = (
                reader.option("partitionColumn", column).option("lowerBound", low)
                .option("upperBound", high).option("numPartitions", parts)
            )
        tables[name] = reader.load()
    return tables


def store_entities(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write entity tables for repeated reports; facts are partitioned by month.

    Observations stored with their encounters lie in folders of ``enc_month``, the
    month of their encounter (their own where it is unknown), so a report that asks for
    encounters of a month finds their observations in one folder; side tables
    (``months.py``) say where those of a visit, person, time or group lie.  Stored alone they lie
    in their own ``month``, by which no report is cut.  Encounters stored again without
    the observations that lie in their months are an error, as their dates may differ.
    Rows are dealt by ranges of month and encounter: few files a month, a month of many
    rows spread over tasks, and an encounter's observations side by side.
    """
    if "encounter" in tables and "obs" not in tables:
        try:
            there = tables["encounter"].sparkSession.read.parquet(f"{path}/obs").columns
        except AnalysisException:
            there = []
        if "enc_month" in there:
            raise ValueError("observations are stored by the months of their encounters: store both together")
    together = "encounter" in tables and "obs" in tables
    for name, table in tables.items():
        if name in FACT_TIMES:
            month = "enc_month" if name == "obs" and together else "month"
            if month == "enc_month":
                dated = by_encounter_month(table, tables["encounter"])
            else:
                dated = table.withColumn(month, F.date_format(FACT_TIMES[name], "yyyy-MM"))
            dealt = dated.repartitionByRange(month, "encounter_id") if "encounter_id" in dated.columns else dated.repartitionByRange(month)
            dealt.sortWithinPartitions(month, *(["encounter_id"] if "encounter_id" in dated.columns else [])).write.mode("overwrite").partitionBy(month).parquet(f"{path}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
    if together:
        spark, obs = tables["obs"].sparkSession, tables["obs"]
        schema = StructType([*(f for f in obs.schema if f.name != "enc_month"), StructField("enc_month", StringType())])
        store_indexes(spark.read.schema(schema).parquet(f"{path}/obs"), tables["encounter"], path)


def materialize_table(df: DataFrame, root: str, version: str) -> DataFrame:
    """Write a table as a new version folder and return it read back.

    Readers keep their version until they are pointed at the new one, and a failed
    write leaves earlier versions untouched.  A version that exists is an error.
    """
    target = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def publish_view(df: DataFrame, name: str, root: str, version: str) -> DataFrame:
    """Materialize a version and swap the named view to it."""
    fresh = materialize_table(df, root, version)
    fresh.createOrReplaceTempView(name)
    return fresh
