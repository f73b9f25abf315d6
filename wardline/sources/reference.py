"""Dimension CSV files with placeholders, retire flags and wide tag matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fill_placeholders(column: Column, constants: Mapping[str, str]) -> Column:
    """Replace ``${name}`` by its constant; unknown names stay as written."""
    out = column
    for name, value in constants.items():
        out = F.replace(out, F.lit("${" + name + "}"), F.lit(value))
    return out


def resolve_reference(df: DataFrame, constants: Mapping[str, str], retired: str | None = None) -> DataFrame:
    """Fill placeholders in the text columns and drop retired rows."""
    if retired and retired in df.columns:
        df = df.filter(~F.coalesce(F.upper(F.col(f"`{retired}`").cast("string")) == "TRUE", F.lit(False))).drop(retired)
    if constants:
        text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
        df = df.withColumns({name: fill_placeholders(F.col(f"`{name}`"), constants) for name in text})
    return df


def load_reference_csv(
    spark: SparkSession, path: str, constants: Mapping[str, str] | None = None, retired: str = "Void/Retire",
) -> DataFrame:
    """A dimension CSV with a header; every column is text."""
    return resolve_reference(spark.read.option("header", True).option("escape", '"').csv(path), constants or {}, retired)


def load_constants(spark: SparkSession, path: str, most: int = 100_000) -> dict[str, str]:
    """``name=value`` lines as a mapping; comment and blank lines are skipped.

    A configuration file of a few kilobytes, read once per job; one of more than
    ``most`` lines is an error.
    """
    lines = spark.read.text(path).filter(F.col("value").rlike(r"^\s*[^#\s][^=]*="))
    pair = F.split("value", "=", 2)
    rows = lines.select(F.trim(pair[0]).alias("name"), F.trim(pair[1]).alias("value")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{path} has more than {most} constants")
    return {row["name"]: row["value"] for row in rows}


def unpivot_tags(df: DataFrame, key: str, tags: Sequence[str] | None = None, tag: str = "tag") -> DataFrame:
    """A wide boolean matrix as (key, tag) rows for its TRUE cells."""
    columns = [c for c in (tags or df.columns) if c != key]
    long = df.select(key, *[F.upper(F.col(f"`{c}`").cast("string")).alias(c) for c in columns])
    return long.unpivot([key], [F.col(f"`{c}`") for c in columns], tag, "_set").filter(F.col("_set") == "TRUE").drop("_set")
