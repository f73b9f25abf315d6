"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.views import Tables, oracle
from wardline.operators.dictionary import labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The day every "now" stands for.
NOW = "2024-01-31 00:00:00"


def plain(df: DataFrame) -> DataFrame:
    """Dates as text, so that both sides show them alike."""
    days = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    return df.withColumns({name: F.col(name).cast("string") for name in days}) if days else df


def query(name: str, sql: str | None = None):
    """Register a builder taking ``Tables`` under a name, with its SQL twin."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, path: plain(build(Tables(spark, path)))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return build

    return wrap


def english(t: Tables) -> DataFrame:
    return labels(t.concept_name, "en")


def months_sql(a: str, b: str) -> str:
    """Whole months from a to b (a not after b) in DuckDB."""
    return (
        f"((year({b}) * 12 + month({b})) - (year({a}) * 12 + month({a})) "
        f"- CASE WHEN (day({b}), CAST({b} AS TIME)) < (day({a}), CAST({a} AS TIME)) THEN 1 ELSE 0 END)"
    )


def years_sql(a: str, b: str) -> str:
    """Whole years between a and b, truncated towards zero, in DuckDB."""
    return f"(CASE WHEN {b} >= {a} THEN {months_sql(a, b)} // 12 ELSE -({months_sql(b, a)} // 12) END)"


def weeks_sql(a: str, b: str) -> str:
    return f"CAST(trunc((epoch_us({b}) - epoch_us({a})) / 604800000000.0) AS BIGINT)"
