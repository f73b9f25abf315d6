"""CSV report files."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.text import printable

# The report file format.
DATE_FORMAT = "dd-MMM-yyyy HH:mm:ss"
CHARSET = "ISO-8859-1"
FORMAT = {"header": True, "encoding": CHARSET, "escape": '"', "quote": '"'}


def export_columns(df: DataFrame) -> dict[str, Column]:
    """Every column as report text: cleaned strings and formatted dates."""
    out = {}
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            out[field.name] = printable(column)
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            out[field.name] = F.date_format(column, DATE_FORMAT)
        else:
            out[field.name] = column
    return out


def export_name(base: str, as_of: datetime) -> str:
    return f"{base}.{as_of:%Y%m%d}.{as_of:%H%M}"


def export_csv(df: DataFrame, folder: str, base: str, as_of: datetime, compress: bool = True) -> str:
    """Write the report as CSV part files and return their folder."""
    target = f"{folder.rstrip('/')}/{export_name(base, as_of)}"
    writer = df.select(*[c.alias(n) for n, c in export_columns(df).items()]).write.mode("overwrite")
    writer = writer.options(**FORMAT, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if compress:
        writer = writer.option("compression", "gzip")
    writer.csv(target)
    return target


def read_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a written report, line ends inside quotes included."""
    return spark.read.schema(schema).options(**FORMAT, multiLine=True).csv(folder)


def manifest(report: DataFrame) -> DataFrame:
    """What each part of a report holds: its name, character set, quote and number of rows."""
    return report.groupBy(F.col("_metadata.file_name").alias("part")).agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"charset": F.lit(CHARSET), "quote": F.lit(FORMAT["quote"])}
    )


def export_bundle(sets: Mapping[str, DataFrame], folder: str, base: str, as_of: datetime, compress: bool = True) -> dict[str, str]:
    """Write every data set of a report and return their folders."""
    return {name: export_csv(df, folder, f"{base}.{name}", as_of, compress) for name, df in sets.items()}
