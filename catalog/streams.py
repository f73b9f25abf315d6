"""Streaming forms, run over the event table as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import ORACLES, query
from catalog.clinical import _INFANT, _label
from catalog.sources_filters import fresh_folder
from wardline.streaming import live


def event_stream(t) -> DataFrame:
    schema = t.events.schema
    # A pattern, since the table may be one file or a folder of part files.
    raw = t.spark.readStream.schema(schema).parquet(f"{t.path}/[e]vents.parquet")
    return raw.withColumn("k", F.regexp_extract("props", "[0-9]+", 0).cast("int"))


def as_vitals(ev: DataFrame) -> DataFrame:
    whole = F.floor("value").cast("int")
    return ev.select(
        "event_id", F.when(F.col("k") % 10 != 0, 30 + whole % 160).alias("heart_rate"), (8 + (whole + F.col("k")) % 80).alias("respiratory_rate"),
        ((340 + (F.floor(F.col("value") * 10).cast("int") + F.col("k")) % 70).cast("double") / 10).alias("temperature_c"),
        (85 + (whole + F.col("k")) % 16).alias("o2_sat"), ((F.floor(F.col("value") * 7).cast("int") % 100).cast("double") / 10).alias("glucose"),
    )


@query("stream_vitals_priority", f"""
WITH s AS (SELECT event_id, {_INFANT} AS total FROM vitals) SELECT event_id, total, {_label('total')} AS priority FROM s
""")
def _(t):
    folder = fresh_folder(t.spark, "vitals-stream")
    scored = live.vitals_stream(as_vitals(event_stream(t)), "infant", ["event_id"])
    live.run_to_folder(scored, folder, f"{folder}-state").awaitTermination()
    return t.spark.read.schema(scored.schema).parquet(folder)


@query("stream_current_location")
def _(t):
    folder = fresh_folder(t.spark, "location-stream")
    kinds = {"signup": "admission", "view": "transfer", "purchase": "discharge"}
    kind = F.col("event_type")
    for old, new in kinds.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    adt = event_stream(t).select(
        F.col("event_id").alias("encounter_id"), F.col("user_id").alias("patient_id"), kind.alias("encounter_type"),
        F.col("ts").alias("encounter_datetime"), (F.col("k") % 12).cast("int").alias("location_id"), (F.col("value") < 5).alias("voided"),
    )
    placed = live.location_stream(adt, ["admission", "transfer"], ["discharge"])
    live.run_updates(placed, folder, f"{folder}-state").awaitTermination()
    return live.latest_updates(t.spark.read.parquet(folder), "patient_id")


# The stream must end where the batch does.
ORACLES["stream_current_location"] = ORACLES["current_location"]
