"""Streaming forms of the vitals priority, patient location and duplicate rules.

The batch operators are used as they are; these functions add only what a stream
needs: watermarks, output modes and sinks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardline.functions.scoring import priority_label, vitals_total
from wardline.operators.programs import current_location


def vitals_stream(vitals: DataFrame, profile: str, keep: Sequence[str]) -> DataFrame:
    """Score and priority per row; no state."""
    return vitals.select(*keep, vitals_total(profile).alias("total")).withColumn("priority", priority_label(F.col("total")))


def location_stream(encounters: DataFrame, enter_types: Sequence, leave_types: Sequence) -> DataFrame:
    """Current place per patient; one row of state per patient, for update mode."""
    return current_location(encounters, enter_types, leave_types)


def distinct_dispenses(dispenses: DataFrame, at: str, keys: Sequence[str], seconds: int) -> DataFrame:
    """Dispenses without repeats of the same keys inside the watermark."""
    return dispenses.withWatermark(at, f"{int(seconds)} seconds").dropDuplicatesWithinWatermark(list(keys))


def run_to_folder(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append everything available to a parquet folder, then stop."""
    return (
        stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def run_updates(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the updated rows of every batch to its own folder, then stop.

    A batch that is run again after a failure overwrites its folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .outputMode("update").trigger(availableNow=True).start()
    )


def latest_updates(updates: DataFrame, key: str) -> DataFrame:
    """The last update of every key, from folders written by ``run_updates``."""
    columns = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("_row")).select(key, "_row.*")
