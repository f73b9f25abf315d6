"""Session settings the plans are written for."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime SQL settings.  Dictionary joins carry no broadcast hint: Spark compares
# the measured size with the threshold and falls back to a sort-merge join (split
# by the skew rule when one answer code dominates).
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    # Wide pivots hold lists and structs; more groups stay hashed before sorting.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
}


_LOCAL_SCRATCH: dict[str, str] = {}


def build_session(master: str | None = None, app: str = "wardline", **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates.

    Clusters name it in ``spark.checkpoint.dir``; a temporary folder is used only
    when that is unset and the master is local (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return _LOCAL_SCRATCH.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="wardline-"))
