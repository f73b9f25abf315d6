"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import scratch_dir

FOLDS = 5
BATCH_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands rows to Python in batches of about 2 MB.

    Rows are handed over by the thousand else, 20 MB and more of texts, which executor
    and workers hold several times over.  Narrow rows still come by the thousand.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns labels from: crc32 of the id as text, modulo 5, is 0.

    A row without an id is held out.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again (a lost executor costs nothing)."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose values in ``column`` hold about ``most`` bytes.

    A row is never cut: one longer than ``most`` makes a run of its own.
    """
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def sample_labels(labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """At most ``most`` labelled ids of each value of ``columns[0]``, picked by the id's hash.

    Only rows outside the held-out fold; the result is bounded by ``most`` and the
    number of label values, so it may be broadcast.
    """
    target = columns[0]
    rows = labels.filter(~held_out(F.col("doc_id")) & F.col(target).isin(0, 1)).select("doc_id", *columns).distinct()
    ordered = rows.orderBy(F.xxhash64("doc_id"), "doc_id", *columns)
    return ordered.filter(F.col(target) == 0).limit(most).unionAll(ordered.filter(F.col(target) == 1).limit(most))


def lowest_hashes(df: DataFrame, by: Column, most: int) -> Column:
    """A test that holds for the rows of the ``most`` lowest distinct hashes of ``by``.

    Only hashes travel to find the bound; equal values pass or fail together.
    """
    code = F.xxhash64(by)
    found = df.select(code.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return F.lit(False) if found is None else code <= F.lit(found)


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, most: int, most_bytes: int) -> list[tuple[str, int]]:
    """A bounded sample of (text, label) on the driver, for fitting a model.

    ``most`` texts of each label at most, each of ``most_bytes`` bytes at most (a longer
    text is not in the sample; scoring still reads whole texts).  Texts come in the
    order of their id's hash, so the sample does not depend on the partitioning.
    """
    picked = F.broadcast(sample_labels(labels, [target], most).toDF("_id", "_label"))
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
        .filter(F.col("_text").isNotNull() & (F.octet_length("_text") <= most_bytes))
        .join(picked, "_id").select("_id", "_text", "_label").collect()
    )
    rows = sorted({(r["_id"], r["_text"], r["_label"]) for r in rows})
    return [(text, label) for _, text, label in rows]
