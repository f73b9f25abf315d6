"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again before the next.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import mixing, quality_classifier
from wardline.llm.common import read, small_batches, written
from wardline.llm.jaccard_join import jaccard_join
from wardline.llm.packing import pack_documents
from wardline.llm.substring_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject.

    Null and empty texts get the score of no evidence and stay unless that is below
    the threshold.
    """
    small_batches(spark)
    model = quality_classifier.train(docs, read(spark, sf_dir, "labels"))
    scored = quality_classifier.score_quality(docs, model, carry=COLUMNS[1:])
    return scored.filter("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked at 0.8 over five-word shingles.

    Documents without words and rows without an id stay.  The ids that go are written,
    so that their size decides how they meet the texts.
    """
    small_batches(spark)
    gone = jaccard_join(docs, percent=80, n=5).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(written(gone, "duplicates"), "doc_id", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that a smaller id holds.

    Untouched texts stay as they are; a document of which no word is left goes.
    """
    small_batches(spark)
    left = remove_repeats(docs, spacing=True, carry=("lang", "source"))
    kept = left.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture wants them, at least once.

    The total is the smallest at which no language loses a token, so others repeat, each
    document ``mixing.HIGHEST`` times at most.
    """
    small_batches(spark)
    model = mixing.language_model(docs, read(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, model, mixing.MIXTURE, lowest=1.0, highest=mixing.HIGHEST, carry=COLUMNS[1:])
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences; ``copy`` tells repeated documents apart."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality), ("near duplicates", near_duplicates), ("substring dedup", repeats), ("mixing", mixture), ("packing", packing),
]

# Trained models and packing have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each but the last is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir).select(*COLUMNS), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
