"""Token counts kept in a cache by digest of content and tokenizer version."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from wardline.llm import tokens

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
SEEN = 500_000


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts, each once per task as far as the bounded memory of digests goes."""
    import zstandard

    press, seen = zstandard.ZstdCompressor(level=1), set()
    for batch in batches:
        digests, blobs = [], []
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if digest in seen:
                continue
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(digest)
            digests.append(digest)
            blobs.append(press.compress(text))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(blobs, pa.binary())], ["digest", "blob"])


def _counter(path: str, version: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counter, open_, seen = tokens.ByteCounter(path), zstandard.ZstdDecompressor(), set()
        for batch in batches:
            digests, counts = [], []
            for digest, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    counts.append(counter.count(open_.decompress(blob).decode()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(digests), pa.string()), pa.array(digests, pa.binary()), pa.array(counts, pa.int64())],
                ["tokenizer", "digest", "n_tokens"],
            )

    return count


def _cache(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CACHE_SCHEMA)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """Tokens of each whole text, encoding only contents that the cache does not hold.

    ``cache`` is a Parquet folder all executors reach, made when it is missing.  A
    content is known by the SHA-256 of its UTF-8 bytes (this vocabulary normalises
    nothing, so neither does the digest) and a tokenizer by the digest of its file,
    the library version and the options.  Texts travel compressed, one copy per
    task and content; copies of one text share a digest, so a hot text costs one
    encoding and its documents meet the count in a join that splits hot keys.

    Returns id, n_bytes, n_tokens, over_limit for every input row.  A null text is
    an empty one (0 bytes, 0 tokens); repeated rows give repeated rows; an empty
    table gives no rows; other columns are neither read nor returned.
    """
    spark, version = docs.sparkSession, tokens.version(tokenizer)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    known = _cache(spark, cache).filter(F.col("tokenizer") == version)
    contents = docs.select(digest.alias("digest"), text.alias("text")).mapInArrow(_packed, "digest binary, blob binary")
    misses = contents.join(known.select("digest"), "digest", "left_anti").select("digest", "blob")
    counted = misses.repartition("digest").mapInArrow(_counter(tokenizer, version), CACHE_SCHEMA)
    counted.write.mode("append").parquet(cache)
    counts = (
        spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
        .groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    )
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    return rows.join(counts, "digest", "left").select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
