"""Importance resampling of documents towards a target text's word n-grams."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import pieces, written
from wardline.llm.radix_sort import radix_ranks

BUCKETS = 10_000
HELD_BYTES = 2_000_000
LONG_WORD = 64
SCORED = "row long, id long, n_words long, n_features long, weight long, score long"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    """What each byte does to a checksum: the table of the reflected polynomial, by its rule."""
    state = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        state = np.where(state & 1, (state >> 1) ^ np.uint32(0xEDB88320), state >> 1).astype(np.uint32)
    return state


@lru_cache(maxsize=1)
def _shift_tables() -> np.ndarray:
    """[n, j, b]: a checksum whose byte ``j`` is ``b`` and whose others are 0, after ``n`` bytes of 0."""
    table = _crc_table()
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = np.empty((LONG_WORD + 1, 4, 256), dtype=np.uint32)
    for n in range(LONG_WORD + 1):
        out[n] = state
        state = table[state & 0xFF] ^ (state >> 8)
    return out


def _checksums(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes; equally long runs advance together."""
    table = _crc_table()
    order = np.argsort(-lengths, kind="stable")
    begin, size = starts[order], lengths[order]
    state = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    long = int(np.searchsorted(-size, -LONG_WORD, side="left"))
    active = len(size)
    for k in range(int(size[long]) if long < len(size) else 0):
        active = int(np.searchsorted(-size, -k, side="left"))
        part = state[long:active]
        state[long:active] = table[(part ^ data[begin[long:active] + k]) & 0xFF] ^ (part >> 8)
    out = np.empty(len(starts), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i]: starts[i] + lengths[i]].tobytes())
    return out


def feature_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, buckets of all words, buckets of all pairs of neighbours).

    Pairs are those of the whole run: the one that starts at a text's last word belongs to no text.
    The checksum of ``a b`` is that of ``a `` moved on by the bytes of ``b``, plus that of ``b``.
    """
    column = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    none = np.zeros(0, dtype=np.uint32)
    if first == last:
        return np.zeros(len(column), dtype=np.int64), none, none
    data = _LOWER[np.frombuffer(column.buffers()[2], dtype=np.uint8)[first:last]]
    offsets = offsets - first
    inside = _LETTER[data]
    before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    before[cut] = False
    after[cut - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    counts, lengths = np.diff(np.searchsorted(starts, offsets)), stops - starts
    single = _checksums(data, starts, lengths)
    if len(starts) < 2:
        return counts, single % BUCKETS, none
    table, shifts = _crc_table(), _shift_tables()
    state = single[:-1] ^ np.uint32(0xFFFFFFFF)
    spaced = (table[(state ^ np.uint32(0x20)) & 0xFF] ^ (state >> 8)) ^ np.uint32(0xFFFFFFFF)
    moved = np.minimum(lengths[1:], LONG_WORD)
    pair = single[1:].copy()
    for j in range(4):
        pair ^= shifts[moved, j, (spaced >> np.uint32(8 * j)) & 0xFF]
    for i in np.flatnonzero(lengths[1:] > LONG_WORD).tolist():
        pair[i] = zlib.crc32(data[starts[i + 1]: stops[i + 1]].tobytes(), int(spaced[i]))
    return counts, single % BUCKETS, pair % BUCKETS


def _inner(counts: np.ndarray) -> np.ndarray:
    """Which pairs of neighbours lie inside one text."""
    total = int(counts.sum())
    keep = np.ones(max(total - 1, 0), dtype=bool)
    ends = np.cumsum(counts)
    ends = ends[(ends > 0) & (ends < total)]
    keep[ends - 1] = False
    return keep


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for part in pieces([batch], "text", HELD_BYTES):
            counts, single, pair = feature_buckets(part.column("text"))
            held += np.bincount(single, minlength=BUCKETS) + np.bincount(pair[_inner(counts)], minlength=BUCKETS)
    seen = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(held[seen], pa.int64())], ["bucket", "n"])


def bucket_counts(df: DataFrame, text_col: str = "text") -> list[int]:
    """How many n-grams of all texts fall into each bucket; tasks send one number a bucket."""
    parts = df.select(F.col(text_col).alias("text")).mapInArrow(_count, "bucket long, n long")
    out = [0] * BUCKETS
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """What one n-gram of each bucket adds: a thousand times the log ratio of the smoothed shares."""
    s_all, t_all = sum(source), sum(target)
    return [
        math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS)))) for s, t in zip(source, target, strict=True)
    ]


def _scorer(gain: list[int], seed: int):
    def noise(key) -> int:
        head = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((head + 0.5) / 4294967296)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = np.array(gain, dtype=np.int64)
        for batch in batches:
            for part in pieces([batch], "text", HELD_BYTES):
                counts, single, pair = feature_buckets(part.column("text"))
                one = np.concatenate([[0], np.cumsum(worth[single])])
                two = np.concatenate([[0], np.cumsum(np.where(_inner(counts), worth[pair], 0))])
                ends = np.cumsum(counts)
                starts = ends - counts
                total = one[ends] - one[starts]
                several = counts > 1
                total[several] += two[ends[several] - 1] - two[starts[several]]
                n = counts + np.maximum(counts - 1, 0)
                weight = np.floor_divide(total, np.maximum(n, 1))
                score = weight + np.array([noise(k) for k in part.column("id").to_pylist()], dtype=np.int64)
                made = [pa.array(x, pa.int64()) for x in (counts, n, weight, score)]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), *made], ["row", "id", "n_words", "n_features", "weight", "score"])

    return score


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Draws ``percent`` of the documents, without replacement, by how much they look like the target.

    A text's features are its words (runs of ASCII letters, digits and characters outside
    ASCII, A-Z lowered) and pairs of neighbours, hashed into buckets.  A bucket's gain is
    the log ratio of its share in the target's texts and in all documents; the weight is
    the mean gain, looked up in one array; a hash of the id adds the noise that makes the
    highest scores a draw.  Documents of ``least_words`` words or more are put in order by
    ``radix_ranks``: higher scores first, then smaller ids.

    Ids are integers.  Returns per input row: id, n_features, weight, score, rank (null
    where not drawn).  Null and empty texts have no features, weight 0 and are not
    drawn; repeated rows are documents each; a row without an id comes after all
    of its score; an empty table gives no rows, an empty target leaves the smoothed
    shares; other columns are neither read nor returned.
    """
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target, target_col))
    # Row numbers are given once and stored, so that they can be met again.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scored = written(rows.mapInArrow(_scorer(gain, seed), SCORED), "scores")
    able = scored.filter(F.col("n_words") >= least_words)
    top = able.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")).first()
    drawn = percent * top["n"] // 100
    high = (F.lit(top["top"] or 0) - F.col("score")) * 2 + F.col("id").isNull().cast("long")
    ranks = radix_ranks(able, high, F.coalesce("id", F.lit(0)), "row").filter(F.col("place") < drawn)
    out = scored.join(ranks.select("row", (F.col("place") + 1).alias("rank")), "row", "left")
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")

