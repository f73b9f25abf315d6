"""Exact n-gram Jaccard join with prefixes of single tokens and token combinations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import pieces, written
from wardline.llm.components import components
from wardline.llm.hashing import M1, mix, windows, words_of

HELD_BYTES = 1 << 20
# Counters of the frequency sketch (its levels are broadcast: one byte each) and the
# part of it that one row carries.
SKETCH_BITS, SEGMENT_BITS = 22, 12
# Sets of up to SMALL tokens are indexed by single tokens only; above, frequent tokens
# fall into GROUPS groups and are indexed by pairs inside a group.
SMALL, GROUPS = 128, 64
# Members of a block when groups of one key are compared further, rows that one such
# table may hold, and pairs compared at once.
BLOCK, SLOT_ROWS, PAIRS = 512, 8_000, 20_000
# Classes of tokens that a set's shape counts.
CLASSES = 128
# Lowest open keys that a set brings along: what tells whether a pair meets under a lower key, too.
HEADS = 64


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are folded.

    A text of fewer than ``n`` words has its whole sequence as one shingle, one
    without words has none.
    """
    words = words_of(texts, lower=True)
    whole = windows(words.hashes, n)
    out = []
    for end, count in zip(words.ends.tolist(), words.counts.tolist(), strict=True):
        if count >= n:
            out.append(np.unique(whole[end - count: end - n + 1]))
        else:
            out.append(windows(words.hashes[end - count: end], count, seed=count) if count else np.zeros(0, np.uint64))
    return out


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _count(n: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for batch in pieces(batches, "text", HELD_BYTES):
            found = shingle_sets(batch.column(0), n)
            if found:
                np.add.at(counts, (np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        if counts.any():
            press = zstandard.ZstdCompressor(level=1)
            parts = counts.reshape(-1, 1 << SEGMENT_BITS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([press.compress(p.tobytes()) for p in parts], pa.binary())], ["segment", "counts"]
            )

    return count


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for segment, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.int32)
            sums[segment] = sums.get(segment, 0) + part.astype(np.int64)
    if sums:
        # Eight levels to each doubling.
        yield pa.RecordBatch.from_arrays([
            pa.array(list(sums), pa.int32()), pa.array([int(x.sum()) for x in sums.values()], pa.int64()),
            pa.array([np.minimum(255, 8 * np.log2(1 + x)).astype(np.uint8).tobytes() for x in sums.values()], pa.binary()),
        ], ["segment", "total", "levels"])


def token_levels(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, int]:
    """How frequent each token is, as levels of a counting sketch, and the level from which it is frequent.

    Counts cover all documents.  The sketch has a fixed size: each task counts into
    its own, segments are added up where they meet, and one byte for each of the
    2^22 counters reaches the driver.  A counter shared by many tokens only blurs
    the order of tokens, which may be any order.
    """
    rows = (
        _texts(docs, id_col, text_col).select("text").mapInArrow(_count(n), "segment int, counts binary")
        .repartition("segment").mapInArrow(_add, "segment int, total long, levels binary").collect()
    )
    levels = np.zeros((1 << (SKETCH_BITS - SEGMENT_BITS), 1 << SEGMENT_BITS), dtype=np.uint8)
    for row in rows:
        levels[row["segment"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    mean = sum(row["total"] for row in rows) / (1 << SKETCH_BITS)
    return levels.reshape(-1), int(min(255, 8 * np.log2(1 + 64 + 4 * mean)))


def needed(size: int, percent: int) -> int:
    """Tokens a set of this size may lack in a partner, plus one: what a prefix must cover."""
    return size - -(-percent * size // 100) + 1


def prefix_and_keys(tokens: np.ndarray, size: int, frequent: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set's ordered tokens and the keys it is indexed under.

    A single token covers one missing token; m frequent tokens of one group, indexed
    by pairs, cover m - 1.  The prefix grows until it covers ``needed``: two similar
    sets then share a single token or a pair.  Sets of up to SMALL tokens use single
    tokens alone, and those which both kinds of partners may meet use both ways.
    """
    need = needed(size, percent)
    keys, length = [], 0
    with np.errstate(over="ignore"):
        if 100 * SMALL >= percent * size:
            length = need
            keys.append(mix(tokens[:need] * M1))
        if size > SMALL:
            common = (tokens >> np.uint64(56)) >= frequent
            group = (mix(tokens) % np.uint64(GROUPS)).astype(np.int64)
            seen: dict[int, list] = {}
            # Rare tokens come first: each is a key and covers one.
            covered = at = min(need, len(tokens) if not common.any() else int(common.argmax()))
            made = [(token, np.uint64(0)) for token in tokens[:at]]
            while covered < need:
                token = tokens[at]
                if common[at]:
                    others = seen.setdefault(int(group[at]), [])
                    covered += bool(others)
                    made.extend((o, token) for o in others)
                    others.append(token)
                else:
                    covered += 1
                    made.append((token, np.uint64(0)))
                at += 1
            pairs = np.array(made, dtype=np.uint64).reshape(-1, 2)
            keys.append(mix(mix(pairs[:, 0] + np.uint64(1)) ^ (pairs[:, 1] * M1)))
            length = max(length, at)
    return tokens[:length], np.unique(np.concatenate(keys))


def _order(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles as numbers that sort from rare to frequent."""
    level = levels[(shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort((level << np.uint64(56)) | (shingles >> np.uint64(8)))


def _sets(n: int, percent: int, levels: np.ndarray, frequent: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", HELD_BYTES):
            found = shingle_sets(batch.column(1), n)
            one, two, prefixes, commons, shapes = [], [], [], [], []
            with np.errstate(over="ignore"):
                for shingles in found:
                    one.append(int(mix(shingles).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(mix(shingles * M1).sum(dtype=np.uint64).view(np.int64)))
                    prefix = shingles
                    if len(shingles):
                        prefix, _ = prefix_and_keys(_order(shingles, levels), len(shingles), frequent, percent)
                    # The text that copies were made from has no rare tokens of its own.
                    commons.append(int((prefix >> np.uint64(56)).mean()) if len(prefix) else 0)
                    prefixes.append(prefix.tobytes())
                    shapes.append(np.bincount(((shingles >> np.uint64(9)) % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([len(s) for s in found], pa.int64()),
                pa.array(commons, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(shapes, pa.binary()),
            ], ["id", "one", "two", "size", "common", "prefix", "shape"])

    return make


def _entries(percent: int, frequent: int):
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [np.frombuffer(x, dtype=np.uint64) for x in batch.column(2).to_pylist()]
            keys = [prefix_and_keys(x, n, frequent, percent)[1] for x, n in zip(prefixes, batch.column(1).to_pylist(), strict=True)]
            if keys:
                spread = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(pa.array(spread))], ["key", "id"])

    return entries


def surviving(one: np.ndarray, size_one: np.ndarray, two: np.ndarray, size_two: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets may be similar; exact in ruling out.

    A shape counts a set's tokens by class, modulo 256.  Where two sets' counts of a
    class differ, so many tokens at least are in one of them only.
    """
    total = size_one + size_two
    most = total - 2 * -(-percent * total // (100 + percent))
    apart = np.abs(one.astype(np.int16) - two.astype(np.int16))
    apart = np.minimum(apart, 256 - apart).sum(axis=1, dtype=np.int64)
    return (100 * np.minimum(size_one, size_two) >= percent * np.maximum(size_one, size_two)) & (apart <= most)


def _shapes(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, CLASSES)


def _prune(percent: int):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            keep = surviving(_shapes(rows["shape_a"]), np.array(rows["size_a"]), _shapes(rows["shape_b"]), np.array(rows["size_b"]), percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return prune


def _blocks(percent: int):
    def compare(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        # Pairs meet under many keys, which lie in many tables; the lowest key they share counts.
        heads = {id_: frozenset(keys) for id_, keys in zip(rows["id"], rows["heads"], strict=True)}
        cells: dict[tuple, tuple[list, list]] = {}
        for i, cell in enumerate(zip(rows["key"], rows["bi"], rows["bj"], strict=True)):
            sides = cells.setdefault(cell, ([], []))
            if rows["block"][i] == cell[1]:
                sides[0].append(i)
            if rows["block"][i] == cell[2]:
                sides[1].append(i)
        size, component, ids, shape = np.array(rows["size"]), np.array(rows["component"]), np.array(rows["id"]), _shapes(rows["shape"])
        ones, twos, under, waiting = [], [], [], 0
        found: list[np.ndarray] = [np.zeros((0, 2), np.int64)]

        def flush() -> None:
            nonlocal waiting
            if ones:
                i, j, keys = np.concatenate(ones), np.concatenate(twos), np.concatenate(under)
                for at in range(0, len(i), PAIRS):
                    a, b = i[at: at + PAIRS], j[at: at + PAIRS]
                    may = surviving(shape[a], size[a], shape[b], size[b], percent)
                    x, y = ids[a[may]], ids[b[may]]
                    low = [min(heads[p] & heads[q], default=key) >= key for p, q, key in zip(x.tolist(), y.tolist(), keys[at: at + PAIRS][may].tolist(), strict=True)]
                    found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)[np.array(low, dtype=bool)])
            ones.clear()
            twos.clear()
            under.clear()
            waiting = 0

        for (key, bi, bj), (left, right) in cells.items():
            a, b = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
            i, j = (x.reshape(-1) for x in np.meshgrid(a, b, indexing="ij"))
            apart = component[i] != component[j]
            if bi == bj:
                apart &= i < j
            ones.append(i[apart])
            twos.append(j[apart])
            under.append(np.full(len(ones[-1]), key, dtype=np.int64))
            waiting += len(ones[-1])
            if waiting > PAIRS:
                flush()
        flush()
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return compare


def _whole_sets(n: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", HELD_BYTES):
            found = shingle_sets(batch.column(1), n)
            ends = np.cumsum([0, *map(len, found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "shingles"])

    return pack


def _side(df: DataFrame, name: str) -> DataFrame:
    return df.select(*(F.col(c).alias(name if c == "id" else f"{c}_{name}") for c in df.columns))


def jaccard_join(docs: DataFrame, percent: int = 90, n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose n-word shingle sets have Jaccard >= percent / 100.

    1. A sketch counts shingles over all documents and orders them from rare to frequent.
    2. Documents with equal sets become one set, known by its smallest id.
    3. Each set is indexed by single rare tokens and pairs of frequent ones.  Under each
       key every set meets the one with the most common tokens; counts of tokens by class
       rule most pairs out, full sets decide the rest, and links make components.
    4. Keys whose sets lie in several components are compared once more, all of them
       against all in blocks, leaving out pairs of one component.  So no link between
       components is lost, and copies of one text are not paired with each other.  A pair
       counts under the lowest key it shares (as far as the ``HEADS`` lowest keys of both
       tell), so rows grow with pairs, not with the keys and tables they meet in.

    Returns id, n_shingles and component_id, one row per input row.  A null or empty
    text has no shingles and links with nothing; a row without an id has no component
    and links nothing; rows that repeat an id with other texts count as one document
    when links are followed.  An empty table gives no rows.  Only the id (an integer)
    and text columns are read.
    """
    if not 60 <= percent <= 100:
        raise ValueError("prefixes with pairs of tokens cover similarities of 60 to 100 percent")
    levels, frequent = token_levels(docs, n, id_col, text_col)
    texts = _texts(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    made = texts.mapInArrow(_sets(n, percent, levels, frequent), "id long, one long, two long, size long, common int, prefix binary, shape binary")
    rows = written(made, "shingle-rows")
    sets = written(
        rows.filter((F.col("size") > 0) & F.col("id").isNotNull()).groupBy("one", "two")
        .agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("size", "common", "prefix", "shape"))), "shingle-sets",
    )
    entries = sets.select("id", "size", "prefix").mapInArrow(_entries(percent, frequent), "key long, id long")
    shared = entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    met = written(entries.join(shared, "key").select("key", "id", "members"), "shingle-entries")
    # The shapes of sets that meet another one.
    shapes = written(sets.select("id", "size", "common", "shape").join(met.select("id").distinct(), "id", "left_semi"), "shingle-shapes")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar; only texts of pairs left by then are read in full."""
        pairs = written(pairs, "shingle-pairs")
        ids = written(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), "shingle-ids")
        full = written(texts.join(ids, "id", "left_semi").mapInArrow(_whole_sets(n), "id long, shingles array<long>"), "shingle-full")
        both = pairs.join(_side(full, "a"), "a").join(_side(full, "b"), "b")
        shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
        whole = F.size("shingles_a") + F.size("shingles_b") - shared
        return both.filter(100 * shared >= percent * whole).select("a", "b").distinct()

    sized = met.join(shapes.select("id", "size", "common"), "id")
    lead = sized.groupBy("key").agg(F.max(F.struct("common", (-F.col("id")).alias("minus"), "size")).alias("lead"))
    near = F.least("size", "lead.size") * 100 >= F.greatest("size", "lead.size") * percent
    stars = sized.join(lead, "key").filter((F.col("id") != -F.col("lead.minus")) & near).select((-F.col("lead.minus")).alias("a"), F.col("id").alias("b")).distinct()
    maybe = (
        stars.join(_side(shapes.drop("common"), "a"), "a").join(_side(shapes.drop("common"), "b"), "b")
        .select("a", "b", "size_a", "shape_a", "size_b", "shape_b").mapInArrow(_prune(percent), "a long, b long")
    )
    first = written(linked(maybe), "shingle-links")
    label = components(first)
    # Two sets alone under a key have met already.
    placed = met.filter("members > 2").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    open_ = written(placed.join(split, "key"), "shingle-open")
    slots = max(1, open_.count() // SLOT_ROWS)
    heads = open_.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, HEADS).alias("heads"))
    cells = (
        open_.join(shapes.drop("common").join(heads, "id"), "id").withColumn("nb", F.ceil(F.col("members") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        # Small keys share a table; each pair of blocks of a large one has its own.
        .withColumn("slot", F.when(F.col("nb") > 1, F.xxhash64("key", "bi", "bj")).otherwise(F.pmod(F.xxhash64("key"), F.lit(slots))))
    )
    more = cells.select("slot", "key", "bi", "bj", "block", "id", "size", "component", "shape", "heads").groupBy("slot").applyInArrow(
        _blocks(percent), "a long, b long"
    ).distinct()
    links = written(first.unionAll(linked(more)), "shingle-links")
    final = components(links)
    of_set = sets.select("one", "two", F.col("id").alias("rep")).join(final.withColumnRenamed("id", "rep"), "rep", "left")
    of_set = of_set.select("one", "two", F.coalesce("component", "rep").alias("component"))
    alone = F.coalesce(F.when(F.col("size") > 0, F.col("component")), F.col("id"))
    return (
        rows.select("id", "one", "two", "size").join(of_set, ["one", "two"], "left")
        .select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), F.when(F.col("id").isNotNull(), alone).alias("component_id"))
    )

