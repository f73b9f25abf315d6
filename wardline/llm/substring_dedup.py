"""Removal of word runs that documents with a smaller id hold, by recompression.

Rounds name runs of one symbol and pairs of symbols, starting from words.  A name
is a hash of what it stands for, so all executors agree on it without a dictionary,
and equal passages get equal symbols inside, whatever stands around them.  For each
symbol the round keeps the words that decide it; a window that holds them all finds
the same symbol wherever it occurs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import pieces, written
from wardline.llm.hashing import M1, M2, mix, windows, words_of

WINDOW = 13
ROUNDS = 2
# Words that a phrase takes from a symbol on, and so the starts a window can choose from.
PHRASE = 5
HELD_BYTES = 1 << 20
# Text bytes for which one bucket is planned.
BUCKET_BYTES = 4 << 20
_FAR = 1 << 40
_Q = 0x9E3779B97F4A7C15
_Q_INVERSE = pow(_Q, -1, 1 << 64)
_PARTS = re.compile(rb"\S+\s*").findall

Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _round(level: Level, owner: np.ndarray, number: int) -> tuple[Level, np.ndarray]:
    """The next level of (name, start, first word that matters, last plus one) and its owners."""
    name, start, low, high = level
    n = len(name)
    edge = np.concatenate([[True], owner[1:] != owner[:-1], [True]])
    # Runs of one symbol; what a run is also depends on both neighbours.
    first = np.flatnonzero(edge[:-1] | np.concatenate([[True], name[1:] != name[:-1]]))
    times = np.diff(np.append(first, n)).astype(np.uint64)
    last = np.append(first[1:], n) - 1
    opens, closes = edge[first], edge[last + 1]
    before, after = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    low = np.where(opens, -_FAR, np.minimum(low[first], low[before]))
    high = np.where(closes, _FAR, np.maximum(high[last], high[after]))
    run = name[first]
    name = np.where(times > 1, mix(run * M1 + times), run)
    start, owner = start[first], owner[first]
    # Pairs: a left symbol and a right one; a symbol's side is a bit of its name.
    right = (mix(name + np.uint64(number * 2 + 1)) & np.uint64(1)).astype(bool)
    head = ~right[:-1] & right[1:] & (owner[:-1] == owner[1:])
    heads = np.append(head, False)
    tails = np.concatenate([[False], head])
    # A symbol left alone depends on the neighbour it could have joined.
    alone_low = np.where(right & ~tails, np.where(opens, -_FAR, np.minimum(low, np.roll(low, 1))), low)
    alone_high = np.where(~right & ~heads, np.where(closes, _FAR, np.maximum(high, np.roll(high, -1))), high)
    following = np.roll(name, -1)
    name = np.where(heads, mix(mix(name) * M2 + following), name)
    high = np.where(heads, np.roll(high, -1), alone_high)
    kept = ~tails
    return (name[kept], start[kept], alone_low[kept], high[kept]), owner[kept]


def anchors(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each window start, the start of the symbol the window is known by.

    Among the symbols that the window decides alone and that start in its first words,
    the highest level wins, then the largest name, then the first.  Equal windows
    choose at the same place.
    """
    n = len(hashes)
    count = n - WINDOW + 1
    best = np.zeros(count, dtype=np.uint64)
    place = np.arange(count)
    places = np.arange(count)
    at = np.arange(n)
    level, owners = (mix(hashes), at, at, at + 1), owner
    for number in range(ROUNDS + 1):
        if number:
            level, owners = _round(level, owners, number)
        name, start, low, high = level
        value = np.zeros(n, dtype=np.uint64)
        left, right = np.full(n, 255, dtype=np.uint8), np.full(n, 255, dtype=np.uint8)
        value[start] = (np.uint64(number + 1) << np.uint64(60)) | (mix(name) >> np.uint64(4))
        left[start], right[start] = np.minimum(start - low, 255), np.minimum(high - start, 255)
        # Most symbols of high levels depend on more words than a window has.
        for shift in range(WINDOW - PHRASE + 1):
            fits = (left[shift: shift + count] <= shift) & (right[shift: shift + count] <= WINDOW - shift)
            fits &= value[shift: shift + count] > best
            hit = np.flatnonzero(fits)
            best[hit] = value[hit + shift]
            place[hit] = places[hit] + shift
    return place


def segments(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of window starts known by one symbol: (key, content, text, first start, windows).

    ``key`` names the phrase at the symbol, ``content`` all words of the run's windows.
    Starts are counted from the text's first word.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(hashes) < WINDOW or (counts < WINDOW).all():
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), none, none, none
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    with np.errstate(over="ignore"):
        place = anchors(hashes, owner)
        count = len(place)
        inside = owner[:count] == owner[WINDOW - 1:]
        change = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:count] != owner[: count - 1])])
        first = np.flatnonzero(change & inside)
        text = owner[first]
        follow = np.append(np.flatnonzero(change), count)
        stop = np.minimum(follow[np.searchsorted(follow, first, "right")], ends[text] - WINDOW + 1)
        key = windows(hashes, PHRASE)[place[first]]
        powers = np.cumprod(np.full(len(hashes), _Q, dtype=np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + M1) * powers)])
        back = np.cumprod(np.full(len(hashes), _Q_INVERSE, dtype=np.uint64))
        content = (sums[stop + WINDOW - 1] - sums[first]) * back[first]
        content = mix(content + (stop - first).astype(np.uint64) * M1 + (place[first] - first).astype(np.uint64) * M2)
    return key, content, text, first - (ends - counts)[text], stop - first


def _pack(columns: list[np.ndarray], press) -> bytes:
    return press.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unpack(blobs: list[bytes], dtypes: list) -> list[np.ndarray]:
    import zstandard

    open_, width = zstandard.ZstdDecompressor(), sum(np.dtype(d).itemsize for d in dtypes)
    parts: list[list[np.ndarray]] = [[np.zeros(0, d)] for d in dtypes]
    for blob in blobs:
        raw = open_.decompress(blob)
        n, at = len(raw) // width, 0
        for part, d in zip(parts, dtypes, strict=True):
            part.append(np.frombuffer(raw, d, n, at))
            at += n * np.dtype(d).itemsize
    return [np.concatenate(p) for p in parts]


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray], press) -> tuple[list[int], list[bytes]]:
    """The columns' rows, packed into one blob for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], cuts]) if len(bucket) else np.zeros(0, np.int64)
    stops = np.append(cuts, len(bucket))
    return (
        [int(bucket[a]) for a in starts],
        [_pack([c[a:b] for c in columns], press) for a, b in zip(starts.tolist(), stops.tolist(), strict=False)],
    )


def _lowest(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows ordered by keys and id, the group of each, and the lowest id of its group."""
    order = np.lexsort([ids, *keys[::-1]])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        ranked = key[order]
        new[1:] |= ranked[1:] != ranked[:-1]
    group = np.cumsum(new) - 1
    return order, group, ids[order][new][group] if len(order) else ids


# A segment's rows as they travel: key, 48 bits of content, id, hash of the text where
# several texts share the id (else 0), first start, windows, and whether a smaller id is
# known to hold all of it.
_SEGMENT = [np.uint64, np.uint32, np.uint16, np.int64, np.int64, np.int32, np.uint8, np.uint8]
# What comes back to a document: id, hash of the text, first start, windows, open.
_FOUND = [np.int64, np.int64, np.int32, np.uint8, np.uint8]
_WINDOW = [np.uint64, np.uint64, np.int64, np.int64, np.int32]


def _batch(found: tuple[list[int], list[bytes]]) -> dict:
    return {"bucket": pa.array(found[0], pa.int64()), "rows": pa.array(found[1], pa.binary())}


def _emit(buckets: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, "text", HELD_BYTES):
            words = words_of(batch.column(2))
            key, content, text, first, many = segments(words.hashes, words.counts)
            content >>= np.uint64(16)
            ids = batch.column(0).to_numpy()[text]
            hashes = batch.column(1).to_numpy()[text]
            # Of the texts of one piece only those with the lowest id speak for a content.
            order, _, lowest = _lowest([key, content], ids)
            known = np.zeros(len(ids), dtype=np.uint8)
            known[order] = ids[order] > lowest
            del words, order, lowest
            # Settled rows don't meet others of their phrase, so they are dealt by document.
            bucket = np.where(known == 1, ids % buckets, (key % np.uint64(buckets)).astype(np.int64))
            rows = [key, content.astype(np.uint32), (content >> np.uint64(32)).astype(np.uint16), ids, hashes, first.astype(np.int32), many.astype(np.uint8), known]
            yield pa.RecordBatch.from_pydict(_batch(_by_bucket(bucket, rows, press)))

    return emit


def _compare(buckets: int):
    def compare(table: pa.Table) -> pa.Table:
        import zstandard

        key, low, high, ids, hashes, first, many, known = _unpack(table.column("rows").to_pylist(), _SEGMENT)
        content = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        speak = np.flatnonzero(known == 0)
        order, group, lowest = _lowest([key[speak], content[speak]], ids[speak])
        order = speak[order]
        resolved = ids[order] > lowest
        # Contents of one phrase with different lowest ids: their windows are compared.
        lead = order[~resolved]
        ranked = key[lead]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])[: len(lead)]
        phrase = np.cumsum(new) - 1
        low, high = (f.reduceat(ids[lead], np.flatnonzero(new)) if len(lead) else ids[lead] for f in (np.minimum, np.maximum))
        unsure = lead[(low < high)[phrase]] if len(lead) else lead
        back = np.concatenate([np.flatnonzero(known), order[resolved], unsure])
        state = np.zeros(len(back), dtype=np.uint8)
        state[len(back) - len(unsure):] = 1
        rows = [ids[back], hashes[back], first[back], many[back], state]
        return pa.table(_batch(_by_bucket(ids[back] % buckets, rows, zstandard.ZstdCompressor(level=1))))

    return compare


def _open_windows(buckets: int):
    def emit(docs: pa.Table, found: pa.Table) -> pa.Table:
        import zstandard

        ids, hashes, first, many, state = _unpack(found.column("rows").to_pylist(), _FOUND)
        wanted = np.flatnonzero(state)
        places: dict[tuple[int, int], list[int]] = {}
        for i in wanted.tolist():
            places.setdefault((int(ids[i]), int(hashes[i])), []).append(i)
        out: list[list[np.ndarray]] = [[np.zeros(0, d)] for d in _WINDOW]
        done = set()
        for doc, text_hash, text in zip(*(docs.column(c).to_pylist() for c in ("id", "hash", "text")), strict=True):
            if (doc, text_hash) not in places or (doc, text_hash) in done:
                continue
            done.add((doc, text_hash))
            some = np.array(places[doc, text_hash])
            counts = many[some].astype(np.int64)
            starts = np.repeat(first[some] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
            words = words_of(pa.array([text])).hashes
            for part, column in zip(out, (
                windows(words, WINDOW, 1)[starts], windows(words, WINDOW, 2)[starts], np.full(len(starts), doc), np.full(len(starts), text_hash, np.int64), starts.astype(np.int32),
            ), strict=True):
                part.append(column)
        rows = [np.concatenate(p) for p in out]
        return pa.table(_batch(_by_bucket((rows[0] % np.uint64(buckets)).astype(np.int64), rows, zstandard.ZstdCompressor(level=1))))

    return emit


def _compare_windows(buckets: int):
    def compare(table: pa.Table) -> pa.Table:
        import zstandard

        one, two, ids, hashes, start = _unpack(table.column("rows").to_pylist(), _WINDOW)
        order, _, lowest = _lowest([one, two], ids)
        hit = order[ids[order] > lowest]
        rows = [ids[hit], hashes[hit], start[hit], np.ones(len(hit), np.uint8), np.zeros(len(hit), np.uint8)]
        return pa.table(_batch(_by_bucket(ids[hit] % buckets, rows, zstandard.ZstdCompressor(level=1))))

    return compare


def covered(n_words: int, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which words lie in a window of the given runs of starts."""
    change = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + many + WINDOW - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _remove(spacing: bool, carried: list[str]):
    def remove(docs: pa.Table, found: pa.Table) -> pa.Table:
        ids, hashes, first, many, state = _unpack(found.column("rows").to_pylist(), _FOUND)
        sure = state == 0
        order = np.lexsort([hashes[sure], ids[sure]])
        ids, hashes, first, many = (x.astype(np.int64)[sure][order] for x in (ids, hashes, first, many))
        totals, removed, texts = [], [], []
        keys, text_hashes = docs.column("id").to_pylist(), docs.column("hash").to_pylist()
        for doc, text_hash, text in zip(keys, text_hashes, docs.column("text").cast(pa.binary()).to_pylist(), strict=True):
            words = text.split()
            totals.append(len(words))
            a, b = (np.searchsorted(ids, doc, side) for side in ("left", "right")) if doc is not None else (0, 0)
            a, b = a + np.searchsorted(hashes[a:b], text_hash, "left"), a + np.searchsorted(hashes[a:b], text_hash, "right")
            if a == b:
                removed.append(0)
                texts.append(text if spacing else b" ".join(words))
                continue
            gone = covered(len(words), first[a:b], many[a:b])
            removed.append(int(gone.sum()))
            kept = np.flatnonzero(~gone).tolist()
            if spacing:
                parts = _PARTS(text)
                texts.append(b"".join(parts[i] for i in kept))
            else:
                texts.append(b" ".join([words[i] for i in kept]))
        return pa.table({
            "id": docs.column("id"), "n_words": pa.array(totals, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "text": pa.array(texts, pa.binary()).cast(pa.string()), **{c: docs.column(c) for c in carried},
        })

    return remove


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n ** 0.5) + 1)):
        n += 1
    return n


def remove_repeats(
    docs: DataFrame, spacing: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
) -> DataFrame:
    """Every text without the words of any 13-word window that starts in a document of smaller id.

    1. Each window is known by its highest recompression symbol.  A run of windows with
       one symbol travels as a segment: the name of the phrase at the symbol, the name of
       all its words, id and place.  Equal passages share segments.
    2. Segments meet by phrase.  One that a smaller id holds too is settled as a whole;
       where a phrase has several contents (a repeat begins or ends there), the lowest
       id of each content stays open.
    3. Open segments meet once more window by window, under 128-bit names.
    4. Documents meet what was found in them by id, and the covered words go.

    A piece of text sends each content to its phrase once, so a passage that a third of all
    documents hold reaches a bucket once per piece; its other holders in the piece are
    settled there and go to their documents' buckets.  Buckets follow the size of the text.

    Returns id, n_words, n_removed, text for every row, and the columns named in
    ``carry`` as they were: the kept words joined by one space, or with ``spacing`` the
    white space that followed them.  Windows are judged
    on the input.  A null text is an empty one; texts under 13 words lose nothing; a row
    without an id loses nothing and takes nothing from others; rows that repeat an id
    are documents of that id each.  An empty table gives no rows.  Only the columns
    named are read; the id is an integer.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.octet_length(text).alias("size"))
    total = keys.agg(F.sum("size")).first()[0] or 0
    # Ids of several texts, written so that their number decides how they meet the texts.
    shared = keys.groupBy("id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).filter(F.col("low") < F.col("high"))
    shared = written(shared.select("id", F.lit(True).alias("shared")), "shared")

    def told_apart(*more: Column) -> DataFrame:
        named = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *more)
        own = F.when(F.col("shared"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("hash")
        return named.join(shared, "id", "left").select("id", own, *[c for c in named.columns if c != "id"])

    rows = told_apart()
    buckets = _prime(2 + total // BUCKET_BYTES)
    packed = "bucket long, rows binary"
    found = written(
        rows.filter(F.col("id").isNotNull()).mapInArrow(_emit(buckets), packed).groupBy("bucket").applyInArrow(_compare(buckets), packed),
        "segments",
    )
    # The same columns for both uses, so that one shuffle of the texts serves them.
    carried = [f"_{i}" for i in range(len(carry))]
    placed = told_apart(*(F.col(c).alias(n) for c, n in zip(carry, carried, strict=True))).withColumn("bucket", F.coalesce(F.pmod("id", F.lit(buckets)), F.lit(0).cast("long")))
    schema = "".join(f", {f.name} {f.dataType.simpleString()}" for f in placed.schema if f.name in carried)
    some = placed.groupBy("bucket")
    more = some.cogroup(found.groupBy("bucket")).applyInArrow(_open_windows(buckets), packed).groupBy("bucket").applyInArrow(_compare_windows(buckets), packed)
    out = some.cogroup(found.unionAll(more).groupBy("bucket")).applyInArrow(
        _remove(spacing, carried), f"id long, n_words long, n_removed long, text string{schema}"
    )
    return out.select(F.col("id").alias(id_col), "n_words", "n_removed", "text", *(F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)))
