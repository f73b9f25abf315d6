"""Feature checksums, the radix sort and the draw against plain versions, and edge rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.llm import importance
from wardline.llm.common import written
from wardline.llm.importance import feature_buckets, resample
from wardline.llm.radix_sort import radix_ranks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def features(text):
    found = words(text)
    return [*found, *(f"{a} {b}" for a, b in zip(found, found[1:]))]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz09 é日\n-_~\x00\x7f", max_size=30), st.sampled_from(["x" * 64, "y" * 65 + " z", "q " + "é" * 90])), max_size=8))
def test_checksums(texts):
    counts, single, pair = feature_buckets(pa.array(texts, pa.string()))
    kept = pair[importance._inner(counts)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert single.tolist() == [bucket(w) for t in texts for w in words(t)]
    assert kept.tolist() == [bucket(f) for t in texts for f in features(t)[len(words(t)):]]


def test_radix_order(spark):
    rng = random.Random(3)
    keys = [(rng.choice([0, 1, 5, 7000]), rng.choice([-(2**33), -7, 0, 3, 2**33 - 1, rng.randrange(-100, 100)])) for _ in range(5000)]
    rows = spark.createDataFrame(keys, "h long, l long").repartition(7).withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "rows")
    for bits in (8, 13):
        got = radix_ranks(rows, F.col("h"), F.col("l"), "row", bits).join(rows, "row").orderBy("place").collect()
        assert [r["place"] for r in got] == list(range(5000))
        order = [(r["h"], r["l"], r["row"]) for r in got]
        assert order == sorted(order)
    assert radix_ranks(rows.limit(0), F.col("h"), F.col("l"), "row").count() == 0
    same = radix_ranks(rows, F.lit(0).cast("long"), F.lit(4).cast("long"), "row").orderBy("row").collect()
    assert [r["place"] for r in same] == list(range(5000))


def drawn(docs, target, percent=25, least=20):
    source, wanted = np.zeros(10_000, dtype=int), np.zeros(10_000, dtype=int)
    for _, text in docs:
        for f in features(text):
            source[bucket(f)] += 1
    for text in target:
        for f in features(text):
            wanted[bucket(f)] += 1
    s_all, t_all = int(source.sum()), int(wanted.sum())
    gain = [math.floor(1000 * math.log((int(t) + 1) * (s_all + 10_000) / ((int(s) + 1) * (t_all + 10_000)))) for s, t in zip(source, wanted)]
    rows = []
    for i, text in docs:
        found = [gain[bucket(f)] for f in features(text)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = [(*r[:4], k + 1 if k < percent * len(able) // 100 else None) for k, r in enumerate(able)]
    return sorted([*ranks, *((*r[:4], None) for r in rows if r[4] < least)], key=str)


def test_draw_on_edge_rows(spark):
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "été", "日本", "x1", "y" * 70]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    docs += [(None, "alpha beta " * 15), (500, None), (501, ""), (502, "--- ..."), (7, docs[7][1]), (7, docs[7][1]), (-3, "alpha " * 40), (900, "alpha BETA, " * 60_000)]
    target = ["alpha beta alpha", None, "", "été"]
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, row int, score int").repartition(5)
    wanted = spark.createDataFrame([(t, "x") for t in target], "text string, row string")
    for percent in (25,):
        got = sorted((tuple(r) for r in resample(rows, wanted, percent=percent).collect()), key=str)
        assert got == drawn(docs, target, percent)
    # Without a target only the smoothing is left; without documents there are no rows.
    got = sorted((tuple(r) for r in resample(rows, wanted.limit(0)).collect()), key=str)
    assert got == drawn(docs, [])
    assert resample(rows.limit(0), wanted).count() == 0
