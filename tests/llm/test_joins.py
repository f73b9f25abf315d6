"""Jaccard join, components and substring removal against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from wardline.llm import jaccard_join as jj
from wardline.llm import substring_dedup as sd
from wardline.llm.components import components
from wardline.llm.hashing import words_of


def smallest(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_words():
    texts = ["", None, "a b", "a b a\x1cb", "  B\tlonger-than-eight b\n" + "x" * 3000, "a"]
    words = words_of(pa.array(texts), lower=True)
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert words.counts.tolist() == [len(s) for s in split]
    flat = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for s in split for w in s]
    by = {}
    for w, h in zip(flat, words.hashes.tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    assert words_of(pa.array(texts)[2:5]).counts.tolist() == [2, 2, 4]
    assert words_of(pa.array([], pa.string())).counts.tolist() == []


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df).collect()}
    want = smallest({x for p in links for x in p}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(df.limit(0)).count() == 0


def shingles(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def brute_join(rows, percent=90):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b) for x, a in enumerate(ids) for b in ids[x + 1:]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    root = smallest(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def copies(seed, docs, vocabulary, length, edits):
    """Documents of which many are copies, near copies of each other or share a passage."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    bases = [[rng.choice(words) for _ in range(rng.randrange(1, length))] for _ in range(docs // 6)]
    rows = []
    for i in range(docs):
        base = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, *edits])):
            at = rng.randrange(len(base))
            base[at: at + 1] = rng.choice([[], [rng.choice(words)], [f"own{i}"], [base[at], "the"]])
            base = base or ["x"]
        rows.append((i * 7 % 1009, " ".join(w.upper() if rng.random() < 0.05 else w for w in base)))
    return rows


@pytest.mark.parametrize(("seed", "docs", "vocabulary", "length", "edits", "frequent", "block"), [
    (1, 200, 3000, 60, (1, 2), None, 512), (2, 150, 12, 400, (1, 3, 9), 1, 512), (3, 150, 4000, 700, (2, 5, 12, 20), 1, 4),
    (4, 150, 400, 260, (1, 4, 7), 8, 3),
])
def test_join_against_brute_force(spark, monkeypatch, seed, docs, vocabulary, length, edits, frequent, block):
    rows = copies(seed, docs, vocabulary, length, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    levels = jj.token_levels
    if frequent is not None:
        monkeypatch.setattr(jj, "token_levels", lambda *a: (levels(*a)[0], frequent))
    monkeypatch.setattr(jj, "BLOCK", block)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jj.jaccard_join(df).collect()}
    assert got == brute_join(rows)


def test_join_edges(spark):
    rows = [(5, None, 1), (4, "", 2), (3, "A b", 3), (9, "a B", 4), (7, "a b c", 5), (7, "a b c", 5), (8, "x " * 50_000, 6), (6, "X x x", 7), (None, "a b", 8), (2, " \n", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, one int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jj.jaccard_join(df).collect()), key=str)
    assert got == sorted([
        (5, 0, 5), (4, 0, 4), (3, 1, 3), (9, 1, 3), (7, 1, 7), (7, 1, 7), (8, 1, 6), (6, 1, 6), (None, 1, None), (2, 0, 2),
    ], key=str)
    assert jj.jaccard_join(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        jj.jaccard_join(df, percent=50)


def test_prefixes_share_a_key():
    """Two sets at the threshold always share a key, whatever tokens are frequent."""
    rng = np.random.default_rng(1)
    for _ in range(300):
        size = int(rng.integers(1, 400))
        pool = np.unique(rng.integers(0, 1 << 56, 2 * size + 4).astype(np.uint64) | (rng.integers(0, 3, 2 * size + 4).astype(np.uint64) << np.uint64(56)))
        rng.shuffle(pool)
        one = pool[:size]
        drop = int(rng.integers(0, size // 9 + 1))
        two = np.concatenate([one[drop:], pool[size: size + int(rng.integers(0, drop + 1))]])
        both = len(np.intersect1d(one, two))
        if not len(two) or 100 * both < 90 * (len(one) + len(two) - both):
            continue
        (_, k), (_, m) = (jj.prefix_and_keys(np.sort(x), len(x), 1, 90) for x in (one, two))
        assert len(np.intersect1d(k, m))
        shapes = [np.bincount((x % np.uint64(128)).astype(int), minlength=128).astype(np.uint8)[None] for x in (one, two)]
        assert jj.surviving(shapes[0], np.array([len(one)]), shapes[1], np.array([len(two)]), 90)[0]


def brute_repeats(rows):
    """(words, removed, kept words) of each row."""
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    low = {}
    for i, words in split:
        for k in range(len(words) - 12):
            if i is not None:
                w = tuple(words[k: k + 13])
                low[w] = min(low.get(w, i), i)
    out = []
    for i, words in split:
        gone = {
            p for k in range(len(words) - 12) if i is not None and low[tuple(words[k: k + 13])] < i for p in range(k, k + 13)
        }
        out.append((i, len(words), len(gone), " ".join(w for p, w in enumerate(words) if p not in gone)))
    return sorted(out, key=str)


def passages(seed, docs, vocabulary, longest):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    shared = [[rng.choice(words) for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    rows = []
    for i in range(docs):
        text = []
        while len(text) < rng.randrange(longest):
            text += rng.choice([[rng.choice(words) for _ in range(rng.randrange(30))], rng.choice(shared), [rng.choice(words)] * rng.randrange(40)])
        rows.append(((i * 37) % 211 - 20, rng.choice([" ", "\n", "  "]).join(text)))
    return rows


@pytest.mark.parametrize(("seed", "docs", "vocabulary", "longest", "piece", "bucket"), [
    (1, 60, 5000, 400, 4 << 20, 4 << 20), (2, 60, 3, 200, 300, 500), (3, 150, 40, 150, 2000, 2000), (4, 80, 1000, 300, 1000, 1 << 20),
])
def test_repeats_against_brute_force(spark, monkeypatch, seed, docs, vocabulary, longest, piece, bucket):
    monkeypatch.setattr(sd, "BUCKET_BYTES", bucket)
    rows = passages(seed, docs, vocabulary, longest)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in sd.remove_repeats(df).collect()), key=str)
    want = brute_repeats(rows)
    assert got == want
    assert sum(w[2] for w in want) > 0


def test_repeats_edges(spark):
    line = " ".join(f"a{i}" for i in range(20))
    rows = [(1, f"x {line}", 1), (1, f"x {line}", 2), (2, f"y\n{line}\tz", 3), (2, f"other {line}", 3), (3, None, 4), (4, "", 5), (None, line, 6), (5, "same " * 30_000, 7), (6, "same " * 14, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, bucket int")
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in sd.remove_repeats(df).collect()), key=str)
    assert got == brute_repeats([r[:2] for r in rows])
    kept = {r["text"] for r in sd.remove_repeats(df, spacing=True).filter("doc_id = 2").collect()}
    assert kept == {"y\nz", "other "}
    assert sd.remove_repeats(df.limit(0)).count() == 0


def test_equal_windows_choose_alike():
    """A window is known by the same symbol wherever it occurs."""
    rng = np.random.default_rng(3)
    for vocabulary in (2, 5, 1000):
        core = rng.integers(0, vocabulary, 13)
        places = set()
        for _ in range(200):
            words = np.concatenate([rng.integers(0, vocabulary, rng.integers(0, 30)), core, rng.integers(0, vocabulary, rng.integers(0, 30))])
            hashes = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            owner = np.zeros(len(words), np.int64)
            place = sd.anchors(hashes, owner)
            for at in range(len(words) - 12):
                if (words[at: at + 13] == core).all():
                    places.add(int(place[at]) - at)
        assert len(places) == 1


def test_texts_of_one_id_are_told_apart(spark):
    """Texts that share an id are documents each, whatever their hashes' low bits say."""
    passage = " ".join(f"w{i}" for i in range(40))
    seen, pair = {}, None
    texts = [f"{passage} end {i}" if i % 2 else f"short {i}" for i in range(3000)]
    for row in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) & 65535 AS h").collect():
        other = seen.setdefault(row["h"], row["t"])
        if (other.startswith("short")) != (row["t"].startswith("short")):
            pair = (other, row["t"])
            break
    assert pair
    docs = spark.createDataFrame([(1, passage), (2, pair[0]), (2, pair[1]), (3, f"x {passage} y")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in sd.remove_repeats(docs).collect())
    long, short = sorted(pair, key=len, reverse=True)
    assert got == sorted([(1, 40, 0, passage), (2, 42, 40, " ".join(long.split()[40:])), (2, 2, 0, short), (3, 42, 40, "x y")])


def test_a_pair_meets_under_its_lowest_shared_key():
    from wardline.llm.jaccard_join import CLASSES, _blocks

    shape = bytes([1] * CLASSES)
    heads = {7: [-4, 1, 2, 3, 9], 8: [-5, 1, 2, 3, 9], 9: [3, 9]}
    found = []
    # Every key in a table of its own.
    for key in (1, 2, 3, 9):
        ids = [i for i in heads if key in heads[i]]
        rows = {"slot": key, "key": key, "bi": 0, "bj": 0, "block": 0, "size": CLASSES, "shape": shape}
        table = pa.Table.from_pylist([rows | {"id": i, "component": i, "heads": heads[i]} for i in ids])
        found += _blocks(80)(table).to_pylist()
    assert sorted((x["a"], x["b"]) for x in found) == [(7, 8), (7, 9), (8, 9)]
