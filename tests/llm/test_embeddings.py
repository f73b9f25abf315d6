"""Near vectors against brute force: recall, precision, counts, edge rows."""

import numpy as np
import pytest

from tests.llm.test_joins import smallest
from wardline.llm import embedding_dedup as ed


def brute(rows, threshold=0.95):
    ids = [i for i, _ in rows]
    unit = []
    for _, v in rows:
        x = np.array(v if v and None not in v else [0.0], dtype=np.float64)
        unit.append(x / np.sqrt(x @ x) if np.isfinite(x).all() and x.any() else None)
    links = [
        (a, b) for a in range(len(rows)) for b in range(a + 1, len(rows))
        if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold
    ]
    by = sorted(range(len(rows)), key=lambda k: ids[k])
    place = {k: p for p, k in enumerate(by)}
    root = smallest(range(len(rows)), [(place[a], place[b]) for a, b in links])
    n = np.bincount([x for p in links for x in p], minlength=len(rows)) if links else np.zeros(len(rows), int)
    return {ids[k]: (int(n[k]), ids[by[root[place[k]]]]) for k in range(len(rows))}


def clusters(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=dim)
        base /= np.linalg.norm(base)
        for _ in range(int(rng.choice([1, 1, 1, 2, 5, 60]))):
            rows.append(base + rng.normal(size=dim) * rng.choice([0, 0.01, 0.02, 0.028]))
    order = rng.permutation(len(rows))
    return [(int(i), [float(np.float32(x)) for x in rows[k]]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("seed", "task", "leaf", "block"), [(1, 4096, 256, 2048), (2, 100, 16, 2048), (3, 200, 20, 50)])
def test_against_brute_force(spark, monkeypatch, seed, task, leaf, block):
    for name, value in (("TASK_VECTORS", task), ("LEAF_VECTORS", leaf), ("BLOCK", block), ("LEAF_BLOCK", block)):
        monkeypatch.setattr(ed, name, value)
    rows = clusters(seed, 900)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in ed.near_vectors(df).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    # No link below the threshold; nearly all above it.
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[i] == want[i] for i in want]) > 0.97


def test_recall_on_given_vectors(spark):
    """The given vectors, and noisy copies of some, since this size holds no near pair."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r[0], r[1]) for r in given.select("vec_id", "embedding").collect()]
    rng = np.random.default_rng(4)
    rows += [
        (10_000 + i, [float(np.float32(x + e)) for x, e in zip(v, rng.normal(size=len(v)) * 0.025, strict=True)]) for i, v in rows[:300] + rows[:100] * 4
    ]
    rows = list({i: (i, v) for i, v in rows}.values())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    out = ed.near_vectors(df).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out}
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    assert sum(n for n, _ in want.values()) > 0
    assert sum(n for n, _ in got.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (9, [1.0, 0.0]), (3, [2.0, 0.0]), (3, [2.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (10, [None, 1.0]),
        (None, [1.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [1e300, 1e280]), (13, [-0.0, 5.0]), (14, [0.0, 5.0]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, blob string")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in ed.near_vectors(df).collect()), key=str)
    want = [
        (9, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (12, 3, 3, False), (13, 1, 13, True), (14, 1, 13, False), (None, 0, None, False),
        *((i, 0, i, True) for i in (4, 5, 6, 7, 8, 10, 11)),
    ]
    assert got == sorted(want, key=str)
    assert ed.near_vectors(df.limit(0)).count() == 0
