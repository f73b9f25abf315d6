"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.common import written
from wardline.llm.components import components

TREES = 6
# Vectors that a tree's leaf should hold when it reaches a task, and when they are compared.
TASK_VECTORS, LEAF_VECTORS = 4096, 256
# The sample that thresholds come from: vectors for each leaf, and bytes in all.
LEAF_SAMPLE, SAMPLE_BYTES = 64, 64 << 20
# Vectors of one table: more of a leaf, which splits further, or of a component, which
# is compared as a whole, go block by block.
LEAF_BLOCK, BLOCK = 16_384, 2048
SLOT_ROWS = 20_000
SEED = 20


def _pack(dtype: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for vector in batch.column(1).to_pylist():
                blob = None
                if vector and None not in vector:
                    x = np.array(vector, dtype=dtype)
                    if np.isfinite(x).all() and x.any():
                        blob = (x + np.zeros(1, dtype)).tobytes()  # -0 and 0 are one value
                blobs.append(blob)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["id", "blob"])

    return pack


def unit(blobs: list[bytes], dtype: str) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that no length overflows."""
    x = np.frombuffer(b"".join(blobs), dtype=dtype).astype(np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spill(threshold: float, dim: int) -> float:
    """Half the width of the strip that goes to both sides of a split.

    Two vectors at the threshold differ by this much twice along a random direction,
    in the quadratic mean.
    """
    return math.sqrt(max(0.0, 2 - 2 * threshold)) / (2 * math.sqrt(dim))


def direction(tree: int, node: int, dim: int) -> np.ndarray:
    """The random unit vector that a node of a tree splits by."""
    x = np.random.default_rng([SEED, tree, node, dim]).normal(size=dim)
    return x / np.sqrt((x * x).sum())


def _sides(x: np.ndarray, where: np.ndarray, way: np.ndarray, middle: float, margin: float):
    along = x[where] @ way
    return where[along <= middle + margin], where[along >= middle - margin]


def grow(sample: np.ndarray, tree: int, depth: int, margin: float) -> dict[int, float]:
    """Thresholds of a tree's inner nodes (root 1, children 2n and 2n + 1), medians of the sample.

    A node whose vectors nearly all lie in the strip is a leaf.
    """
    middles: dict[int, float] = {}
    todo = [(1, np.arange(len(sample)), 0)]
    while todo:
        node, where, level = todo.pop()
        if level == depth or len(where) < 4:
            continue
        way = direction(tree, node, sample.shape[1])
        middle = float(np.median(sample[where] @ way))
        left, right = _sides(sample, where, way, middle, margin)
        if max(len(left), len(right)) > 0.8 * len(where):
            continue
        middles[node] = middle
        todo += [(2 * node, left, level + 1), (2 * node + 1, right, level + 1)]
    return middles


def _route(forest: list[dict[int, float]], dtype: str, margin: float):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(1).to_pylist(), dtype)
            for tree, middles in enumerate(forest):
                todo, rows, leaves = [(1, np.arange(len(x)))], [], []
                while todo:
                    node, where = todo.pop()
                    if node in middles and len(where):
                        left, right = _sides(x, where, direction(tree, node, x.shape[1]), middles[node], margin)
                        todo += [(2 * node, left), (2 * node + 1, right)]
                    else:
                        rows.append(where)
                        leaves.append(np.full(len(where), node))
                at = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), tree), pa.int32()), pa.array(np.concatenate(leaves), pa.int64()), batch.column(0).take(at), batch.column(1).take(at),
                ], ["tree", "leaf", "node", "blob"])

    return route


class _Forest:
    """Disjoint sets that remember the links which joined them."""

    def __init__(self, n: int):
        self.root, self.links = list(range(n)), []

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.links.append((i, j))


def _link_all(x: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, sets: _Forest) -> None:
    """Joins every pair between two lists that reaches the threshold."""
    close = x[left] @ x[right].T >= threshold
    for i in np.flatnonzero(close.sum(axis=1) > 0).tolist():
        for j in np.flatnonzero(close[i]).tolist():
            if left[i] != right[j]:
                sets.join(int(left[i]), int(right[j]))


def _link_dense(x: np.ndarray, where: np.ndarray, threshold: float, sets: _Forest) -> None:
    """Links vectors that no direction parts: pivots first, then between what they left apart."""
    free = np.ones(len(where), dtype=bool)
    while free.any():
        pivot = int(np.flatnonzero(free)[0])
        close = x[where] @ x[where[pivot]] >= threshold
        for j in np.flatnonzero(close).tolist():
            sets.join(int(where[pivot]), int(where[j]))
        free &= ~close
        free[pivot] = False
    roots = np.array([sets.find(int(i)) for i in where])
    groups = sorted((where[roots == r] for r in np.unique(roots)), key=len)
    for k, group in enumerate(groups[:-1]):
        rest = np.concatenate(groups[k + 1:])
        for at in range(0, len(group), LEAF_VECTORS):
            for to in range(0, len(rest), 4 * LEAF_VECTORS):
                _link_all(x, group[at: at + LEAF_VECTORS], rest[to: to + 4 * LEAF_VECTORS], threshold, sets)


def leaf_links(x: np.ndarray, threshold: float, tree: int, node: int) -> list[tuple[int, int]]:
    """Links that join the near pairs which a leaf's own splits leave together; no link is redundant."""
    sets, margin = _Forest(len(x)), spill(threshold, x.shape[1])
    todo = [(node, np.arange(len(x)))]
    while todo:
        node, where = todo.pop()
        if len(where) <= LEAF_VECTORS:
            _link_all(x, where, where, threshold, sets)
            continue
        way = direction(tree, node, x.shape[1])
        left, right = _sides(x, where, way, float(np.median(x[where] @ way)), margin)
        if max(len(left), len(right)) > 0.8 * len(where):
            _link_dense(x, where, threshold, sets)
        else:
            todo += [((2 * node) % (1 << 62), left), ((2 * node + 1) % (1 << 62), right)]
    return sets.links


def _cells(table: pa.Table, keys: list[str]) -> Iterator[tuple[tuple, list[int], list[int]]]:
    """Rows of the two blocks of each cell that a table holds."""
    rows = table.select([*keys, "block", "bi", "bj"]).to_pydict()
    cells: dict[tuple, tuple[list[int], list[int]]] = {}
    for i, cell in enumerate(zip(*(rows[k] for k in keys), rows["bi"], rows["bj"], strict=True)):
        left, right = cells.setdefault(cell, ([], []))
        if rows["block"][i] == rows["bi"][i]:
            left.append(i)
        if rows["block"][i] == rows["bj"][i]:
            right.append(i)
    for cell, (left, right) in cells.items():
        yield cell, left, right


def _leaf_task(dtype: str, threshold: float):
    def task(table: pa.Table) -> pa.Table:
        ids, blobs = table.column("node").to_pylist(), table.column("blob").to_pylist()
        found = set()
        for (tree, leaf, bi, bj), left, right in _cells(table, ["tree", "leaf"]):
            members = left if bi == bj else [*left, *right]
            x = unit([blobs[i] for i in members], dtype)
            for i, j in leaf_links(x, threshold, tree, leaf):
                found.add((ids[members[i]], ids[members[j]]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return task


def _count_task(dtype: str, threshold: float):
    def task(table: pa.Table) -> pa.Table:
        ids, blobs = np.array(table.column("node").to_pylist()), table.column("blob").to_pylist()
        weight = np.array(table.column("weight").to_pylist())
        nodes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for (_, bi, bj), left, right in _cells(table, ["component"]):
            if not left or not right:
                continue
            close = unit([blobs[i] for i in left], dtype) @ unit([blobs[i] for i in right], dtype).T >= threshold
            if bi == bj:
                np.fill_diagonal(close, False)
            else:
                nodes.append(ids[right])
                counts.append(weight[left] @ close)
            nodes.append(ids[left])
            counts.append(close @ weight[right])
        return pa.table({"node": pa.array(np.concatenate(nodes)), "links": pa.array(np.concatenate(counts).astype(np.int64))})

    return task


def _in_cells(df: DataFrame, keys: list[str], most: int, node: str = "node") -> DataFrame:
    """Rows with block, bi, bj and slot: groups of up to ``most`` rows are one cell, larger ones a cell for each two blocks.

    Small cells share tables of about SLOT_ROWS rows.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("members"))
    rows = written(df.join(sizes, keys), "cells")
    slots = max(1, rows.count() // SLOT_ROWS)
    return (
        rows.withColumn("nb", F.ceil(F.col("members") / most).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64(node), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
        .withColumn("slot", F.when(F.col("members") > 512, F.xxhash64(*keys, "bi", "bj")).otherwise(F.pmod(F.xxhash64(*keys), F.lit(slots))))
    )


def near_vectors(vectors: DataFrame, threshold: float = 0.95, trees: int = TREES, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors linked where a forest brings them together at cosine >= threshold.

    Equal vectors are one vector with a weight.  Each tree splits at random directions,
    at medians of a bounded sample; vectors near a split go to both sides.  Every vector
    is routed through every tree, a leaf is split further by its own medians, and the
    vectors of a last leaf are compared in double precision.  Only links that join
    something leave a leaf.  Leaves and components too large for one table are compared
    block by block, so no bin is capped.  Links are then counted inside components, all
    members against all in blocks, and no pair is ever written.

    Returns id, n_links, component_id, kept for every row.  A vector that is null, empty
    or zero, or holds a null or a non-finite component, links with nothing, as does a
    row without an id (its component is null); vectors of different lengths never link.
    Repeated rows link with each other.  An empty table gives no rows.  Only the id (an
    integer) and vector columns are read.
    """
    element = vectors.schema[vector_col].dataType.elementType
    dtype, kind = ("<f4", "float") if isinstance(element, T.FloatType) else ("<f8", "double")
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    rows = written(source.mapInArrow(_pack(dtype), "id long, blob binary"), "vectors")
    classes = written(
        rows.filter(F.col("id").isNotNull() & F.col("blob").isNotNull()).groupBy("blob").agg(F.min("id").alias("id"), F.count("*").alias("weight"))
        .withColumn("node", F.monotonically_increasing_id()), "vector-classes",
    )
    length = (F.octet_length("blob") / np.dtype(dtype).itemsize).cast("int")
    links = None
    for dim, n in classes.groupBy(length.alias("dim")).count().collect():
        same = classes.filter(length == dim).select("node", "blob")
        most = max(1, SAMPLE_BYTES // (8 * dim) // LEAF_SAMPLE)
        depth = max(0, min(math.ceil(math.log2(max(1, n / TASK_VECTORS))), int(math.log2(most))))
        margin = spill(threshold, dim)
        forest = [{} for _ in range(trees)]
        if depth:
            sample = unit([r[0] for r in same.orderBy(F.xxhash64("node")).limit(LEAF_SAMPLE << depth).select("blob").collect()], dtype)
            forest = [grow(sample, tree, depth, margin) for tree in range(trees)]
        placed = same.mapInArrow(_route(forest, dtype, margin), "tree int, leaf long, node long, blob binary")
        cells = _in_cells(placed, ["tree", "leaf"], LEAF_BLOCK).select("slot", "tree", "leaf", "block", "bi", "bj", "node", "blob")
        found = cells.groupBy("slot").applyInArrow(_leaf_task(dtype, threshold), "a long, b long")
        links = found if links is None else links.unionAll(found)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "a long, b long")
    part = components(links).withColumnRenamed("id", "node")
    member = written(classes.join(part, "node").select("component", "node", "id", "weight", "blob"), "vector-members")
    cells = _in_cells(member.select("component", "node", "weight", "blob"), ["component"], BLOCK).select("slot", "component", "block", "bi", "bj", "node", "weight", "blob")
    counted = cells.groupBy("slot").applyInArrow(_count_task(dtype, threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    lowest = member.groupBy("component").agg(F.min("id").alias("lowest"))
    linked = member.select("component", "node").join(lowest, "component").join(counted, "node").select("node", "lowest", "links")
    of_class = classes.join(linked, "node", "left").select(
        "blob", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("lowest", "id").alias("component_id")
    )
    whole = rows.join(of_class, "blob", "left").withColumn("here", F.col("id").isNotNull())
    component = F.when(F.col("here"), F.coalesce("component_id", "id"))
    return whole.select(
        F.col("id").alias(id_col), F.when(F.col("here"), F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("here") & (F.col("id") == component)).alias("kept"),
    )
