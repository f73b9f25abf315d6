"""Connected components of links that never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import written

MOST_ROUNDS = 60


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (u, v) with u > v.

    Every node's neighbours above it move to the lowest node it knows, then those
    below it do.  The lowest neighbour is an aggregate with map-side combine and
    meets the links in a join, so a node with very many links is never gathered.
    """
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every linked id; the component is the smallest id reachable.

    Star steps repeat until the links stop changing, each written to the shared
    folder.  Links of an id to itself, repeated links and nulls change nothing; no
    links give no rows.
    """
    now = written(
        links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links"
    )
    mark = None
    for _ in range(MOST_ROUNDS):
        found = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found[0] == 0 or mark == tuple(found):
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select("v", "v")).distinct()
        mark = tuple(found)
        now = written(_stars(now), "links")
    raise RuntimeError(f"links did not settle in {MOST_ROUNDS} rounds")
