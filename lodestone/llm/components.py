"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a pre-aggregated minimum and a join, so a node with very many links is no single task's
work; each pair of steps is staged, so lineage stays short and no step depends on one executor's disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select(F.col("v"), F.col("u"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable, for every node that has a link to another."""
    edges = staged(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v")).distinct(), "links")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        old, edges = edges, staged(_star(_star(edges, True), False), "stars")
        dropped(old)
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v")).distinct())
