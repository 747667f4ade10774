"""Neighbourhoods, degrees, induced subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged


def neighborhood(edges: DataFrame, root: str, depth: int) -> DataFrame:
    """id and hop (1 to ``depth``, at most 3) of the nodes around a root: one pair of equi-joins a hop, no OR-join.

    Each frontier is a table of its own, so a hop's plan holds neither the hops before it nor their edges again.
    """
    both = edges.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).unionByName(edges.select(F.col("target_id").alias("a"), F.col("source_id").alias("b")))
    both = staged(both, "edges") if depth > 1 else both
    first = both.filter(F.col("a") == root).select(F.col("b").alias("id")).filter(F.col("id") != root).distinct().withColumn("hop", F.lit(1))
    frontier = staged(first, "frontier") if depth > 1 else first
    seen = frontier
    for k in range(2, max(1, min(depth, 3)) + 1):
        step = both.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).filter(F.col("id") != root).distinct()
        frontier = staged(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(k)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def degrees(edges: DataFrame) -> DataFrame:
    """Edges at each node, both ends; a self-edge counts twice."""
    ends = edges.select(F.col("source_id").alias("id")).unionAll(edges.select(F.col("target_id").alias("id")))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges with both ends among the nodes."""
    a, b = nodes.select(F.col("id").alias("source_id")), nodes.select(F.col("id").alias("target_id"))
    return edges.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi").distinct()


def touching(claims: DataFrame, ids: DataFrame) -> DataFrame:
    """Claims whose subject or object is among the ids: two semi-joins and a union in place of an OR."""
    s = claims.join(ids.select(F.col("id").alias("subject_id")), "subject_id", "left_semi").select(claims.columns)
    o = claims.join(ids.select(F.col("id").alias("object_id")), "object_id", "left_semi").select(claims.columns)
    return s.unionByName(o).dropDuplicates(["id"])


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of the nodes of undirected edges (a, b).

    Each round a node takes its neighbours' smallest label and then its label's label, so long paths shrink by doubling.
    """
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("_near")), "b").groupBy(F.col("a").alias("id")).agg(F.min("_near").alias("_near"))
        step = labels.join(near, "id").select("id", F.col("component").alias("_was"), F.least("component", "_near").alias("_now"))
        jump = labels.select(F.col("id").alias("_now"), F.col("component").alias("_root"))
        step = staged(step.join(jump, "_now", "left").select("id", "_was", F.least("_now", F.coalesce("_root", "_now")).alias("component")), "labels")
        labels = step.select("id", "component")
        if step.filter(F.col("_was") != F.col("component")).isEmpty():
            return labels
