"""Merges of entities: where each ends up after all merges in order, and what that does to claims, relations and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .lifecycle import conflict_groups
from .. import registry


def destinations(merges: DataFrame) -> DataFrame:
    """id, keep_id: the entity that holds in the end what was an entity's own, for each that merges (keep_id, drop_id, at, merge_id) drop.

    What a merge moves goes on with the next merge that drops its new holder, by order of at, then merge_id. These steps
    are doubled, so chains of any length take a logarithm of rounds; steps only go forward in time, so loops of merges end.
    """
    m = merges.filter("keep_id <> drop_id").select("keep_id", "drop_id", F.struct("at", "merge_id").alias("order"))
    drops = m.groupBy(F.col("drop_id").alias("keep_id")).agg(F.sort_array(F.collect_set("order")).alias("drops"))
    later = F.get(F.filter("drops", lambda o: o > F.col("order")), F.lit(0))
    steps = staged(m.join(drops, "keep_id", "left").select("order", F.col("keep_id").alias("holder"), later.alias("next")), "merge-steps")
    while not steps.filter("next is not null").isEmpty():
        ahead = steps.select(F.col("order").alias("next"), F.col("holder").alias("_holder"), F.col("next").alias("_next"))
        steps = staged(steps.join(ahead, "next", "left").select("order", F.coalesce("_holder", "holder").alias("holder"), F.col("_next").alias("next")), "merge-steps")
    first = m.groupBy(F.col("drop_id").alias("id")).agg(F.min("order").alias("order"))
    return first.join(steps, "order").select("id", F.col("holder").alias("keep_id"))


def repointed(rows: DataFrame, to: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows with every merged entity in ``columns`` replaced by the one that holds it; null ends stay null."""
    names = rows.columns
    for k, c in enumerate(columns):
        rows = rows.join(to.select(F.col("id").alias(f"_from{k}"), F.col("keep_id").alias(f"_to{k}")), F.col(c) == F.col(f"_from{k}"), "left").withColumn(c, F.coalesce(f"_to{k}", c)).drop(f"_from{k}", f"_to{k}")
    return rows.select(*names)


def merged_entities(entities: DataFrame, to: DataFrame) -> DataFrame:
    """id, name, aliases, status (archived for merged ones) of entities (id, name, aliases, status) after merges.

    A survivor's aliases are all aliases and names that it holds, sorted; a merged entity has none, and a name that says where it went.
    """
    moved = entities.join(to, "id", "left")
    gained = moved.filter(F.col("keep_id").isNotNull() & (F.col("keep_id") != F.col("id"))).groupBy(F.col("keep_id").alias("id")).agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name"))))).alias("gained"))
    names = entities.select(F.col("id").alias("keep_id"), F.col("name").alias("keep_name"))
    out = moved.join(names, "keep_id", "left").join(gained, "id", "left")
    gone = F.col("keep_id").isNotNull() & (F.col("keep_id") != F.col("id"))
    aliases = F.when(F.col("gained").isNotNull(), F.array_sort(F.array_union(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name")), "gained"))).otherwise(F.col("aliases"))
    name = F.concat("name", F.lit("（已并入 "), "keep_name", F.lit("）"))
    return out.select("id", F.when(gone, name).otherwise(F.col("name")).alias("name"), F.when(gone, F.array().cast("array<string>")).otherwise(aliases).alias("aliases"), F.when(gone, "archived").otherwise(F.col("status")).alias("status"))


def merge_all(claims: DataFrame, relations: DataFrame, entities: DataFrame, merges: DataFrame, functional=registry.FUNCTIONAL_PREDICATES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Claims, relations and entities after all merges, and the conflicts (subject_id, predicate, opposed, differing) among the claims that a survivor now has an end of."""
    to = staged(destinations(merges), "merged")
    after = repointed(claims, to, ("subject_id", "object_id"))
    kept = to.select(F.col("keep_id").alias("id")).distinct()
    touched = after.join(kept.withColumnRenamed("id", "subject_id"), "subject_id", "left_semi").unionByName(after.join(kept.withColumnRenamed("id", "object_id"), "object_id", "left_semi")).dropDuplicates(["id"])
    return after, repointed(relations, to, ("source_id", "target_id")), merged_entities(entities, to), conflict_groups(touched, functional)
