"""Claims: verdicts, conflicts, currentness, chains, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry
from ..sources.staging import staged


def _fact():
    return Window.partitionBy("subject_id", "predicate")


def object_key(prefix: str = "") -> Column:
    """An entity's id, else the folded text, else ''."""
    return F.when(F.col(prefix + "object_id").isNotNull(), F.concat(F.lit("entity:"), F.col(prefix + "object_id"))).otherwise(F.coalesce(F.lower(F.trim(F.col(prefix + "object_text"))), F.lit("")))


def verdict(a_key: Column, b_key: Column, same_polarity: Column, functional: Column) -> Column:
    """Of two claims with one subject and predicate."""
    return F.when((a_key == "") | (b_key == ""), "unclear").when((a_key == b_key) & same_polarity, "duplicate").when(a_key == b_key, "contradicts").when(functional, "contradicts").otherwise("coexists")


def score_of(v: Column, a_key: Column, b_key: Column) -> Column:
    s = registry.VERDICTS
    return F.when(v == "duplicate", s["duplicate"]).when((v == "contradicts") & (a_key == b_key), s["contradicts"]).when(v == "contradicts", s["contradicts_functional"]).when(v == "coexists", s["coexists"]).otherwise(s["unclear"])


def related_verdicts(claims: DataFrame, functional=registry.FUNCTIONAL_PREDICATES, depth: int = 10) -> DataFrame:
    """Each live claim against the ``depth`` next older ones of its subject and predicate, newer to older.

    A window of fixed depth in place of a self-join: a hot subject costs rows times depth.
    """
    live = claims.filter(~F.col("status").isin("rejected", "archived")).withColumn("key", object_key())
    w = _fact().orderBy("created_at", "id").rowsBetween(-depth, -1)
    rows = live.withColumn("older", F.collect_list(F.struct("id", "key", "polarity")).over(w)).select("id", "predicate", "key", "polarity", F.explode("older").alias("o"))
    v = verdict(F.col("key"), F.col("o.key"), F.col("polarity") == F.col("o.polarity"), F.col("predicate").isin(*functional))
    return rows.select(F.col("id").alias("source_id"), F.col("o.id").alias("target_id"), v.alias("relationship"), score_of(v, F.col("key"), F.col("o.key")).alias("confidence")).filter("relationship <> 'unclear'")


def conflict_groups(claims: DataFrame, functional=registry.FUNCTIONAL_PREDICATES) -> DataFrame:
    """Of each subject and predicate with a conflict among claims that aren't superseded: number of conflicting pairs.

    Pairs are counted from group totals, never listed: those of one object with both polarities, and for
    functional predicates those of different objects.
    """
    live = claims.filter("status <> 'superseded'").withColumn("key", object_key()).filter("key <> ''")
    per = live.groupBy("subject_id", "predicate", "key").agg(F.count(F.when(F.col("polarity") == "positive", 1)).alias("p"), F.count(F.when(F.col("polarity") != "positive", 1)).alias("q"))
    out = per.groupBy("subject_id", "predicate").agg(F.sum(F.col("p") * F.col("q")).alias("opposed"), F.sum(F.col("p") + F.col("q")).alias("n"), F.sum((F.col("p") + F.col("q")) * (F.col("p") + F.col("q"))).alias("sq"))
    differing = F.when(F.col("predicate").isin(*functional), F.expr("(n * n - sq) div 2")).otherwise(F.lit(0))
    return out.select("subject_id", "predicate", "opposed", differing.alias("differing")).filter("opposed + differing > 0")


def conflict_pairs(claims: DataFrame, functional=registry.FUNCTIONAL_PREDICATES) -> DataFrame:
    """The opposed pairs themselves: same subject, predicate and object, other polarity. Keyed by the object as well, so a group's size is that of one statement."""
    live = claims.filter("status <> 'superseded'").withColumn("key", object_key()).filter("key <> ''")
    a = live.filter("polarity = 'positive'").select("subject_id", "predicate", "key", F.col("id").alias("positive_id"))
    b = live.filter("polarity <> 'positive'").select("subject_id", "predicate", "key", F.col("id").alias("negative_id"))
    return a.join(b, ["subject_id", "predicate", "key"])


def repointed(claims: DataFrame, keep: str, drop: str) -> DataFrame:
    """Claims as they would be after merging entity ``drop`` into ``keep``."""
    move = lambda c: F.when(F.col(c) == drop, F.lit(keep)).otherwise(F.col(c))
    return claims.withColumns({"subject_id": move("subject_id"), "object_id": move("object_id")})


def merge_impact(claims: DataFrame, keep: str, drop: str, functional=registry.FUNCTIONAL_PREDICATES) -> DataFrame:
    """Conflicting subject and predicate groups that only exist after the merge, with their pairs."""
    touched = claims.filter(F.col("subject_id").isin(keep, drop) | F.col("object_id").isin(keep, drop))
    before, after = conflict_groups(touched, functional), conflict_groups(repointed(touched, keep, drop), functional)
    old = before.select(F.when(F.col("subject_id") == drop, F.lit(keep)).otherwise(F.col("subject_id")).alias("subject_id"), "predicate", (F.col("opposed") + F.col("differing")).alias("b"))
    old = old.groupBy("subject_id", "predicate").agg(F.sum("b").alias("b"))
    out = after.join(old, ["subject_id", "predicate"], "left").withColumn("new_pairs", F.col("opposed") + F.col("differing") - F.coalesce("b", F.lit(0)))
    return out.select("subject_id", "predicate", "new_pairs").filter("new_pairs > 0")


def current(claims: DataFrame) -> DataFrame:
    """Claims without the superseded ones whose subject and predicate have a current one."""
    covered = F.max((F.col("status") != "superseded").cast("int")).over(_fact())
    return claims.withColumn("_c", covered).filter((F.col("status") != "superseded") | (F.col("_c") == 0)).drop("_c")


def best_per_statement(claims: DataFrame) -> DataFrame:
    """The claim of lowest state rank, then highest confidence, of each statement, with its number of claims."""
    rank = F.when(F.col("status") == "superseded", 3).when(F.col("status") == "candidate", 2).otherwise(1)
    keyed = claims.filter("status <> 'rejected'").withColumn("key", object_key())
    best = F.min_by("id", F.struct(rank, -F.col("confidence"), F.col("id"))).alias("id")
    return keyed.groupBy("subject_id", "predicate", "key").agg(best, F.count("*").alias("members"))


def states(claims: DataFrame, disputed: DataFrame) -> DataFrame:
    """historical, disputed, candidate or current."""
    d = disputed.select(F.col("claim_id").alias("id"), F.lit(True).alias("d")).distinct()
    s = F.when(F.col("status") == "superseded", "historical").when(F.col("d"), "disputed").when(F.col("status") == "candidate", "candidate").otherwise("current")
    return claims.filter("status <> 'rejected'").join(d, "id", "left").select("id", s.alias("state"))


def _older(edges: DataFrame) -> DataFrame:
    """a, b: of each newer claim the first claim (the smallest id) that it supersedes."""
    return edges.filter("source_id <> target_id").groupBy(F.col("source_id").alias("a")).agg(F.min("target_id").alias("b"))


def _doubled(jump: DataFrame) -> DataFrame:
    """Steps of twice the length."""
    return jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))


def supersede_chains(edges: DataFrame) -> DataFrame:
    """root (a claim nothing supersedes), id, depth: from each root along the first edge of each claim, newer to older.

    Steps are doubled each round, and what is reached is a pair and a depth, so a chain of n costs n rows and a
    logarithm of rounds. Where a chain runs into a loop, each claim has its first depth; `supersede_cycles` reports loops.
    """
    jump = staged(_older(edges), "older")
    roots = jump.join(edges.filter("source_id <> target_id").select(F.col("target_id").alias("a")), "a", "left_anti")
    out, length = staged(roots.select(F.col("a").alias("root"), F.col("b").alias("id"), F.lit(1).cast("long").alias("depth")), "chains"), 1
    n = out.count()
    while n:
        further = out.join(jump.select(F.col("a").alias("id"), "b"), "id").select("root", F.col("b").alias("id"), (F.col("depth") + length).alias("depth"))
        out = staged(out.unionByName(further).groupBy("root", "id").agg(F.min("depth").alias("depth")), "chains")
        last, n = n, out.count()
        if n == last:
            break
        jump, length = staged(_doubled(jump), "older"), 2 * length
    return out.select("root", "id", F.col("depth").cast("int").alias("depth"))


def supersede_cycles(edges: DataFrame) -> DataFrame:
    """id of each claim on a loop of first edges: where steps longer than there are claims still lead."""
    jump, length = staged(_older(edges), "older"), 1
    n = jump.count()
    while length <= n and not jump.isEmpty():
        jump, length = staged(_doubled(jump), "older"), 2 * length
    return jump.select(F.col("b").alias("id")).distinct()


def supersede_recommended(relationship: Column, functional: Column, temporal: Column, evolution: Column, signal: Column) -> Column:
    """Whether to offer a supersession: a contradiction of a functional, temporal, supersedable predicate with a sign of change."""
    return (relationship == "contradicts") & functional & temporal & (F.coalesce(evolution, F.lit("supersedable")) == "supersedable") & F.coalesce(signal.isin(*registry.EVOLUTION_SIGNALS), F.lit(False))


def canonical_pair(a: Column, b: Column) -> Column:
    """One key for both orders of a pair."""
    return F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def effective_periods(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """from: a claim's own time; to: that of the accepted claim that supersedes it."""
    to = edges.filter("relationship = 'supersedes' and status = 'accepted'").groupBy(F.col("target_id").alias("id")).agg(F.min("created_at").alias("effective_to"))
    return claims.join(to, "id", "left").select("id", F.col("created_at").alias("effective_from"), "effective_to")


def attributed(edges: DataFrame, kind: str, status: str, both_ends: bool = False) -> DataFrame:
    """claim_id of each edge of a kind and status: its newer end, or both."""
    e = edges.filter((F.col("relationship") == kind) & (F.col("status") == status))
    newer = e.select(F.col("source_id").alias("claim_id"))
    return newer.unionAll(e.select(F.col("target_id").alias("claim_id"))) if both_ends else newer


def apply_operations(claims: DataFrame, operations: DataFrame) -> DataFrame:
    """The snapshot after a log of status operations (claim_id, status, at, op_id): the last one of each claim holds."""
    last = operations.groupBy(F.col("claim_id").alias("id")).agg(F.max_by("status", F.struct("at", "op_id")).alias("new_status"))
    return claims.join(last, "id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
