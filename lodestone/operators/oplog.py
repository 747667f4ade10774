"""The operation log: what a snapshot of claims and claim relations becomes when operations are applied in order.

Each operation changes the status of one claim, its target, and relations that point at it, so the log is folded by
target. A supersession keeps the status that it ends, and backing away from it restores that status, only where the
claim is still superseded. An operation that can't be applied changes nothing and says why.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import registry
from .folds import ordered_fold

#: Columns of an operation; those that a kind doesn't need are null.
OPERATION = "op_id string, at timestamp, kind string, claim_id string, new_id string, old_id string, relation_id string, status string, relationship string, supersede boolean"
_RESULT = "kind string, id string, status string, source_id string, target_id string, relationship string, previous string, message string"


def _events(claims: DataFrame, relations: DataFrame, operations: DataFrame) -> DataFrame:
    """Everything that happens to each claim, by target: what is there (rank 0), then operations in order."""
    c, null = F.col, F.lit(None)
    made = operations.filter("kind in ('CREATE', 'CORRECT')").groupBy(c("new_id").alias("id")).agg(F.min(F.struct("at", "op_id")).alias("made"))
    known = claims.select("id").withColumn("there", F.lit(True)).join(made, "id", "full")
    ops = operations.withColumn("order", F.struct("at", "op_id"))
    # whether the other claim is there by then; the target's own presence is the fold's to see
    other = F.when(c("kind") == "CORRECT", c("old_id")).otherwise(c("new_id"))
    ops = ops.withColumn("other_id", F.when(c("kind").isin("SUPERSEDE", "MERGE", "DUPLICATE", "CONTRADICT", "CORRECT"), other))
    ops = ops.join(known.select(c("id").alias("other_id"), c("there").alias("_there"), c("made").alias("_made")), "other_id", "left")
    present = F.coalesce(c("_there"), F.lit(False)) | F.coalesce(c("_made") < c("order"), F.lit(False))
    ops = ops.withColumn("other_known", present | c("other_id").isNull()).drop("_there", "_made")
    # the target of a relation: one that is there, or that an earlier operation made and named by its own id
    linking = ops.filter("kind in ('SUPERSEDE', 'MERGE', 'DUPLICATE', 'CONTRADICT') or kind = 'CORRECT' and old_id is not null and relationship is not null and relationship <> 'new'")
    targets = relations.select(c("id").alias("relation_id"), c("target_id").alias("rel_target")).unionByName(linking.select(c("op_id").alias("relation_id"), c("old_id").alias("rel_target")))
    ops = ops.join(targets, "relation_id", "left")
    fields = ("op_id", "at", "kind", "new_id", "old_id", "relation_id", "status", "relationship", "supersede", "other_known")
    target = F.when(c("kind").isin("ARCHIVE", "RESTORE", "ACCEPT"), c("claim_id")).when(c("kind") == "CREATE", c("new_id")).when(c("kind") == "RELATION_RESOLVE", c("rel_target")).otherwise(c("old_id"))
    by_target = ops.filter("kind <> 'CORRECT'").select(F.coalesce(target, F.lit("")).alias("target"), F.lit(2).alias("rank"), *fields, null.cast("boolean").alias("acceptable"), null.cast("string").alias("source_id"))
    correct = ops.filter("kind = 'CORRECT'")
    created = correct.select(c("new_id").alias("target"), F.lit(2).alias("rank"), *[F.lit("CREATE").alias("kind") if f == "kind" else c(f) for f in fields], null.cast("boolean").alias("acceptable"), null.cast("string").alias("source_id"))
    linked = correct.join(linking.select("op_id"), "op_id", "left_semi").select(c("old_id").alias("target"), F.lit(2).alias("rank"), *[F.lit("CORRECTED").alias("kind") if f == "kind" else c(f) for f in fields], null.cast("boolean").alias("acceptable"), null.cast("string").alias("source_id"))
    blank = {f: null.cast(t).alias(f) for f, t in (("op_id", "string"), ("at", "timestamp"), ("new_id", "string"), ("old_id", "string"), ("relation_id", "string"), ("relationship", "string"), ("supersede", "boolean"), ("other_known", "boolean"), ("source_id", "string"), ("acceptable", "boolean"))}
    there = claims.select(c("id").alias("target"), F.lit(0).alias("rank"), *[F.lit("claim").alias(f) if f == "kind" else c("status") if f == "status" else blank[f] for f in fields], c("acceptable"), blank["source_id"])
    rels = relations.select(c("target_id").alias("target"), F.lit(1).alias("rank"), c("id").alias("op_id"), blank["at"], F.lit("relation").alias("kind"), blank["new_id"], c("previous").alias("old_id"), c("id").alias("relation_id"), "status", "relationship", blank["supersede"], blank["other_known"], blank["acceptable"], "source_id")
    return reduce(DataFrame.unionByName, (by_target, created, linked, there, rels))


class _Claim:
    """One claim's status and the relations that point at it."""

    def __init__(self):
        self.status: str | None = None
        self.acceptable = False
        self.relations: dict[str, list] = {}  # id: source, relationship, status, previous
        self.pairs: set[tuple[str, str]] = set()
        self.done: list[tuple[str, str | None]] = []

    def link(self, row, source, relationship, status) -> str | None:
        """The new relation's id, none where the pair is there already."""
        if (source, relationship) in self.pairs:
            return None
        self.pairs.add((source, relationship))
        self.relations[row.op_id] = [source, relationship, status, None]
        return row.op_id

    def supersede(self, relation: str | None) -> None:
        if relation:
            self.relations[relation][3] = self.status
        self.status = "superseded"

    def apply(self, row) -> str | None:
        """Why the operation can't be applied, if so."""
        kind = row.kind
        if kind == "CREATE":
            if not row.other_known:
                return "claim not found"
            if self.status is not None:
                return "claim is there"
            self.status = "candidate"
            return None
        if kind == "RELATION_RESOLVE":
            held = self.relations.get(row.relation_id)
            if row.status not in ("accepted", "rejected", "candidate"):
                return "status must be accepted, rejected or candidate"
            if row.relationship is not None and row.relationship not in registry.RELATIONSHIPS:
                return "unknown relationship"
            if held is None:
                return "claim relation not found"
            held[2] = row.status
            held[1] = row.relationship or held[1]
            if row.relationship == "supersedes" and row.status == "accepted":
                held[3] = self.status
                self.status = "superseded"
            elif held[3] and self.status == "superseded":
                self.status = held[3]
            return None
        if self.status is None or row.other_known is not None and not row.other_known:
            return "claim not found"
        if kind == "ARCHIVE":
            self.status = "archived"
        elif kind == "RESTORE":
            if (row.status or "candidate") not in registry.KNOWLEDGE_STATUSES:
                return "invalid restore status"
            self.status = row.status or "candidate"
        elif kind == "ACCEPT":
            if self.status != "candidate":
                return "only a proposed claim can be accepted"
            if not self.acceptable:
                return "a research candidate with evidence and a registered predicate is needed"
            if (row.status or "verified") not in registry.KNOWLEDGE_STATUSES:
                return "unsupported claim status"
            self.status = row.status or "verified"
        elif kind == "DUPLICATE":
            self.link(row, row.new_id, "duplicate", "accepted")
        elif kind == "CONTRADICT":
            self.link(row, row.new_id, "contradicts", "candidate")
        elif kind == "SUPERSEDE":
            self.supersede(self.link(row, row.new_id, "supersedes", "accepted"))
        elif kind == "MERGE":
            if row.new_id == row.old_id:
                return "two different claims are needed"
            self.link(row, row.new_id, "duplicate", "accepted")
            self.status = "archived"
        elif kind == "CORRECTED":
            made = self.link(row, row.new_id, row.relationship, "accepted" if row.relationship in ("duplicate", "coexists") else "candidate")
            if row.relationship == "supersedes" and row.supersede:
                self.supersede(made)
        else:
            return "unknown operation"
        return None


def _step(state: _Claim, row) -> _Claim:
    if row.kind == "claim":
        state.status, state.acceptable = row.status, bool(row.acceptable)
    elif row.kind == "relation":
        state.relations[row.relation_id] = [row.source_id, row.relationship, row.status, row.old_id]
        state.pairs.add((row.source_id, row.relationship))
    else:
        state.done.append((row.op_id, state.apply(row)))
    return state


def _finish(key, state: _Claim) -> list[tuple]:
    out = [("claim", key[0], state.status, None, None, None, None, None)] if state.status is not None else []
    out += [("relation", k, status, source, key[0], relationship, previous, None) for k, (source, relationship, status, previous) in state.relations.items()]
    return out + [("operation", op, "refused" if why else "applied", None, None, None, None, why) for op, why in state.done]


def applied(claims: DataFrame, relations: DataFrame, operations: DataFrame) -> DataFrame:
    """Rows of three kinds: claim (id, status), relation (id, source_id, target_id, relationship, status, previous) and operation (id, status applied or refused, message).

    claims: id, status, acceptable (a research candidate with a quote and a registered predicate); relations: id,
    source_id, target_id, relationship, status, previous; operations as in ``OPERATION``, in order of at, then op_id. A
    relation that an operation makes has the operation's id. Unknown kinds and operations without a target are refused.
    """
    events = _events(claims, relations, operations)
    done = ordered_fold(events, ["target"], ["rank", "at", "op_id"], lambda key: _Claim(), _step, _finish, _RESULT)
    # a correction is two events; it is refused if either is
    ops = done.filter("kind = 'operation'").groupBy("kind", "id").agg(F.max("status").alias("status"), F.max("message").alias("message"))
    null = F.lit(None).cast("string")
    ops = ops.select("kind", "id", "status", *[null.alias(n) for n in ("source_id", "target_id", "relationship", "previous")], "message")
    return done.filter("kind <> 'operation'").unionByName(ops)
