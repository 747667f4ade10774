"""Queries of predicate resolution and draft compilation, each beside its SQL, which has the verdicts of the forms worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import registry
from ..operators import drafts, predicates
from ..sources import tables as kb
from .queries import query

#: Candidate forms, and what each must resolve to: (form, status, predicate, source, confidence, signal, candidates, reason).
_FORMS = (
    ("uses", "resolved", "uses", "exact", 1.0, None, "uses", "registered_value"),
    ("CEO", "resolved", "has_ceo", "registry_alias", 0.95, None, "has_ceo", "registry_alias_match"),
    ("new_ceo", "resolved", "has_ceo", "temporal_split", 0.97, "new", "has_ceo", "temporal_signal_separated"),
    ("optimises", "resolved", "improves", "alias", 0.8, None, "improves", "single_registry_alias"),
    ("supports and enables", "ambiguous", None, "alias", 0.0, None, "supports,enables", "multiple_registry_candidates"),
    ("frobnicates", "unresolved", None, "none", 0.0, None, None, "no_registry_match"),
    ("Chief Executive-Officer former", "resolved", "has_ceo", "temporal_split", 0.97, "former", "has_ceo", "temporal_signal_separated"),
    ("前任首席执行官", "unresolved", None, "none", 0.0, "former", None, "no_registry_match"),
    ("", "unresolved", None, "none", 0.0, None, "", "empty_predicate_candidate"),
    ("current_improvement", "resolved", "improves", "alias", 0.8, "current", "improves", "single_registry_alias"),
    ("Based  On", "resolved", "based_on", "exact", 1.0, None, "based_on", "registered_value"),
)


def _lit(v) -> str:
    return "null" if v is None else str(v) if isinstance(v, float) else "'" + v.replace("'", "''") + "'"


_FORM_ROWS = ", ".join(f"({k}, {', '.join(map(_lit, row))})" for k, row in enumerate(_FORMS))
_HINT_ROWS = ", ".join(f"({k}, {_lit(n)}, {_lit(h)})" for k, n in enumerate(registry.CLAIM_PREDICATES) for h in registry.PREDICATE_HINTS.get(n, ()))
_STEM_ROWS = ", ".join(f"({k}, {_lit(n)}, {_lit(t)})" for k, n in enumerate(registry.CLAIM_PREDICATES) for t in n.split("_") if len(t) > 3)


@query(f"""with form(k, candidate, status, predicate, source, confidence, signal, names, reason) as (values {_FORM_ROWS}),
hint(place, name, word) as (values {_HINT_ROWS}), stem(place, name, word) as (values {_STEM_ROWS}),
t as (select conv_id, turn, lower(text) as x, (length(text) + turn) % {len(_FORMS)} as k from conversations),
hits as (select conv_id, turn, place, name, count(*) as n from t join hint on contains(x, word) group by all),
more as (select conv_id, turn, place, name, count(*) as n from t join stem on contains(x, word) anti join hits using (conv_id, turn, place) group by all),
best as (select *, row_number() over (partition by conv_id, turn order by n desc, place) as r from (select * from hits union all select * from more)),
near as (select conv_id, turn, string_agg(name, ',' order by r) as names from best where r <= 5 group by all)
select conv_id, turn, status, predicate, source, confidence::double as confidence, signal as temporal_signal, coalesce(form.names, near.names, '') as candidates, reason from t join form using (k) left join near using (conv_id, turn)""", prelude=False)
def predicate_ladder(spark, d):
    at = F.length("text") + F.col("turn")
    turns = kb.table(spark, d, "conversations").withColumn("form", F.element_at(F.array(*[F.lit(f[0]) for f in _FORMS]), (at % len(_FORMS) + 1).cast("int")))
    done = predicates.resolve(turns, "form", "text")
    r = "resolution."
    return done.select("conv_id", "turn", r + "status", r + "predicate", r + "source", r + "confidence", r + "temporal_signal", F.array_join(r + "candidates", ",").alias("candidates"), r + "reason")


_PREDICATES = ("uses", "CEO", "new_ceo", "optimises", "supports and enables", "frobnicates", "creates")


def _envelopes(spark, d):
    """An envelope for each event: a user under an alias, a target, a claim between them, a question and an idea; each breaks some rule now and then."""
    # a row costs some milliseconds' work and few bytes, so files are dealt to all cores, not by their size
    e, n = kb.table(spark, d, "events").select("event_id", "user_id", "event_type").repartition(4 * spark.sparkContext.defaultParallelism, "event_id"), F.col("event_id")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    user, target = F.concat(F.lit("User  "), F.col("user_id").cast("string")), F.concat(F.lit("target "), (n % 50).cast("string"))
    types = F.when(n % 3 == 0, F.array(F.lit("Organization"))).when(n % 3 == 1, F.array(F.lit("place"), F.lit("Person"))).otherwise(F.array(F.lit("Company")))
    entities = F.array(F.struct(user.alias("name"), types.alias("types"), F.array(F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("aliases")), F.struct(target.alias("name"), F.array(F.lit("Person")).alias("types"), F.array().cast("array<string>").alias("aliases")))
    context = F.when(n % 4 == 0, F.create_map(F.lit("scope"), F.lit("tests"))).otherwise(F.create_map(F.lit("scope"), F.lit("")))
    claim = F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"), pick(_PREDICATES).alias("predicate"), F.when(n % 5 != 0, target).alias("object"), F.when(n % 17 == 0, "guess").otherwise("Fact").alias("claim_type"), F.when(n % 6 == 0, "maybe").otherwise("asserted").alias("modality"), context.alias("context"), F.when(n % 13 == 0, 1.5).otherwise(0.5).alias("confidence"), F.lit("c1").alias("source_chunk"), F.when(n % 11 == 0, "").otherwise(F.col("event_type")).alias("evidence_quote"))
    sourced = (F.lit("c1").alias("source_chunk"), F.lit("q").alias("evidence_quote"))
    question = F.struct(F.when(n % 19 == 0, "").otherwise(F.col("event_type")).alias("content"), *sourced)
    idea = F.struct(F.col("event_type").alias("content"), F.when(n % 23 == 0, "bogus").otherwise("accepted").alias("status"), *sourced)
    body = F.to_json(F.struct(entities.alias("entities"), F.array(claim).alias("claims"), F.array(question).alias("questions"), F.array(idea).alias("ideas")))
    body = F.when(n % 101 == 0, F.substring(body, 1, 20)).otherwise(body)
    return e.select(n.alias("id"), body.alias("body"), F.col("event_type").alias("source_text"))


# k: the claim's form; the user's types are known where event_id % 3 isn't 2
_CODES = f"""
ev as (select event_id as id, event_type, event_id % {len(_PREDICATES)} as k, event_id % 3 as t3, event_id % 5 = 0 as bare, event_id % 101 = 0 as torn,
  event_id % 11 = 0 as unquoted, event_id % 17 = 0 as guess, event_id % 13 = 0 as much, event_id % 19 = 0 as mute, event_id % 23 = 0 as bogus, event_id % 6 = 0 as maybe, event_id % 4 = 0 as scoped, user_id, event_id % 50 as target from events),
code as (select *, case when unquoted then 'EVIDENCE_INVALID' when k in (4, 5) then 'UNSUPPORTED_PREDICATE' when guess then 'CLAIM_INVALID'
  when k in (1, 2) and t3 = 1 then 'DOMAIN_RANGE_INVALID' when much then 'SCHEMA_INVALID' end as claim_code from ev)"""


@query(f""",{_CODES}
select id, 'envelope' as section, 0 as item_index, 'REJECTED' as status, 'ENTITY_INVALID' as error_code from code where torn
union all select id, 'entities', 0, case when t3 = 2 then 'REJECTED' else 'ACCEPTED' end, case when t3 = 2 then 'ENTITY_INVALID' end from code where not torn
union all select id, 'entities', 1, 'ACCEPTED', null from code where not torn
union all select id, 'claims', 0, case when claim_code is null then 'ACCEPTED' else 'REJECTED' end, claim_code from code where not torn
union all select id, 'questions', 0, case when mute then 'REJECTED' else 'ACCEPTED' end, case when mute then 'SCHEMA_INVALID' end from code where not torn
union all select id, 'ideas', 0, case when bogus then 'REJECTED' else 'ACCEPTED' end, case when bogus then 'SCHEMA_INVALID' end from code where not torn""")
def draft_items(spark, d):
    return drafts.compile_items(_envelopes(spark, d)).select("id", "section", "item_index", "status", "error_code")


@query(f""",{_CODES}
select id, accepted, n - accepted as rejected, case when n = accepted then 'COMPLETED' when accepted > 0 then 'COMPLETED_WITH_WARNINGS' else 'FAILED' end as status from
(select id, case when torn then 1 else 5 end as n, case when torn then 0 else 1 + (t3 <> 2)::int + (claim_code is null)::int + (not mute)::int + (not bogus)::int end as accepted from code)""")
def draft_outcomes(spark, d):
    return drafts.outcomes(drafts.compile_items(_envelopes(spark, d)))


@query(f""",{_CODES},
a as (select *, ['uses', 'has_ceo', 'has_ceo', 'improves', '', '', 'creates'][k + 1] as predicate from code where claim_code is null and not torn)
select id, predicate, case when k = 2 then 'new' end as temporal_signal, case when t3 = 2 then 'REJECTED' when bare then 'CLAIM_ONLY' when k in (1, 2, 3) then 'CLAIM_ONLY' when maybe or scoped then 'CONDITIONAL_RELATION' else 'DIRECT_RELATION' end as outcome,
 case when t3 = 2 or bare then 'subject_or_object_not_resolved' when k = 3 then 'predicate_is_claim_only' when k in (1, 2) then 'no_relation_predicate_mapping' when maybe then 'non_asserted_or_negative_claim'
 when scoped then 'material_context_requires_claim_only' else 'all_direct_relation_requirements_satisfied' end as reason from a""")
def draft_relations(spark, d):
    return drafts.envelope_relations(_envelopes(spark, d)).select("id", "predicate", "temporal_signal", "outcome", "reason")


def _cases(spark, d):
    """The envelopes as cases: every second expects the user as a person, all expect the target and one claim."""
    n = F.col("id")
    user = F.concat(F.lit("user "), F.regexp_extract("body", '"name":"User  (\\d+)"', 1))
    target = F.concat(F.lit("Target "), (n % 50).cast("string"))
    entity = lambda name, kind: F.struct(name.alias("name"), F.array(F.lit(kind)).alias("types"))
    expected = F.when(n % 2 == 0, F.array(entity(user, "Person"), entity(target, "Person"))).otherwise(F.array(entity(target, "Person")))
    claim = F.array(F.struct(F.concat(F.lit("U"), F.substring(user, 6, 20)).alias("subject"), F.lit("Has CEO").alias("predicate"), target.alias("object")))
    return _envelopes(spark, d).filter(n % 101 != 0).select("id", "source_text", F.col("body").alias("model_draft"), F.to_json(expected).alias("expected_entities"), F.to_json(claim).alias("expected_claims"))


# no aliases here: the claim's subject 'u1' isn't the entity 'user 1', so its types are unknown and nothing breaks domain or range
_COUNTS = f"""{_CODES},
n as (select *, not guess and k not in (4, 5) as compiled, k in (1, 2) and not bare and not guess as right_claim from code where not torn),
c as (select id, (id % 2 = 0 and t3 = 1)::int + 1 as entity_tp, (t3 <> 2)::int - (id % 2 = 0 and t3 = 1)::int as entity_fp, (id % 2 = 0)::int - (id % 2 = 0 and t3 = 1)::int as entity_fn,
  right_claim::int as claim_tp, (compiled and not right_claim)::int as claim_fp, (not right_claim)::int as claim_fn, compiled::int as compiled_claims, (compiled and not unquoted)::int as evidence_hits, 0 as ontology_violations, (t3 = 2)::int as entity_type_violations from n)"""


@query(f",{_COUNTS} select id, entity_tp, entity_fp, entity_fn, claim_tp, claim_fp, claim_fn, compiled_claims, evidence_hits, entity_type_violations, case when compiled_claims = 0 then 1.0 else evidence_hits / compiled_claims end as evidence_accuracy from c")
def draft_case_scores(spark, d):
    return drafts.draft_report(_cases(spark, d), per_case=True).select("id", *[F.col(k).cast("int").alias(k) for k in drafts.COUNTS if k != "ontology_violations"], "evidence_accuracy")


@query(f""",{_COUNTS} select count(*) as cases, sum(entity_tp) / sum(entity_tp + entity_fp) as entity_precision, sum(entity_tp) / sum(entity_tp + entity_fn) as entity_recall, sum(claim_tp) / sum(claim_tp + claim_fp) as claim_precision,
 sum(claim_tp) / sum(claim_tp + claim_fn) as claim_recall, sum(evidence_hits) / sum(compiled_claims) as evidence_accuracy, 0.0::double as ontology_violation_rate from c""")
def draft_evaluation(spark, d):
    return drafts.draft_report(_cases(spark, d)).select("cases", "entity_precision", "entity_recall", "claim_precision", "claim_recall", "evidence_accuracy", "ontology_violation_rate")
