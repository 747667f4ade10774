"""Predicate resolution, draft compilation, relation derivation and draft evaluation on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import drafts, predicates


def resolved(spark, candidates, text="", **how):
    df = spark.createDataFrame([(k, c, text) for k, c in enumerate(candidates)], "k int, c string, t string")
    return [r["resolution"] for r in predicates.resolve(df, "c", "t", **how).orderBy("k").collect()]


def test_every_step_of_the_ladder(spark):
    got = resolved(spark, ["Uses", "ceo", "ceo_new", "新任CEO", "即将 首席执行官", "enhancement", "supports and enables", "head_of_company", "  ", None, "new", "designed-for"], "It depends on caching, it depends on nothing, and we compare it")
    short = [(r.status, r.predicate, r.source, r.confidence, r.temporal_signal) for r in got]
    assert short == [
        ("resolved", "uses", "exact", 1.0, None), ("resolved", "has_ceo", "registry_alias", 0.95, None), ("resolved", "has_ceo", "temporal_split", 0.97, "new"), ("resolved", "has_ceo", "registry_alias", 0.95, None),
        ("unresolved", None, "none", 0.0, "next"), ("resolved", "improves", "alias", 0.8, None), ("ambiguous", None, "alias", 0.0, None), ("unresolved", None, "none", 0.0, None), ("unresolved", None, "none", 0.0, None), ("unresolved", None, "none", 0.0, None),
        ("unresolved", None, "none", 0.0, None), ("resolved", "designed_for", "exact", 1.0, None),
    ]
    assert got[6].candidates == ["supports", "enables"] and got[7].candidates == ["depends_on", "compares_with"] and got[8].reason == got[9].reason == "empty_predicate_candidate"


def test_suggestions_come_by_hits_then_order_and_are_limited(spark):
    text = "better, improve, enhance; cut and reduce; use; need; allow; avoid"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(predicates.suggested(F.col("t"), 4)).collect()]
    assert got == [["improves", "reduces", "uses", "enables"], [], []]
    assert len(df.limit(1).select(predicates.suggested(F.col("t"), 0)).first()[0]) == 1


def test_a_registry_of_ones_own(spark):
    own = predicates.Predicates(names=("owns", "likes_best"), aliases={"owns": ("holds",)}, hints={}, domain={}, range={"owns": ("Product",)}, relations={})
    got = resolved(spark, ["holds", "former_holds", "likings", "best_of"], known=own)
    assert [(r.predicate, r.temporal_signal) for r in got] == [("owns", None), ("owns", "former"), (None, None), ("likes_best", None)]


def claim(**over):
    return {"subject": "Acme", "predicate": "uses", "object": "Tool", "source_chunk": "c1", "evidence_quote": "q", "confidence": 0.5} | over


ENVELOPE = {
    "entities": [{"name": " Acme  Inc ", "types": ["Organization"], "aliases": ["Acme", "Acme "], "description": None}, {"name": "Tool", "type": "concept"}, {"name": "", "types": ["Person"]}, {"name": "X", "types": ["Robot"]}, "text", {"name": "Y", "types": ["Person"], "age": 3}, {"name": "Ann", "types": ["Person"], "aliases": []}, {"name": "Z", "types": []}],
    "claims": [claim(), claim(predicate="CEO", object="Ann"), claim(predicate="new_ceo", object="Tool"), claim(predicate="frobs"), claim(evidence_quote=""), claim(claim_type="guess"), claim(confidence=2), claim(extra=1), claim(object=5), claim(claim_type="Definition", polarity="NO", modality="must", temporal_signal="soonish", context="a note"), 7, claim(source_chunk=""), claim(confidence="unstated"), claim(subject="  ")],
    "events": [{"event_type": "release", "description": "d", "source_chunk": "c", "evidence_quote": "q"}, {"event_type": "party", "description": "d", "source_chunk": "c", "evidence_quote": "q"}, {"event_type": "release", "source_chunk": "c"}, {"event_type": "release", "description": "d", "time": {"start": None, "end": "2024", "precision": "year"}, "source_chunk": "c", "evidence_quote": "q"}, {"event_type": "release", "description": "d", "time": {"start": 3, "end": None, "precision": "year"}, "source_chunk": "c", "evidence_quote": "q"}],
    "ideas": [{"content": "x", "source_chunk": "c", "evidence_quote": "q"}, {"content": "x", "status": "bad", "source_chunk": "c", "evidence_quote": "q"}],
    "questions": "none",
    "relations": [1],
}


@pytest.fixture(scope="module")
def compiled(spark):
    rows = [("a", json.dumps(ENVELOPE)), ("b", "not json"), ("c", None), ("d", "[1]"), ("e", "{}"), ("f", json.dumps({"entities": [{"name": "A", "type": "robot"}], "claims": [claim()]})), ("g", json.dumps({"ideas": [{"content": "only"}]}))]
    df = spark.createDataFrame(rows, "id string, body string").withColumn("section", F.lit("clash"))
    return drafts.compile_items(df).drop("item").cache()


def codes(compiled, section, which="a"):
    return [r.error_code for r in compiled.filter((F.col("section") == section) & (F.col("id") == which)).orderBy("item_index").collect()]


def test_each_item_is_refused_for_itself(compiled):
    assert codes(compiled, "entities") == [None, None, "ENTITY_INVALID", "ENTITY_INVALID", "ENTITY_INVALID", "SCHEMA_INVALID", None, "ENTITY_INVALID"]
    assert codes(compiled, "claims") == [None, None, "DOMAIN_RANGE_INVALID", "UNSUPPORTED_PREDICATE", "EVIDENCE_INVALID", "CLAIM_INVALID", "SCHEMA_INVALID", "SCHEMA_INVALID", "SCHEMA_INVALID", None, "CLAIM_INVALID", "SCHEMA_INVALID", None, "SCHEMA_INVALID"]
    assert codes(compiled, "events") == [None, "SCHEMA_INVALID", "SCHEMA_INVALID", None, "SCHEMA_INVALID"]
    assert codes(compiled, "ideas") == [None, "SCHEMA_INVALID"] and codes(compiled, "questions") == []
    assert codes(compiled, "envelope", "b") == codes(compiled, "envelope", "d") == codes(compiled, "envelope", "f") == ["ENTITY_INVALID"]
    assert compiled.filter("id in ('c', 'e')").count() == 0
    messages = {r.item_index: r.error_message for r in compiled.filter("id = 'a' and section = 'claims'").collect()}
    assert messages[3] == "Unsupported claim predicate: frobs. Use a predicate from the schema enum." and "domain/range" in messages[2] and messages[5] == "Unsupported claim type: guess"


def test_refused_items_keep_their_input_and_only_accepted_ones_a_result(compiled):
    rows = compiled.collect()
    assert all((r.compiled is None) == (r.status == "REJECTED") and r.input for r in rows)
    assert json.loads(next(r.input for r in rows if r.id == "a" and r.section == "claims" and r.item_index == 3))["predicate"] == "frobs"


def test_accepted_rows_are_canonical(compiled):
    e = [(r.name, r.types, r.aliases) for r in drafts.accepted_entities(compiled).filter("id = 'a'").orderBy("item_index").collect()]
    assert e == [("Acme Inc", ["Organization"], ["Acme"]), ("Tool", ["Concept"], []), ("Ann", ["Person"], [])]
    c = {r.item_index: r for r in drafts.accepted_claims(compiled).filter("id = 'a'").collect()}
    assert (c[1].predicate, c[1].temporal_signal) == ("has_ceo", None) and (c[9].claim_type, c[9].polarity, c[9].modality, c[9].temporal_signal) == ("definitional", "negative", "necessary", None)
    assert json.loads(c[9].context) == {"note": "a note"} and c[12].confidence == 0.5
    got = {r.id: (r.accepted, r.rejected, r.status) for r in drafts.outcomes(compiled).collect()}
    assert got == {"a": (10, 19, "COMPLETED_WITH_WARNINGS"), "b": (0, 1, "FAILED"), "d": (0, 1, "FAILED"), "f": (0, 1, "FAILED"), "g": (0, 1, "FAILED")}


def test_quality_verdicts_and_ends(spark):
    schema = "k int, subject string, predicate string, object string, claim_type string, polarity string, modality string, temporal_signal string, context_note string, resolution_text string, subject_types array<string>, object_types array<string>, verdict string, quality_reasons array<string>"
    row = lambda k, p, s, o, v: (k, " a  b ", p, "x", None, None, None, "former", None, None, s, o, v, ["why"])
    rows = [row(0, "uses", None, None, "reject"), row(1, "uses", [], [], "review"), row(2, "implements", ["Software"], ["Person"], None), row(3, "implements", ["Software"], ["Robot"], None), row(4, "uses", ["Robot"], None, None), row(5, "improves", ["Robot"], None, None), row(6, "implements", None, ["Standard"], "accept")]
    got = {r.k: (r.status, r.reasons, r.claim and r.claim.subject) for r in drafts.compile_claims(spark.createDataFrame(rows, schema)).collect()}
    assert got == {0: ("rejected", ["quality_gate_rejected", "why"], None), 1: ("compiled", ["quality_gate_review"], "a b"), 2: ("rejected", ["domain_range_violation"], None), 3: ("rejected", ["Unsupported entity type: Robot"], None), 4: ("rejected", ["Unsupported entity type: Robot"], None), 5: ("compiled", [], "a b"), 6: ("compiled", [], "a b")}


def test_the_entity_index_takes_the_last_name_and_else_the_first_alias(spark):
    e = spark.createDataFrame([("v", 0, "A", ["T0"], ["x", "b"]), ("v", 1, "B", ["T1"], ["X"]), ("v", 2, "a ", ["T2"], []), ("v", 3, "C", ["T3"], ["x"])], "id string, item_index int, name string, types array<string>, aliases array<string>")
    assert {r.key: r.types for r in drafts.entity_index(e).collect()} == {"a": ["T2"], "b": ["T1"], "x": ["T0"], "c": ["T3"]}


def test_relations_follow_the_ladder(spark):
    e = spark.createDataFrame([("v", 0, "S", ["Software"], ["soft"]), ("v", 1, "D", ["Dataset"], []), ("v", 2, "P", ["Person"], [])], "id string, item_index int, name string, types array<string>, aliases array<string>")
    rows = [("no", "uses", "D", "positive", "asserted", "{}"), ("S", "uses", None, "positive", "asserted", "{}"), ("S", "frobs", "D", "positive", "asserted", "{}"), ("S", "improves", "D", "positive", "asserted", "{}"), ("S", "is", "D", "positive", "asserted", "{}"), ("S", "uses", "D", "negative", "asserted", "{}"), ("S", "uses", "D", "positive", "possible", "{}"), ("S", "uses", "D", "positive", "asserted", '{"metric": "f1"}'), ("S", "uses", "D", "odd", "odd", '{"metric": [], "scope": {}, "time": null}'), ("soft", "trained_on", "D", "positive", "asserted", None), ("S", "evaluated_on", "D", "positive", "asserted", "{}")]
    c = spark.createDataFrame([("v", *r, k) for k, r in enumerate(rows)], "id string, subject string, predicate string, object string, polarity string, modality string, context string, k int")
    got = [(r.outcome, r.reason) for r in drafts.relation_candidates(c, e).orderBy("k").collect()]
    assert [g[0] for g in got] == ["REJECTED", "CLAIM_ONLY", "REJECTED", "CLAIM_ONLY", "CLAIM_ONLY", "CONDITIONAL_RELATION", "CONDITIONAL_RELATION", "CONDITIONAL_RELATION", "DIRECT_RELATION", "CLAIM_ONLY", "DIRECT_RELATION"]
    assert got[3][1] == "predicate_is_claim_only" and got[4][1] == "no_relation_predicate_mapping" and got[7][1] == "material_context_requires_claim_only" and got[9][1] == "source_target_types_not_allowed"


def test_draft_scores(spark):
    draft = {"entities": [{"name": "Acme", "types": ["organization"]}, {"name": "Ann", "types": ["Person", "Robot"]}, {"name": "Q", "types": ["Robot"]}], "claims": [claim(predicate="new_ceo", object="Ann", evidence_quote="Ann  leads"), claim(predicate="frobs"), claim(predicate="uses", object="ANN", evidence_quote="absent")]}
    rows = [("a", "Now ann leads Acme", json.dumps(draft), json.dumps([{"name": "acme", "types": ["Organization"]}, {"name": "Ann", "types": ["Person", "Concept"]}, {"name": "Bob", "types": []}]), json.dumps([{"subject": "ACME", "predicate": "has_ceo", "object": "ann"}, {"subject": "x", "predicate": "uses", "object": "y"}])), ("b", None, "{}", "[]", "[]")]
    df = spark.createDataFrame(rows, "id string, source_text string, model_draft string, expected_entities string, expected_claims string")
    per = {r.id: r for r in drafts.draft_report(df, per_case=True).collect()}
    assert [per["a"][k] for k in drafts.COUNTS] == [1, 1, 2, 1, 1, 1, 2, 1, 0, 2] and [per["b"][k] for k in drafts.COUNTS] == [0] * 10
    assert (per["b"].entity_precision, per["b"].evidence_accuracy, per["b"].ontology_violation_rate) == (0.0, 1.0, 0.0)
    whole = drafts.draft_report(df).first()
    assert (whole.cases, whole.entity_precision, whole.entity_recall, whole.claim_recall, whole.evidence_accuracy) == (2, 0.5, 1 / 3, 0.5, 0.5)


def test_plans_read_each_item_once_and_broadcast_nothing(spark, tmp_path):
    """What made the draft queries slow or fail on larger tables: expressions written out at each use, parts per case guessed small, one task a file."""
    from lodestone.plans import drafts as plans

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    compiled = drafts.compile_items(plans._envelopes(spark, "/root/testdata/sf0.001")).select("id", "section", "status")
    assert len(plan(compiled)) < 250_000  # 405,940 characters before, for all columns
    spark.range(20).selectExpr("id as event_id", "id % 3 as user_id", "'view' as event_type").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    assert plans._envelopes(spark, str(tmp_path)).rdd.getNumPartitions() >= 4
    report = drafts.draft_report(plans._cases(spark, "/root/testdata/sf0.001"), per_case=True)
    physical = report._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in physical and "BroadcastExchange" not in physical


def test_relations_of_envelopes_read_entities_and_claims_once(spark):
    """The same rows as from what compile_items accepts, entities that only the schema refuses among them; no other section is compiled."""
    from lodestone.plans import drafts as plans

    more = ENVELOPE | {"claims": [*ENVELOPE["claims"], claim(subject="Y"), claim(subject="acme", object="TOOL"), claim(subject="acme inc", context={"scope": "x"})]}
    envelopes = spark.createDataFrame([("a", json.dumps(more)), ("b", "not json"), ("c", None), ("f", json.dumps({"claims": [claim()]}))], "id string, body string")
    every = drafts.compile_items(envelopes)
    want = drafts.relation_candidates(drafts.accepted_claims(every), drafts.accepted_entities(every)).select("id", "item_index", "predicate", "context", "outcome", "reason")
    got = drafts.envelope_relations(envelopes).select(*want.columns)
    assert sorted(got.collect()) == sorted(want.collect()) and {"REJECTED", "DIRECT_RELATION", "CONDITIONAL_RELATION"} <= {r.outcome for r in got.collect()}
    plan = plans.draft_relations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2  # 5 for the claims alone before
