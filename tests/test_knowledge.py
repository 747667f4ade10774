"""Knowledge and evidence behind chunks on small fixtures."""

import pytest

from lodestone.operators import knowledge


@pytest.fixture(scope="module")
def base(spark):
    chunks = spark.createDataFrame([(1, 10, 1), (2, 10, 2), (3, 30, 3), (4, 40, 4)], "chunk_id long, document_id long, rank int")
    rows = [
        (1, "a", "has_ceo", "t", None, 0.9, "superseded", 1, 10, "Tim led Apple"), (2, "a", "has_ceo", "j", None, 0.8, "verified", 1, 10, "John leads"), (3, "a", "uses", None, " Steel ", 0.7, "candidate", 1, 10, None),
        (4, "a", "uses", None, "steel", 0.6, "verified", 2, 10, " steel here "), (5, "x", "uses", None, "wood", 0.99, "verified", 1, 10, "unrelated"), (6, "x", "is", None, "red", 0.5, "rejected", 2, 10, "red"),
        (7, "x", "is", None, "blue", 0.4, "superseded", None, 30, "was blue"), (8, "x", "is", None, "green", 0.3, "verified", None, 30, "is green"), (9, "x", "likes", "a", None, 0.2, "verified", None, 30, "likes it"),
    ]
    claims = spark.createDataFrame(rows, "id long, subject_id string, predicate string, object_id string, object_text string, confidence double, status string, chunk_id long, document_id long, quote string")
    names = spark.createDataFrame([("a", "Apple"), ("t", "Tim Cook"), ("j", "John T"), ("x", "Xenon")], "id string, name string")
    aliases = spark.createDataFrame([("a", "苹果"), ("a", "AAPL")], "entity_id string, alias string")
    return chunks, claims, names, aliases


def test_one_result_a_statement_ranked_current_first(spark, base):
    none = spark.createDataFrame([(3,), (3,)], "claim_id long")
    got = [tuple(r) for r in knowledge.search(*base, none, ["CEO", "AAPL", "chief  Executive", "steel"], limit=9, per_chunk=9).collect()]
    assert [(r[0], r[4], r[5], r[7]) for r in got] == [(2, 0, 3, 1), (4, 0, 2, 2), (5, 0, 0, 1), (1, 3, 3, 1)]
    few = knowledge.search(*base, none, ["CEO"], limit=9, per_chunk=2).collect()
    assert {r.id for r in few} == {1, 2, 4}  # the two most relevant of a chunk


def test_history_and_disputes_have_their_ranks(spark, base):
    got = knowledge.search(*base, spark.createDataFrame([(2,)], "claim_id long"), ["Apple"], limit=9, per_chunk=9).collect()
    assert {r.id: r.state for r in got} == {1: 3, 2: 2, 4: 0, 5: 0}


def test_evidence_pack_takes_relevant_claims_or_a_few(base):
    chunks, claims, names, _ = base
    got = sorted(tuple(r) for r in knowledge.evidence_pack(chunks, claims, names, ["steel"]).collect())
    assert got == [(1, 3, 1), (1, 4, 1), (2, 3, 1), (2, 4, 1), (3, 8, 0), (3, 9, 0)]  # 7 is history, and 8 is current


def test_evidence_hits_prefer_the_chunks_own_claims(base):
    chunks, claims, names, _ = base
    got = {r.chunk_id: (r.claim_ids, r.quote, r.confidence) for r in knowledge.evidence_hits(chunks, claims, names, ["likes"]).collect()}
    assert got == {1: ([5, 2], "unrelated", 0.99), 2: ([4], "steel here", 0.6), 3: ([9], "likes it", 0.2), 4: ([], "", None)}
    assert {r.chunk_id: r.claim_ids for r in knowledge.evidence_hits(chunks, claims, names, ["nothing"]).collect()}[3] == [8, 9]


def test_summaries_come_in_the_evidences_order(spark, base):
    chunks, claims, names, _ = base
    entities = spark.createDataFrame([("a", "Apple", "Organization", "d" * 200), ("j", "John T", "Person", None), ("x", "Xenon", "Product", "x")], "id string, name string, type string, description string")
    hits = knowledge.evidence_hits(chunks, claims, names, ["likes"])
    got = [tuple(r) for r in knowledge.entity_summaries(hits, claims, entities, 2).orderBy("place").collect()]
    assert got == [(1, "x", "Xenon", "Product", "x"), (2, "a", "Apple", "Organization", "d" * 140)]
