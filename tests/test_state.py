"""Folds and closures against plain loops: operation log, merges, budget trim, evidence dedup, rolling conversations."""

import datetime
import difflib
import random

import pytest
from pyspark.sql import functions as F

from lodestone import registry
from lodestone.operators import context, folds, lifecycle, merges, oplog
from lodestone.streaming import conversations

T0 = datetime.datetime(2024, 1, 1)


def plain_log(claims, relations, ops):
    """One operation after the other over dictionaries."""
    status, ok = {c[0]: c[1] for c in claims}, {c[0]: c[2] for c in claims}
    rel = {r[0]: list(r[1:]) for r in relations}  # source, target, relationship, status, previous
    audit = {}

    def link(op, source, target, kind, state):
        if any(r[:3] == [source, target, kind] for r in rel.values()):
            return None
        rel[op] = [source, target, kind, state, None]
        return op

    for op, _, kind, claim, new, old, relation, st, relationship, sup in sorted(ops, key=lambda o: (o[1], o[0])):
        done = True
        if kind == "CREATE":
            done = new not in status
            if done:
                status[new] = "candidate"
        elif kind in ("ARCHIVE", "RESTORE"):
            done = claim in status and (kind == "ARCHIVE" or (st or "candidate") in registry.KNOWLEDGE_STATUSES)
            if done:
                status[claim] = "archived" if kind == "ARCHIVE" else st or "candidate"
        elif kind == "ACCEPT":
            done = status.get(claim) == "candidate" and bool(ok.get(claim))
            if done:
                status[claim] = st or "verified"
        elif kind in ("SUPERSEDE", "MERGE", "DUPLICATE", "CONTRADICT"):
            done = new in status and old in status and not (kind == "MERGE" and new == old)
            if done:
                name, state = {"SUPERSEDE": ("supersedes", "accepted"), "MERGE": ("duplicate", "accepted"), "DUPLICATE": ("duplicate", "accepted"), "CONTRADICT": ("contradicts", "candidate")}[kind]
                made = link(op, new, old, name, state)
                if kind == "SUPERSEDE":
                    if made:
                        rel[made][4] = status[old]
                    status[old] = "superseded"
                if kind == "MERGE":
                    status[old] = "archived"
        elif kind == "RELATION_RESOLVE":
            done = relation in rel and st in ("accepted", "rejected", "candidate") and (relationship is None or relationship in registry.RELATIONSHIPS)
            if done:
                r = rel[relation]
                r[3], r[2] = st, relationship or r[2]
                if relationship == "supersedes" and st == "accepted":
                    r[4] = status[r[1]]
                    status[r[1]] = "superseded"
                elif r[4] and status[r[1]] == "superseded":
                    status[r[1]] = r[4]
        else:
            done = False
        audit[op] = "applied" if done else "refused"
    return status, rel, audit


def test_the_operation_log_against_a_plain_fold(spark):
    for seed in (1, 2, 3):
        draw = random.Random(seed)
        claims = [(f"c{k}", draw.choice(registry.KNOWLEDGE_STATUSES), draw.random() < 0.5) for k in range(12)]
        relations = [(f"r{k}", f"c{k}", f"c{(k * 5 + 1) % 12}", draw.choice(["supersedes", "contradicts"]), "candidate", draw.choice([None, "verified"])) for k in range(6)]
        some = lambda: f"c{draw.randint(0, 15)}"
        ops = []
        for k in range(160):
            kind = draw.choice(["CREATE", "ARCHIVE", "RESTORE", "ACCEPT", "SUPERSEDE", "SUPERSEDE", "MERGE", "DUPLICATE", "CONTRADICT", "RELATION_RESOLVE", "RELATION_RESOLVE", "RELATION_RESOLVE", "BOGUS"])
            relation = draw.choice([f"r{draw.randint(0, 7)}", f"op{draw.randint(0, k):03d}"]) if kind == "RELATION_RESOLVE" else None
            status = draw.choice(["accepted", "rejected", "candidate", "odd"]) if kind == "RELATION_RESOLVE" else draw.choice([None, "verified", "odd"]) if kind == "RESTORE" else None
            new = f"c{draw.randint(12, 15)}" if kind == "CREATE" else some()
            ops.append((f"op{k:03d}", T0 + datetime.timedelta(minutes=draw.randint(0, 60)), kind, some(), new, some(), relation, status, draw.choice([None, "supersedes", "coexists"]) if kind == "RELATION_RESOLVE" else None, None))
        got = oplog.applied(
            spark.createDataFrame(claims, "id string, status string, acceptable boolean"), spark.createDataFrame(relations, "id string, source_id string, target_id string, relationship string, status string, previous string"), spark.createDataFrame(draw.sample(ops, len(ops)), oplog.OPERATION)
        ).collect()
        status, rel, audit = plain_log(claims, relations, ops)
        assert {r.id: r.status for r in got if r.kind == "claim"} == status
        assert {r.id: [r.source_id, r.target_id, r.relationship, r.status, r.previous] for r in got if r.kind == "relation"} == rel
        assert {r.id: r.status for r in got if r.kind == "operation"} == audit
        assert all((r.message is None) == (r.status == "applied") for r in got if r.kind == "operation")


def test_corrections_create_link_and_supersede(spark):
    claims = spark.createDataFrame([("a", "verified", False)], "id string, status string, acceptable boolean")
    none = spark.createDataFrame([], "id string, source_id string, target_id string, relationship string, status string, previous string")
    op = lambda k, kind, new, old, relation=None, status=None, relationship=None, sup=None: (k, T0, kind, None, new, old, relation, status, relationship, sup)
    ops = [op("1", "CORRECT", "n1", "a", relationship="supersedes", sup=True), op("2", "CORRECT", "n2", None), op("3", "CORRECT", "n3", "nowhere", relationship="coexists"), op("4", "RELATION_RESOLVE", None, None, "1", "rejected"), op("5", "CORRECT", "n4", "n1", relationship="coexists")]
    got = oplog.applied(claims, none, spark.createDataFrame(ops, oplog.OPERATION)).collect()
    assert {r.id: r.status for r in got if r.kind == "claim"} == {"a": "verified", "n1": "candidate", "n2": "candidate", "n4": "candidate"}
    assert sorted((r.id, r.source_id, r.target_id, r.relationship, r.status, r.previous) for r in got if r.kind == "relation") == [("1", "n1", "a", "supersedes", "rejected", "verified"), ("5", "n4", "n1", "coexists", "accepted", None)]
    assert {r.id: r.status for r in got if r.kind == "operation"} == {"1": "applied", "2": "applied", "3": "refused", "4": "applied", "5": "applied"}


def test_merges_follow_chains_and_loops_in_time(spark):
    for seed in range(3):
        draw = random.Random(seed)
        names = [f"e{k}" for k in range(20)]
        log = [(draw.choice(names), draw.choice(names), T0 + datetime.timedelta(seconds=draw.randint(0, 50)), k) for k in range(40)]
        holds = {n: {n} for n in names}
        for keep, drop, *_ in sorted((m for m in log if m[0] != m[1]), key=lambda m: (m[2], m[3])):
            holds[keep] |= holds[drop]
            holds[drop] = set()
        at = {own: n for n, held in holds.items() for own in held}
        got = {r.id: r.keep_id for r in merges.destinations(spark.createDataFrame(log, "keep_id string, drop_id string, at timestamp, merge_id long")).collect()}
        assert got == {d: at[d] for d in {m[1] for m in log if m[0] != m[1]}}


def test_a_long_chain_of_merges(spark):
    log = [(f"e{k + 1}", f"e{k}", T0 + datetime.timedelta(seconds=k), k) for k in range(300)]
    got = merges.destinations(spark.createDataFrame(log, "keep_id string, drop_id string, at timestamp, merge_id long"))
    assert got.filter("keep_id = 'e300'").count() == 300


def test_merging_repoints_names_and_rechecks(spark):
    claims = spark.createDataFrame([(1, "a", "is", None, "X", "positive", "verified"), (2, "b", "is", None, "Y", "positive", "verified"), (3, "z", "uses", "b", None, "positive", "verified"), (4, "q", "is", None, "1", "positive", "verified"), (5, "q", "is", None, "2", "positive", "verified")], "id long, subject_id string, predicate string, object_id string, object_text string, polarity string, status string")
    relations = spark.createDataFrame([("b", "uses", "a"), ("c", "uses", "z")], "source_id string, predicate string, target_id string")
    entities = spark.createDataFrame([("a", "A", ["one"], "confirmed"), ("b", "B", ["two", "one"], "confirmed"), ("c", "C", None, "candidate"), ("z", "Z", [], "candidate")], "id string, name string, aliases array<string>, status string")
    log = spark.createDataFrame([("b", "c", T0, 1), ("a", "b", T0 + datetime.timedelta(1), 2)], "keep_id string, drop_id string, at timestamp, merge_id long")
    after, rels, names, conflicts = merges.merge_all(claims, relations, entities, log)
    assert sorted((r.id, r.subject_id, r.object_id) for r in after.collect()) == [(1, "a", None), (2, "a", None), (3, "z", "a"), (4, "q", None), (5, "q", None)]
    assert sorted(tuple(r) for r in rels.collect()) == [("a", "uses", "a"), ("a", "uses", "z")]
    assert {r.id: (r.name, r.aliases, r.status) for r in names.collect()} == {"a": ("A", ["A", "B", "C", "one", "two"], "confirmed"), "b": ("B（已并入 A）", [], "archived"), "c": ("C（已并入 A）", [], "archived"), "z": ("Z", [], "candidate")}
    assert [(r.subject_id, r.predicate) for r in conflicts.collect()] == [("a", "is")]  # q's own conflict was there before and isn't touched


def test_trimming_against_a_plain_loop(spark):
    draw = random.Random(5)
    rows = []
    for ctx in range(60):
        for k in range(draw.randint(1, 9)):
            content = draw.choice(["", "word " * draw.randint(1, 80), "line\n" * draw.randint(1, 60), "字" * draw.randint(1, 60)])
            rows.append((ctx, k, draw.choice([*registry.COMPRESSION_ORDER, "bootstrap", "task", "odd"]), content, conversations.tokens_of(content), 10 + 7 * ctx))
    want = {}
    for ctx in range(60):
        own = [r for r in rows if r[0] == ctx]
        now = {r[1]: ["keep", r[4], r[3]] for r in own}
        rank = lambda s: registry.COMPRESSION_ORDER.index(s) if s in registry.COMPRESSION_ORDER else 99
        for r in sorted((r for r in own if r[2] not in registry.NEVER_TRIM and r[3]), key=lambda r: (rank(r[2]), r[1])):
            over = sum(v[1] for v in now.values()) - r[5]
            if over <= 0:
                break
            keep = max(0, r[4] - over)
            if keep < r[4] * 0.25:
                now[r[1]] = ["drop", 0, ""]
            else:
                now[r[1]] = ["trim", conversations.tokens_of(conversations.cut_to_tokens(r[3], keep)), conversations.cut_to_tokens(r[3], keep)]
        want |= {(ctx, k): (v[0], v[2]) for k, v in now.items()}
    df = spark.createDataFrame(rows, "context_id int, id int, section string, content string, tokens long, budget long")
    assert {(r.context_id, r.id): (r.action, r.content) for r in context.trimmed(df).collect()} == want
    assert len({v[0] for v in want.values()}) == 3


def plain_dedup(hits, cap=2, ratio=0.85):
    taken, chunks, out = [], set(), {}
    for at, chunk, doc, quote, score in sorted(hits, key=lambda h: (h[0], h[1])):
        hit = (at, chunk, doc, score)
        if chunk in chunks:
            out[at] = "duplicate_chunk"
            continue
        key = " ".join((quote or "").split()).casefold()
        same = next((t for t in taken if key and (t[0] == key or len(key) >= 40 and len(t[0]) >= 40 and difflib.SequenceMatcher(None, t[0], key).ratio() >= ratio)), None)
        if same is None:
            taken.append([key or chunk, hit])
            chunks.add(chunk)
        elif score > same[1][3]:
            out[same[1][0]] = "duplicate_quote"
            same[1] = hit
            chunks.add(chunk)
        else:
            out[at] = "duplicate_quote"
    count = {}
    for _, (at, _, doc, _) in taken:
        count[doc] = count.get(doc, 0) + 1
        out[at] = "kept" if count[doc] <= cap else "document_cap"
    return out


def test_evidence_dedup_against_a_plain_loop(spark):
    draw, rows, want = random.Random(9), [], {}
    base = [" ".join("".join(draw.choices("abcdef", k=5)) for _ in range(12)) for _ in range(6)]
    for ctx in range(25):
        hits = []
        for at in range(30):
            quote = draw.choice([*base, "short one", "Short  one", None, ""])
            if quote and len(quote) > 40 and draw.random() < 0.7:
                cut = draw.randint(0, len(quote) - 8)
                quote = quote[:cut] + draw.choice(["x", "yy", "zzzz", ""]) + quote[cut + draw.randint(0, 8) :]
            hits.append((at, f"k{draw.randint(0, 25)}", f"d{draw.randint(0, 6)}", quote, float(draw.randint(0, 5))))
        want |= {(ctx, at): why for at, why in plain_dedup(hits).items()}
        rows += [(ctx, *h) for h in hits]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "context_id int, arrival int, chunk_id string, document_id string, quote string, score double").repartition(5)
    got = {(r.context_id, r.arrival): r.outcome for r in context.evidence_dedup(df).collect()}
    assert got == want and set(want.values()) == {"kept", "duplicate_chunk", "duplicate_quote", "document_cap"}


def messages(n=400):
    draw = random.Random(6)
    turn = {}
    rows = []
    for _ in range(n):
        conv = draw.randint(0, 5) if draw.random() < 0.9 else 6
        turn[conv] = turn.get(conv, 0) + 1
        rows.append((conv, turn[conv], draw.choice(["user", "assistant", "tool"]), draw.choice([None, "", "hello  there", "字" * 70, "w " * 150, "line\nline"])))
    return rows


MESSAGE = "conv_id long, turn int, role string, text string"


def plain_state(rows):
    out = {}
    for conv, _, role, text in sorted(rows):
        summary, recent, seen = out.get(conv, ("", [], 0))
        summary, recent = conversations.rolled(summary, recent, role, text)
        out[conv] = (summary, recent, seen + 1)
    return out


def shape(r):
    return r["summary"], [(m["role"], m["text"]) for m in r["recent"]], r["messages_seen"]


def test_rolling_state_by_hand():
    s, recent = "", []
    for k in range(1, 7):
        s, recent = conversations.rolled(s, recent, "user" if k % 2 else "assistant", f"m{k}")
    assert s == "(1 earlier messages compressed)\n- user goal: m1\n(1 earlier messages compressed)\n- last action: m2" and [t for _, t in recent] == ["m3", "m4", "m5", "m6"]
    for k in range(400):
        s, recent = conversations.rolled(s, recent, "user", f"a longer message about something {k}")
    assert conversations.tokens_of(s) <= registry.MAX_SUMMARY_TOKENS


def test_rolling_batch_is_the_plain_fold(spark):
    rows = messages()
    got = {r["conv_id"]: shape(r) for r in conversations.rolling_state(spark.createDataFrame(random.Random(1).sample(rows, len(rows)), MESSAGE).repartition(4)).collect()}
    assert got == plain_state(rows)


def test_rolling_stream_restarted_in_mid_stream_is_the_batch(spark, tmp_path):
    rows, latest = messages(), {}

    def take(batch, _):
        latest.update({r["conv_id"]: shape(r) for r in batch.collect()})

    for part in (rows[:150], rows[150:220], rows[220:]):
        spark.createDataFrame(part, MESSAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # a new query each time, from the checkpoint of the last
        stream = conversations.rolling_stream(spark.readStream.schema(MESSAGE).parquet(f"{tmp_path}/in"))
        stream.writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    assert latest == plain_state(rows)


def test_an_ordered_fold_keeps_keys_apart(spark):
    rows = [(k % 7 if k % 11 else None, k, k) for k in range(500)]
    df = spark.createDataFrame(rows, "k int, at int, v int").repartition(6)
    got = folds.ordered_fold(df, ["k"], ["at"], lambda key: [], lambda s, r: [*s[-2:], int(r.v)], lambda key, s: [(key[0], s)], "k int, last array<int>").collect()
    want = {}
    for k, _, v in rows:
        want[k] = [*want.get(k, [])[-2:], v]
    assert {r.k: r["last"] for r in got} == want and len(got) == len(want)


def test_chains_of_a_hundred_thousand(spark):
    edges = spark.range(100_000).select((F.col("id") + 1).alias("source_id"), F.col("id").alias("target_id"))
    got = lifecycle.supersede_chains(edges)
    assert got.count() == 100_000 and got.agg(F.max("depth")).first()[0] == 100_000


def test_recommended_supersessions_and_pairs(spark):
    df = spark.createDataFrame([("contradicts", True, True, None, "new"), ("contradicts", True, True, "supersedable", "former"), ("coexists", True, True, None, "new"), ("contradicts", False, True, None, "new"), ("contradicts", True, True, "fixed", "new"), ("contradicts", True, True, None, None)], "r string, f boolean, t boolean, e string, s string")
    got = df.select(lifecycle.supersede_recommended(F.col("r"), F.col("f"), F.col("t"), F.col("e"), F.col("s")).alias("x")).collect()
    assert [g.x for g in got] == [True, False, False, False, False, False]
    assert [tuple(r[0]) for r in spark.createDataFrame([("b", "a"), ("a", "b")], "x string, y string").select(lifecycle.canonical_pair(F.col("x"), F.col("y"))).collect()] == [("a", "b")] * 2
