"""Operators against small fixtures and plain Python."""

import difflib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.udfs import chunk_spans
from lodestone.functions import text as tx
from lodestone.functions import udfs
from lodestone.operators import classify, context, evaluate, graph, lifecycle, reads, resolve, retrieval, storage


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 1799, 1800, 1801, 5000])
def test_chunks_cover_the_text(n):
    draw = random.Random(n)
    text = "".join(draw.choice("abcde \n😀") for _ in range(n))
    spans = chunk_spans(text)
    covered = set()
    for a, b in spans:
        assert 0 < b - a <= 1800
        covered |= set(range(a, b))
    assert covered == set(range(n))


def test_chunk_boundary_only_in_the_second_half():
    assert chunk_spans("a" * 900 + " " + "b" * 2000)[0] == (0, 1800)
    assert chunk_spans("a" * 901 + " " + "b" * 2000)[0] == (0, 902)


def test_diff_null_hash_is_changed(spark):
    s = spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 3, "z")], "document_id long, chunk_index int, content_hash string")
    t = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "document_id long, chunk_index int, content_hash string")
    assert [r[2] for r in rows(storage.diff_chunks(s, t))] == ["unchanged", "changed", "created", "removed"]


def test_query_grams():
    assert retrieval.grams_of("ab") == []
    assert retrieval.grams_of("ababab") == ["aba", "bab"]
    assert len(retrieval.grams_of("".join(chr(97 + i % 26) * 1 + str(i) for i in range(200)))) == 32


def test_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, rank int")
    assert [r["id"] for r in retrieval.reciprocal_rank_fusion([a, b], 3).collect()] == [2, 1, 3]


def claims(spark, data):
    return spark.createDataFrame(data, "id long, subject_id string, predicate string, object_id string, object_text string, polarity string, status string, created_at long, confidence double")


def test_verdicts(spark):
    c = claims(spark, [(1, "s", "is", None, "X", "positive", "verified", 1, 0.5), (2, "s", "is", None, " x ", "positive", "verified", 2, 0.5), (3, "s", "is", None, "x", "negative", "verified", 3, 0.5), (4, "s", "is", None, "y", "positive", "verified", 4, 0.5), (5, "s", "is", None, None, "positive", "verified", 5, 0.5)])
    v = {(r[0], r[1]): r[2] for r in lifecycle.related_verdicts(c).collect()}
    assert v == {(2, 1): "duplicate", (3, 1): "contradicts", (3, 2): "contradicts", (4, 1): "contradicts", (4, 2): "contradicts", (4, 3): "contradicts"}


def test_conflict_groups_count_what_pairs_list(spark):
    draw = random.Random(2)
    data = [(i, "s", "p", None, draw.choice("ab"), draw.choice(["positive", "negative"]), "verified", i, 0.5) for i in range(40)]
    c = claims(spark, data)
    assert lifecycle.conflict_groups(c).first()["opposed"] == lifecycle.conflict_pairs(c).count()


def test_coverage(spark):
    c = claims(spark, [(1, "s", "p", None, "x", "positive", "superseded", 1, 0.5), (2, "s", "p", None, "y", "positive", "verified", 2, 0.5), (3, "s", "q", None, "y", "positive", "superseded", 2, 0.5)])
    assert [r[0] for r in rows(lifecycle.current(c).select("id"))] == [2, 3]


def test_chain_with_fork_and_cycle(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (20, 21), (21, 20)], "source_id long, target_id long")
    assert rows(lifecycle.supersede_chains(e)) == [(5, 2, 3), (5, 3, 2), (5, 4, 1), (9, 8, 1)]


def test_long_chain_and_loops(spark):
    chain = [(k + 1, k) for k in range(150)]
    loops = [(500, 501), (501, 502), (502, 501), (600, 601), (601, 600), (700, 701), (700, 702), (701, 703), (702, 703), (703, 704)]
    e = spark.createDataFrame(chain + loops, "source_id long, target_id long")
    want = [(150, k, 150 - k) for k in range(150)] + [(500, 501, 1), (500, 502, 2), (700, 701, 1), (700, 703, 2), (700, 704, 3)]  # the first edge of 700 is to 701
    assert rows(lifecycle.supersede_chains(e)) == sorted(want)
    assert rows(lifecycle.supersede_cycles(e)) == [(501,), (502,), (600,), (601,)]


def test_neighbourhood(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("a", "a")], "source_id string, target_id string")
    assert rows(graph.neighborhood(e, "a", 3)) == [("b", 1), ("c", 2), ("d", 3)]


def test_allocation_skips_and_goes_on(spark):
    items = spark.createDataFrame([(1, 1, 50, False, 9.0), (1, 2, 80, False, 8.0), (1, 3, 40, False, 7.0), (1, 4, 30, True, 0.0)], "context_id long, id long, tokens long, required boolean, utility double")
    assert rows(context.allocate(items, 120).select("id")) == [(1,), (3,), (4,)]


def test_classifiers(spark):
    t = spark.createDataFrame([("C:\\x",), ("A / B",), ("12 tokens",), ("snake_case",), ("plain",), ("",)], "t string")
    assert [r[0] for r in t.select(classify.object_class(F.col("t"), F.lit(False))).collect()] == ["literal", "unknown", "literal", "entity", "unknown", "unknown"]
    a = spark.createDataFrame([("",), ("no evidence here",), ("I cannot answer",), ("It is so [doc:a chunk:b]",), ("yes",)], "a string")
    assert [r[0] for r in a.select(classify.refusal(F.col("a"), F.lit(0))).collect()] == ["unknown", "insufficient_evidence", "refusal", "non_refusal", "non_refusal"]


def test_fuzzy(spark):
    e = spark.createDataFrame([("1", "T", "Apple Inc."), ("2", "T", "Apple Ltd"), ("3", "T", "Pear Works"), ("4", "U", "Apple")], "id string, type string, name string")
    assert rows(resolve.fuzzy_pairs(e)) == [("1", "2", 1.0)]
    assert rows(resolve.contained_pairs(e)) == [("1", "2")]


@pytest.mark.parametrize("threshold", [0.65, 0.9])
def test_fuzzy_finds_every_pair(spark, threshold):
    draw = random.Random(5)
    names = ["Microsoft", "Microsft", "micro", "Acme", "Acme International Holdings", "The New York Times", "York Times", "a", "ab", "苹果", "苹果公司", "", "acme inc", "night", "thing"]
    names += ["".join(draw.choices("abc de", k=draw.randint(1, 9))) for _ in range(60)]
    e = spark.createDataFrame([(f"{k:03}", "TU"[k > 60], n) for k, n in enumerate(names)], "id string, type string, name string")
    loose = [(r["id"], r["type"], r["k"]) for r in e.select("id", "type", resolve.loose_name(F.col("name")).alias("k")).collect()]
    want = []
    for (i, s, x), (j, t, y) in itertools.combinations(sorted(loose), 2):
        if s == t and x and y:
            r = 1.0 if x in y or y in x else difflib.SequenceMatcher(None, x, y).ratio()
            want += [(i, j, round(r, 6))] * (r >= threshold)
    assert rows(resolve.fuzzy_pairs(e, threshold)) == want and {("000", "002", 1.0), ("003", "004", 1.0), ("005", "006", 1.0)} <= set(want)


def test_longest_name_of_any_length_and_characters(spark):
    names = ["University", "The Royal Society of Arts and Letters of Upper Canada", "R&D", "C++", "C", "node.js", "Acme, Inc", "D", "++", "", None]
    asked = ["who founded the royal society of arts and letters of upper canada university?", "what is the R&D budget", "is C++ fast", "is c fast", "uses Node.js now", "was Acme,  Inc sold", "R or D", "a ++ b", "", None]
    e = spark.createDataFrame([(str(k), n) for k, n in enumerate(names)], "id string, name string")
    q = spark.createDataFrame(list(enumerate(asked)), "id long, question string")
    assert rows(resolve.longest_contained(q, e)) == [(0, names[1]), (1, "R&D"), (2, "C++"), (3, "C"), (4, "node.js"), (5, "Acme, Inc"), (6, "D"), (7, "++")]


def test_retrieval_metrics(spark):
    c = spark.createDataFrame([("a", [1, 2], [1, 3, 2]), ("b", [9], [1, 2]), ("c", [], [])], "id string, relevant array<int>, retrieved array<int>")
    r = evaluate.retrieval_report(c, 2).first()
    assert (r["recall"], r["precision"], r["mrr"]) == (0.3333, 0.25, 0.3333)


def test_grams_are_counted_at_every_place(spark):
    docs = spark.createDataFrame([(1, "aaaa", "x.y.x.y aaa"), (2, None, None), (3, "AAa", "")], "id long, title string, content string")
    got = rows(retrieval.gram_counts(docs, ["aaa", ".y.", "x.y"]).select("id", "len", "gram", "n"))
    assert got == [(1, 11, ".y.", 1), (1, 11, "aaa", 3), (1, 11, "x.y", 2), (3, 1, "aaa", 1)]


def test_lexical_falls_back_only_without_hits(spark):
    docs = spark.createDataFrame([(1, "t", "alpha beta"), (2, "ab", "x")], "id long, title string, content string")
    assert rows(retrieval.lexical(docs, "alpha", 5).select("id")) == [(1,)]
    assert rows(retrieval.lexical(docs, "ab zq", 5).select("id", "score")) == [(2, 0.0)]


def test_token_truncation_is_the_longest_that_fits(spark):
    draw = random.Random(2)
    texts = ["".join(draw.choices("ab \n你カ한", k=draw.randint(0, 40))) for _ in range(60)]
    wide = lambda c: "\u3000" <= c <= "\u30ff" or "\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff" or "\uff00" <= c <= "\uffef"
    cost = lambda t: sum(map(wide, t)) + -(-(len(t) - sum(map(wide, t))) // 4)
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", tx.truncate_to_tokens(F.col("t"), 4).alias("c"), tx.estimate_tokens(F.col("t")).alias("n")).collect():
        t = texts[r["id"]]
        assert r["n"] == cost(t)
        want = t
        if cost(t) > 4:
            want = t[: max(k for k in range(len(t) + 1) if cost(t[:k]) <= 4)]
            if want.rfind("\n") > len(want) // 2:
                want = want[: want.rfind("\n")]
            want = want.rstrip()
        assert r["c"] == want, t


def test_text_nodes_are_all_kept():
    assert udfs._text_nodes("<p>a</p> <script>x</script>\n<b>c</b>") == "a\n \nx\n\n\nc"


def test_fuzzy_pairs_scores_a_name_once(spark):
    """Entities of one name: their pairs come from one comparison of names, whose order is that of the ids."""
    from difflib import SequenceMatcher

    words = ("tide", "diet", "tied red", "red tide")
    e = spark.createDataFrame([(f"{k:03d}", "T", words[k % 4]) for k in range(60)], "id string, type string, name string")
    ratio = lambda a, b: 1.0 if a in b or b in a else round(SequenceMatcher(None, a, b).ratio(), 6)
    want = [(f"{a:03d}", f"{b:03d}", ratio(words[a % 4], words[b % 4])) for a in range(60) for b in range(a + 1, 60) if ratio(words[a % 4], words[b % 4]) >= 0.5]
    df = resolve.fuzzy_pairs(e, 0.5)
    assert sorted(map(tuple, df.collect())) == want
    alike = resolve._alike(e.filter("id < '004'").select("id", "type", F.col("name").alias("k"), F.length("name").alias("l")), 0.5)
    assert alike.count() <= 4 * 3


_AS_ONE = lambda x, y: F.when(x % 2 == 0, x).otherwise(y)


def _closest(spark, data, limit=15, decided=lambda p: p.filter((F.col("a_id") + F.col("b_id")) % 5 == 0).select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))):
    t = spark.createDataFrame(data, "g long, id long, value double")
    return [tuple(r) for r in reads.closest_undecided(t, ["g"], _AS_ONE, decided, limit).collect()]


def _every_pair(data, limit=15):
    out = []
    for k, (g, x, v) in enumerate(data):
        for h, y, w in data[:k]:
            lo, hi = min(x, y), max(x, y)
            if g is not None and g == h and lo < hi and (x + y) % 5:
                out.append((-round(1 / (1 + abs(v - w)), 6) if None not in (v, w) else 1, *((lo, hi) if lo % 2 == 0 else (hi, lo))))
    return [(a, b, -s if s <= 0 else None) for s, a, b in sorted(out)[:limit]]


def test_closest_undecided(spark):
    rng = random.Random(5)
    some = [(rng.choice([1, 2, None]), i, rng.choice([rng.uniform(-9, 9), rng.randrange(3) / 100, 1e6 * rng.random()])) for i in range(300)]
    alike = [(1, i, 5.0) for i in range(0, 1500, 5)] + [(1, i, 6.0 + i * i) for i in range(1, 40, 3)]  # what is closest is decided
    copies = [(i % 2, i, float(i % 7)) for i in range(200)]
    nulls = [(1, i, None if i % 3 else float(i)) for i in range(12)]
    for data in (some, alike, copies, nulls, some[:3], [(1, 1, 2.0)]):
        assert _closest(spark, data) == _every_pair(data)
    odd = [(1, 1, float("nan")), (1, 2, 1.0), (1, 5, 1.0), (1, 6, 9.0)]
    assert [r[:2] for r in _closest(spark, odd, 9)] == [(2, 1), (5, 1), (6, 1), (2, 5), (2, 6), (6, 5)]


def test_closest_undecided_of_a_large_group(spark):
    """100,000 rows of one group have 5 * 10^9 pairs; those that count are few."""
    data = [(1, i, i * 3.0) for i in range(100_000)] + [(1, 200_000 + i, 3000.0 * i + 0.25) for i in range(1, 21)]
    want = _every_pair([r for r in data if r[2] % 3000 < 1], 10)
    assert _closest(spark, data, 10) == want and want[0][2] == 0.8


def test_contained_pairs_of_one_name_meet_in_blocks(spark, monkeypatch):
    """Names of several blocks, an id of two names, repeated rows; pairs come once each and in tasks of few."""
    monkeypatch.setattr(resolve, "BLOCK", 7)
    monkeypatch.setattr(resolve, "PAIRS", 50)
    names = ["red", "red box", "red box", "red box lid", "blue box", "Red  Box"]
    data = [(f"p:{i}", "T" if i % 9 else "U", names[i * i % 6]) for i in range(90)] + [("p:1", "T", "red box lid"), ("p:2", "T", names[4]), ("p:2", "T", names[4]), ("x", "T", None)]
    found = resolve.contained_pairs(spark.createDataFrame(data, "id string, type string, name string"))
    assert found.rdd.getNumPartitions() > 16
    words = lambda s: s.lower().split()
    want = {(a, b) for (a, t, x), (b, u, y) in itertools.product([d for d in data if d[2]], repeat=2) if a != b and t == u and words(y)[: len(words(x))] == words(x) and (len(words(x)) < len(words(y)) or a < b)}
    assert rows(found) == sorted(want)


def test_fuzzy_pairs_of_one_name_meet_in_blocks(spark, monkeypatch):
    """Pairs of entities come block by block in tasks of few, none is shuffled; names in both orders, an id of two names and repeated rows as before."""
    from difflib import SequenceMatcher

    monkeypatch.setattr(resolve, "BLOCK", 7)
    monkeypatch.setattr(resolve, "PAIRS", 50)
    names = ["tide", "diet", "tied red", "red tide"]
    data = [(f"p:{i}", "T" if i % 9 else "U", names[i * i % 4 if i % 2 else i % 3]) for i in range(60)] + [("p:1", "T", "diet"), ("p:2", "T", names[2]), ("x", "T", None), (None, "T", "tide")]
    found = resolve.fuzzy_pairs(spark.createDataFrame(data, "id string, type string, name string"), 0.5)
    assert found.rdd.getNumPartitions() > 16
    ratio = lambda a, b: 1.0 if a in b or b in a else round(SequenceMatcher(None, a, b).ratio(), 6)
    want = [(a, b, ratio(x, y)) for (a, t, x), (b, u, y) in itertools.product([d for d in data if d[0] and d[2]], repeat=2) if a < b and t == u and ratio(x, y) >= 0.5]
    assert rows(found) == sorted(want)


def test_names_of_one_file_are_folded_on_all_cores(spark, monkeypatch):
    """A table of small rows is one task as it is read; what contained_pairs makes of its names is many."""
    tasks = {}
    monkeypatch.setattr(resolve, "staged", lambda df, name: tasks.setdefault(name, df.rdd.getNumPartitions()) and df)
    names = spark.range(40).selectExpr("concat('p:', id) as id", "'T' as type", "concat('red box', id % 3) as name").coalesce(1)
    resolve.contained_pairs(names)
    assert tasks["members"] == 4 * spark.sparkContext.defaultParallelism
