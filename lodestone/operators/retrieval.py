"""Lexical, vector and hybrid retrieval, and what surrounds it."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry
from ..functions.text import cosine


def grams_of(query: str, most: int = registry.MAX_QUERY_GRAMS) -> list[str]:
    """Distinct lower-case trigrams of a query in order."""
    s = " ".join(query.split()).replace('"', "").replace("'", "").lower()
    return list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2)))[:most]


def _hits(text: Column, grams: list[str]) -> Column:
    """The grams at every place of a text, overlapping ones too, in one pass."""
    return F.regexp_extract_all(text, F.lit("(?=(" + "|".join(re.sub("([^A-Za-z0-9 ])", r"\\\1", g) for g in grams) + "))"), F.lit(1))


def _trigrams(*texts: str) -> Column:
    """How many trigrams the texts have."""
    return sum((F.greatest(F.length(F.coalesce(c, F.lit(""))) - 2, F.lit(0)) for c in texts[1:]), F.greatest(F.length(F.coalesce(texts[0], F.lit(""))) - 2, F.lit(0)))


def gram_counts(docs: DataFrame, grams: list[str]) -> DataFrame:
    """id, len (trigrams of title and content), gram and n: how often each gram that a document holds occurs in it. One pass, summed in each task before the shuffle."""
    hits = F.concat(*[_hits(F.lower(F.coalesce(c, F.lit(""))), grams) for c in ("title", "content")])
    found = docs.select("id", _trigrams("title", "content").alias("len"), F.explode(hits).alias("gram"))
    return found.groupBy("id", "len", "gram").agg(F.count("*").alias("n"))


def bm25(docs: DataFrame, grams: list[str], limit: int) -> DataFrame:
    """id and score (lower is better) of the best documents under trigram BM25 over title and content.

    Document frequencies, a row a gram, and the number of documents and their mean length, one row, are broadcast.
    """
    counts = gram_counts(docs, grams)
    held = counts.groupBy("gram").agg(F.count("*").alias("d"))
    sizes = docs.agg(F.count("*").alias("docs"), F.avg(_trigrams("title", "content")).alias("av"))
    both = counts.join(F.broadcast(held), "gram").crossJoin(F.broadcast(sizes))
    k1, b = registry.BM25_K1, registry.BM25_B
    idf = F.greatest(F.log((F.col("docs") - F.col("d") + 0.5) / (F.col("d") + 0.5)), F.lit(registry.BM25_IDF_FLOOR))
    part = idf * F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("len") / F.col("av")))
    return both.groupBy("id").agg(F.round(-F.sum(part), 6).alias("score")).orderBy("score", "id").limit(limit)


def contains_any_term(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Documents whose title or content holds a term, letter case aside; terms are literal."""
    low = F.lower(F.concat_ws("\n", "title", "content"))
    return docs.filter(reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in terms]))


def lexical(docs: DataFrame, query: str, limit: int) -> DataFrame:
    """BM25; where no document has a gram of the query, the substring search, with score 0."""
    cap, grams = min(limit, registry.MAX_SEARCH_RESULTS), grams_of(query)
    terms = query.split()
    found = bm25(docs, grams, cap) if grams else None
    if not terms:
        return found
    fallback = contains_any_term(docs, terms).select("id", F.lit(0.0).alias("score")).orderBy("id").limit(cap)
    if found is None:
        return fallback
    none = F.broadcast(gram_counts(docs, grams).agg(F.count("*").alias("met")).filter("met = 0").drop("met"))  # one row or no row
    missed = contains_any_term(docs.crossJoin(none), terms).select("id", F.lit(0.0).alias("score")).orderBy("id").limit(cap)
    return found.unionByName(missed)


def vector_top(vectors: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """id and cosine of the ``k`` vectors nearest to the one query row (column q); the query's own row counts."""
    scored = vectors.crossJoin(F.broadcast(query))  # one row
    return scored.select("id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def ranked(found: DataFrame, *order) -> DataFrame:
    """A result list with its 1-based rank; lists are bounded by their limit."""
    return found.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank_fusion(lists: list[DataFrame], limit: int, constant: int = registry.RRF_CONSTANT) -> DataFrame:
    """id and score of ranked lists (id, rank) fused."""
    both = reduce(DataFrame.unionByName, [x.select("id", "rank") for x in lists])
    return both.groupBy("id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)


def top_chunks(chunk_rows: DataFrame, terms: list[str], per_document: int = 3) -> DataFrame:
    """Chunks of each document by number of terms hit; those without a hit only where a document has none."""
    low = F.lower("content")
    hits = reduce(lambda a, b: a + b, [low.contains(t.lower()).cast("int") for t in terms])
    doc = Window.partitionBy("document_id")
    out = chunk_rows.withColumn("hits", hits).withColumn("most", F.max("hits").over(doc)).filter((F.col("hits") > 0) | (F.col("most") == 0))
    out = out.withColumn("rn", F.row_number().over(doc.orderBy(F.col("hits").desc(), "chunk_index")))
    return out.filter(F.col("rn") <= per_document).drop("most")


def matched_in(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Which fields of each document hold a term."""
    has = lambda c: reduce(lambda a, b: a | b, [F.lower(c).contains(t.lower()) for t in terms])
    return docs.select("id", F.array_join(F.array_compact(F.array(F.when(has("title"), "title"), F.when(has("content"), "content"))), ",").alias("matched"))


def knowledge(claims: DataFrame, names: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Statements that mention a term: relevance is the number of terms in names, predicate and object; the best claim of each statement, states current before candidate before history, then by relevance."""
    named = with_names(claims, names)
    text = F.lower(F.concat_ws(" ", "subject_name", "predicate", "object_name", "object_text"))
    relevance = reduce(lambda a, b: a + b, [text.contains(t.lower()).cast("int") for t in terms])
    state = F.when(F.col("status") == "superseded", 3).when(F.col("status") == "candidate", 2).otherwise(1)
    named = named.filter(F.col("status") != "rejected").withColumn("relevance", relevance).filter("relevance > 0").withColumn("state", state)
    w = Window.partitionBy("subject_id", "predicate", F.coalesce("object_id", F.lower("object_text")))
    best = named.withColumn("members", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("state", F.col("relevance").desc(), F.col("confidence").desc(), "id"))).filter("rn = 1")
    return best.orderBy("state", F.col("relevance").desc(), F.col("confidence").desc(), "id").limit(limit).select("id", "subject_name", "predicate", F.coalesce("object_name", "object_text").alias("object"), "state", "relevance", "members")


def with_names(claims: DataFrame, names: DataFrame) -> DataFrame:
    """Claims with subject_name (inner) and object_name (may be missing)."""
    s = names.select(F.col("id").alias("subject_id"), F.col("name").alias("subject_name"))
    o = names.select(F.col("id").alias("object_id"), F.col("name").alias("object_name"))
    return claims.join(s, "subject_id").join(o, "object_id", "left")
