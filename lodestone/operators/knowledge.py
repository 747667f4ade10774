"""Knowledge and evidence behind recalled passages: claims of chunks, by every name they have, one result a statement.

``chunks`` are a search's result (chunk_id, document_id, rank), bounded by its limit, so they are broadcast; claims
(id, subject_id, predicate, object_id, object_text, confidence, status, chunk_id, document_id, quote) are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from .lifecycle import object_key
from .predicates import DEFAULT, Predicates, lookup
from .retrieval import with_names


def keywords(predicate: Column, known: Predicates = DEFAULT) -> Column:
    """Every way a registry says a predicate: its name and its aliases."""
    table = {n: " ".join([n, *known.aliases[n]]).lower() for n in known.names if known.aliases.get(n)}
    return F.coalesce(lookup(table, predicate), fold(predicate))


def relevance(terms: list[str], *surfaces: Column) -> Column:
    """How many query terms the surfaces hold together, case and spacing aside."""
    hay = F.concat_ws(" ", *[fold(s) for s in surfaces])
    folded = [" ".join(t.split()).lower() for t in terms]
    return reduce(lambda a, b: a + b, [F.contains(hay, F.lit(t)).cast("int") for t in folded if t], F.lit(0))


def scored(claims: DataFrame, names: DataFrame, aliases: DataFrame, terms: list[str], known: Predicates = DEFAULT) -> DataFrame:
    """Claims with subject_name, object_name and relevance: names, aliases (entity_id, alias) of both ends, predicate words, object text and quote count."""
    every = aliases.groupBy("entity_id").agg(F.concat_ws(" ", F.sort_array(F.collect_set("alias"))).alias("also"))
    df = with_names(claims, names)
    for end in ("subject", "object"):
        df = df.join(every.select(F.col("entity_id").alias(f"{end}_id"), F.col("also").alias(f"_{end}")), f"{end}_id", "left")
    hay = (F.col("subject_name"), F.col("object_name"), F.col("object_text"), F.col("quote"), F.col("_subject"), F.col("_object"), keywords(F.col("predicate"), known))
    return df.withColumn("relevance", relevance(terms, *hay)).drop("_subject", "_object")


def state_rank(status: Column, disputed: Column) -> Column:
    """0 current, 1 candidate, 2 disputed, 3 historical; what is superseded is history whatever else it is."""
    return F.when(status == "superseded", 3).when(disputed, 2).when(status == "candidate", 1).otherwise(0)


def search(chunks: DataFrame, claims: DataFrame, names: DataFrame, aliases: DataFrame, disputed: DataFrame, terms: list[str], limit: int = 8, per_chunk: int = 3) -> DataFrame:
    """The statements behind recalled chunks: id, subject_name, predicate, object, state, relevance, chunk_id, members.

    Of each chunk the ``per_chunk`` most relevant claims count; of each statement the best of those stays, current
    before candidate, disputed and historical, then by relevance. History is ranked lower, never hidden; rejected claims are.
    """
    own = claims.filter("status <> 'rejected'").join(F.broadcast(chunks.select("chunk_id")), "chunk_id")
    doubt = disputed.select(F.col("claim_id").alias("id"), F.lit(True).alias("_doubt")).distinct()
    own = scored(own, names, aliases, terms).join(doubt, "id", "left")
    order = (F.col("relevance").desc(), F.col("confidence").desc(), F.col("id"))
    own = own.withColumn("_rn", F.row_number().over(Window.partitionBy("chunk_id").orderBy(*order))).filter(F.col("_rn") <= per_chunk)
    own = own.withColumn("state", state_rank(F.col("status"), F.coalesce("_doubt", F.lit(False)))).withColumn("_key", object_key())
    statement = Window.partitionBy("subject_id", "predicate", "_key")
    best = own.withColumn("members", F.count("*").over(statement)).withColumn("_rn", F.row_number().over(statement.orderBy("state", *order))).filter("_rn = 1")
    return best.orderBy("state", *order).limit(limit).select("id", "subject_name", "predicate", F.coalesce("object_name", "object_text").alias("object"), "state", "relevance", "chunk_id", "members")


def _current_within(claims: DataFrame, *group: str) -> DataFrame:
    """Of a group's claims, superseded ones go where the group has a live one of the same subject and predicate."""
    live = F.max((F.col("status") != "superseded").cast("int")).over(Window.partitionBy(*group, "subject_id", "predicate"))
    return claims.withColumn("_live", live).filter((F.col("status") != "superseded") | (F.col("_live") == 0)).drop("_live")


def _first(claims: DataFrame, group: str, n: int, *order: Column, out: str = "_rn") -> DataFrame:
    return claims.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col(out) <= n)


def evidence_pack(chunks: DataFrame, claims: DataFrame, names: DataFrame, terms: list[str], pool: int = 40, most: int = 6, least: int = 3) -> DataFrame:
    """chunk_id, claim_id, relevance: with each recalled chunk its document's claims that the question is about, the ``most`` best of its ``pool`` surest, or the ``least`` best where none is; then only what is current among them."""
    order = (F.col("relevance").desc(), F.col("confidence").desc(), F.col("id"))
    of_doc = claims.filter("status <> 'rejected'").join(F.broadcast(chunks.select("document_id").distinct()), "document_id")
    of_doc = _first(of_doc, "document_id", pool, F.col("confidence").desc(), F.col("id"))
    named = with_names(of_doc, names)
    named = named.withColumn("relevance", relevance(terms, F.col("quote"), F.col("object_text"), F.col("object_name"), F.col("subject_name"), F.col("predicate")))
    some = F.max("relevance").over(Window.partitionBy("document_id")) > 0
    named = _first(named.withColumn("_some", some), "document_id", most, *order)
    named = named.filter(F.when(F.col("_some"), F.col("relevance") > 0).otherwise(F.col("_rn") <= least))
    kept = _current_within(named, "document_id").select("document_id", F.col("id").alias("claim_id"), "relevance")
    return F.broadcast(chunks.select("chunk_id", "document_id")).join(kept, "document_id").select("chunk_id", "claim_id", "relevance")


def evidence_hits(chunks: DataFrame, claims: DataFrame, names: DataFrame, terms: list[str], per_chunk: int = 3, pool: int = 40) -> DataFrame:
    """chunk_id, document_id, rank, claim_ids, quote, confidence of each recalled chunk: its own current claims, or else its document's, those about the question first; the quote is that of the surest."""
    live = claims.filter("status <> 'rejected'")
    surest = (F.col("confidence").desc(), F.col("id"))
    own = live.join(F.broadcast(chunks.select("chunk_id")), "chunk_id")
    own = _current_within(_first(own, "chunk_id", per_chunk, *surest), "chunk_id").withColumn("_place", F.col("_rn")).select("chunk_id", "id", "confidence", "quote", "_place")
    bare = chunks.join(own.select("chunk_id").distinct(), "chunk_id", "left_anti")
    of_doc = _first(live.join(F.broadcast(bare.select("document_id").distinct()), "document_id"), "document_id", pool, *surest)
    named = with_names(_current_within(of_doc, "document_id").drop("_rn"), names)
    named = named.withColumn("relevance", relevance(terms, F.col("quote"), F.col("object_text"), F.col("object_name"), F.col("subject_name"), F.col("predicate")))
    named = named.withColumn("_some", F.max("relevance").over(Window.partitionBy("document_id")) > 0).filter(~F.col("_some") | (F.col("relevance") > 0))
    named = _first(named, "document_id", per_chunk, *surest, out="_place").select("document_id", "id", "confidence", "quote", "_place")
    both = own.unionByName(bare.select("chunk_id", "document_id").join(named, "document_id").select(*own.columns))
    per = both.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("_place", "id"))).alias("c"), F.max_by("quote", F.struct(F.col("confidence"), -F.col("_place"))).alias("quote"), F.max("confidence").alias("confidence"))
    ids = F.transform("c", lambda x: x["id"])
    out = chunks.join(per, "chunk_id", "left")
    return out.select("chunk_id", "document_id", "rank", F.coalesce(ids, F.array().cast(both.schema["id"].dataType.simpleString().join(("array<", ">")))).alias("claim_ids"), F.coalesce(F.trim("quote"), F.lit("")).alias("quote"), "confidence")


def entity_summaries(hits: DataFrame, claims: DataFrame, entities: DataFrame, limit: int = 3, length: int = 140) -> DataFrame:
    """place, id, name, type, summary of the first entities that the evidence names: by hit, then claim, the subject before the object; entities (id, name, type, description)."""
    each = hits.select("rank", F.posexplode("claim_ids").alias("at", "id")).join(claims.select("id", "subject_id", "object_id"), "id")
    ends = each.select(F.struct("rank", "at", F.lit(0).alias("end")).alias("order"), F.col("subject_id").alias("id")).unionByName(each.select(F.struct("rank", "at", F.lit(1).alias("end")).alias("order"), F.col("object_id").alias("id")))
    first = ends.filter("id is not null").groupBy("id").agg(F.min("order").alias("order")).join(entities, "id").orderBy("order", "id").limit(limit)
    place = F.row_number().over(Window.orderBy("order", "id")).alias("place")  # ``limit`` rows
    return first.select(place, "id", "name", "type", F.substring(F.coalesce("description", F.lit("")), 1, length).alias("summary"))
