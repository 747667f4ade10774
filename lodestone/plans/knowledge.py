"""Queries of knowledge and evidence behind recalled passages, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import knowledge, lifecycle, retrieval
from ..sources import tables as kb
from .queries import _QUERY, _bm25_sql, query

#: What the question asks for beside the words that recall its passages.
_TERMS = ["click", "user-1", "u-2", "FRANCE"]


def _base(spark, d):
    """The ten best documents as chunks, claims that came from 200 of them, and other names of users."""
    found = retrieval.ranked(retrieval.lexical(kb.documents(spark, d), _QUERY, 50), "score", "id").filter("rank <= 10")
    chunks = found.select(F.col("id").alias("chunk_id"), F.col("id").alias("document_id"), "rank")
    claims = kb.claims(spark, d)
    # a claim without chunk belongs to its document alone
    document = (F.col("id") * 7) % 200
    claims = claims.withColumn("document_id", document).withColumn("chunk_id", F.when(document % 3 != 0, document)).withColumn("quote", F.concat(F.lit("says "), "predicate"))
    names = kb.entities(spark, d).select("id", "name")
    aliases = names.filter("id like 'u:%'").select(F.col("id").alias("entity_id"), F.concat(F.lit("u-"), F.substring("id", 3, 20)).alias("alias"))
    return chunks, claims, names, aliases


_ORDERED = "relevance desc, confidence desc, id"
_HAY = " + ".join(f"contains(hay, '{t.lower()}')::int" for t in _TERMS)
_BASE = "," + _bm25_sql(50).replace("select id, round", ", lx as (select id, round", 1) + f""")
, ch as (select id as chunk_id, id as document_id, rank from (select id, row_number() over (order by score, id) as rank from lx) where rank <= 10)
, cl as (select c.*, s.name as subject_name, o.name as object_name, (c.id * 7) % 200 as document_id, case when (c.id * 7) % 200 % 3 <> 0 then (c.id * 7) % 200 end as chunk_id, 'says ' || c.predicate as quote
  from kb_claim c join kb_entity s on s.id = c.subject_id left join kb_entity o on o.id = c.object_id where c.status <> 'rejected')"""
_BASE = _BASE.replace("\n, lx", ", lx")
_RELEVANT = f"""
, named as (select *, {_HAY} as relevance from (select *, lower(concat_ws(' ', quote, object_text, object_name, subject_name, predicate)) as hay from cl where document_id in (select document_id from ch)))"""


@query(_BASE + f"""
, sc as (select *, {_HAY} as relevance from (select *, lower(concat_ws(' ', subject_name, object_name, object_text, quote, case when subject_id like 'u:%' then 'u-' || subject_id[3:] end, predicate)) as hay from cl where chunk_id in (select chunk_id from ch)))
, top as (select *, case when status = 'superseded' then 3 when id in (select source_id from kb_claim_relation where relationship = 'contradicts' and status = 'candidate') then 2 when status = 'candidate' then 1 else 0 end as state,
  coalesce('entity:' || object_id, lower(trim(object_text)), '') as key from sc qualify row_number() over (partition by chunk_id order by {_ORDERED}) <= 3)
select id, subject_name, predicate, coalesce(object_name, object_text) as object, state, relevance, chunk_id, members from
 (select *, count(*) over (partition by subject_id, predicate, key) as members, row_number() over (partition by subject_id, predicate, key order by state, {_ORDERED}) as rn from top) where rn = 1 order by state, {_ORDERED} limit 8""")
def search_knowledge_chunks(spark, d):
    chunks, claims, names, aliases = _base(spark, d)
    disputed = lifecycle.attributed(kb.claim_relations(spark, d), "contradicts", "candidate")
    return knowledge.search(chunks, claims, names, aliases, disputed, _TERMS)


@query(_BASE + f"""
, pool as (select document_id as doc, id as claim from cl where document_id in (select document_id from ch) qualify row_number() over (partition by document_id order by confidence desc, id) <= 40){_RELEVANT}
, best as (select n.*, max(relevance) over (partition by document_id) > 0 as told, row_number() over (partition by document_id order by {_ORDERED}) as rn from named n join pool on claim = id)
, kept as (select * from best where rn <= 6 and case when told then relevance > 0 else rn <= 3 end)
, live as (select *, max((status <> 'superseded')::int) over (partition by document_id, subject_id, predicate) as l from kept)
select ch.chunk_id, live.id as claim_id, relevance from ch join live using (document_id) where status <> 'superseded' or l = 0""")
def evidence_pack(spark, d):
    chunks, claims, names, _ = _base(spark, d)
    return knowledge.evidence_pack(chunks, claims, names, _TERMS)


_HITS = _BASE + _RELEVANT + f"""
, own3 as (select * from cl where chunk_id in (select chunk_id from ch) qualify row_number() over (partition by chunk_id order by confidence desc, id) <= 3)
, own as (select chunk_id, id, confidence, quote from (select *, max((status <> 'superseded')::int) over (partition by chunk_id, subject_id, predicate) as l from own3) where status <> 'superseded' or l = 0)
, bare as (select * from ch where chunk_id not in (select chunk_id from own))
, doc40 as (select n.* from named n where document_id in (select document_id from bare) qualify row_number() over (partition by document_id order by confidence desc, id) <= 40)
, docl as (select *, max(relevance) over (partition by document_id) > 0 as told from (select * from (select *, max((status <> 'superseded')::int) over (partition by document_id, subject_id, predicate) as l from doc40) where status <> 'superseded' or l = 0))
, doc3 as (select document_id, id, confidence, quote from docl where not told or relevance > 0 qualify row_number() over (partition by document_id order by confidence desc, id) <= 3)
, both_ as (select * from own union all select b.chunk_id, d.id, d.confidence, d.quote from bare b join doc3 d using (document_id))
, hits as (select ch.chunk_id, ch.document_id, ch.rank, coalesce(list(b.id order by b.confidence desc, b.id) filter (b.id is not null), []) as claim_ids, coalesce(arg_max(b.quote, (b.confidence, -b.id)), '') as quote, max(b.confidence) as confidence from ch left join both_ b using (chunk_id) group by 1, 2, 3)"""


@query(_HITS + " select chunk_id, document_id, rank, array_to_string(claim_ids, ',') as claim_ids, quote, confidence from hits")
def evidence_hits(spark, d):
    chunks, claims, names, _ = _base(spark, d)
    return knowledge.evidence_hits(chunks, claims, names, _TERMS).withColumn("claim_ids", F.array_join("claim_ids", ","))


@query(_HITS + """
, at_ as (select rank, unnest(claim_ids) as id, unnest(range(len(claim_ids))) as k from hits)
, ends as (select rank, k, 0 as e, subject_id as id from at_ join kb_claim using (id) union all select rank, k, 1, object_id from at_ join kb_claim using (id) where object_id is not null)
, firsts as (select id, min(row(rank, k, e)) as o from ends group by id order by o, id limit 3)
select row_number() over (order by o, id) as place, id, name, type, 'about ' || name as summary from firsts join kb_entity using (id)""")
def evidence_entities(spark, d):
    chunks, claims, names, _ = _base(spark, d)
    entities = kb.entities(spark, d).withColumn("description", F.concat(F.lit("about "), "name"))
    return knowledge.entity_summaries(knowledge.evidence_hits(chunks, claims, names, _TERMS), claims, entities)
