"""Named queries over the projected knowledge base, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import registry
from ..functions import text as tx
from ..functions.udfs import html_text
from ..operators import catalog, classify, context, evaluate, graph, lifecycle, quality, resolve, retrieval, storage
from ..sources import tables as kb

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, prelude: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"with recursive {kb.SQL}{sql if sql.lstrip().startswith(',') else chr(10) + sql}" if prelude else sql
        return f

    return add


def _vectors(spark, d):
    v = kb.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v, v.filter("id = 0").select(F.col("v").alias("q"))


_COS = "round(list_dot_product(e.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))), 6)"
_QUERY = "license of the token and the under"
_GRAMS = retrieval.grams_of(_QUERY)


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _any(col: str, markers, low: bool = True) -> str:
    return "(" + " or ".join(f"contains({'lower(' + col + ')' if low else col}, '{m.lower() if low else m}')" for m in markers) + ")"


# documents and storage


@query("select content_hash, min(id) as id, count(*) as copies from kb_document group by content_hash")
def doc_exact_dedup(spark, d):
    return storage.exact_dedup(kb.documents(spark, d))


@query("select content_hash, min(id) as id, count(*) as copies from kb_document group by content_hash having count(*) > 1")
def doc_hash_groups(spark, d):
    return storage.exact_dedup(kb.documents(spark, d)).filter("copies > 1")


@query("select source, count(*) as n, sum(length(content))::bigint as chars, count(distinct content_hash) as contents from kb_document group by source")
def doc_source_stats(spark, d):
    return kb.documents(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.countDistinct("content_hash").alias("contents"))


@query("select id, title from kb_document where contains(lower(content), 'license') or contains(lower(content), 'token') or contains(lower(title), 'license') or contains(lower(title), 'token')")
def doc_like_search(spark, d):
    return retrieval.contains_any_term(kb.documents(spark, d), ["license", "token"]).select("id", "title")


@query("select item_id, array_to_string(regexp_extract_all(regexp_replace(text, '[，。？！、：；（）「」【】“”]', ' ', 'g'), '[\\x{4e00}-\\x{9fff}]+|[A-Za-z0-9_][A-Za-z0-9_.\\-]*'), '|') as terms from benchmark", prelude=False)
def query_terms(spark, d):
    return kb.table(spark, d, "benchmark").select("item_id", F.array_join(tx.query_terms(F.col("text")), "|").alias("terms"))


@query(r"""select item_id, string_agg(g, '|' order by i) as grams from (select item_id, g, i, row_number() over (partition by item_id order by i) as rn from (select item_id, s[i:i + 2] as g, min(i) as i from
(select item_id, s, unnest(range(1, length(s) - 1)) as i from (select item_id, regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '["'']', '', 'g') as s from benchmark)) group by item_id, g)) where rn <= 32 group by item_id""", prelude=False)
def trigram_query(spark, d):
    return kb.table(spark, d, "benchmark").select("item_id", F.array_join(tx.query_grams(F.col("text")), "|").alias("grams"))


def _bm25_sql(limit: int) -> str:
    # no gram of the query overlaps itself, so counts by replacement are whole
    count = lambda c, g: f"((length({c}) - length(replace({c}, '{g}', ''))) // 3)"
    counts = ", ".join(f"{count('t', g)} + {count('h', g)} as f{k}" for k, g in enumerate(_GRAMS))
    dfs = ", ".join(f"count(*) filter (f{k} > 0) as d{k}" for k in range(len(_GRAMS)))
    parts = " + ".join(f"case when f{k} > 0 then greatest(ln((n - d{k} + 0.5::double) / (d{k} + 0.5::double)), 1e-6::double) * f{k} * 2.2::double / (f{k} + 1.2::double * (0.25::double + 0.75::double * len / av)) else 0 end" for k in range(len(_GRAMS)))
    some = " or ".join(f"f{k} > 0" for k in range(len(_GRAMS)))
    return f"""tf as (select id, len, {counts} from (select id, greatest(length(coalesce(content, '')) - 2, 0) + greatest(length(coalesce(title, '')) - 2, 0) as len, lower(coalesce(content, '')) as t, lower(coalesce(title, '')) as h from kb_document)),
st as (select count(*) as n, avg(len) as av, {dfs} from tf)
select id, round(-({parts}), 6) as score from tf, st where {some} order by score, id limit {limit}"""


@query("," + _bm25_sql(10))
def bm25_topk(spark, d):
    return retrieval.bm25(kb.documents(spark, d), _GRAMS, 10)


@query("," + _bm25_sql(50))
def lexical_search(spark, d):
    return retrieval.lexical(kb.documents(spark, d), _QUERY, 100)


@query("select id, 0.0::double as score from kb_document where contains(lower(title), 'src1-1') or contains(lower(content), 'src1-1') order by id limit 50")
def lexical_fallback(spark, d):
    return retrieval.contains_any_term(kb.documents(spark, d), ["src1-1"]).select("id", F.lit(0.0).alias("score")).orderBy("id").limit(50)


@query(f"select e.vec_id as id, {_COS} as score from embeddings e, embeddings q where q.vec_id = 0 order by score desc, id limit 10", prelude=False)
def vector_topk(spark, d):
    return retrieval.vector_top(*_vectors(spark, d), 10)


@query(f"select label, count(*) as n from (select e.label, {_COS} as score, e.vec_id from embeddings e, embeddings q where q.vec_id = 0 order by score desc, vec_id limit 50) group by label", prelude=False)
def vector_label_knn(spark, d):
    labels = kb.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return retrieval.vector_top(*_vectors(spark, d), 50).join(labels, "id").groupBy("label").agg(F.count("*").alias("n"))


@query("," + _bm25_sql(50).replace("select id, round", ", lx as (select id, round", 1) + f""")
, vx as (select e.vec_id as id, {_COS} as score from embeddings e, embeddings q where q.vec_id = 0 order by score desc, id limit 50)
, both_ as (select id, row_number() over (order by score, id) as rank from lx union all select id, row_number() over (order by score desc, id) from vx)
select id, round(sum(1.0::double / (60 + rank)), 9) as score from both_ group by id order by score desc, id limit 20""")
def rrf_hybrid(spark, d):
    a = retrieval.ranked(retrieval.lexical(kb.documents(spark, d), _QUERY, 50), "score", "id")
    b = retrieval.ranked(retrieval.vector_top(*_vectors(spark, d), 50), F.col("score").desc(), "id")
    return retrieval.reciprocal_rank_fusion([a, b], 20)


@query("select id, concat_ws(',', case when contains(lower(title), 'src1') or contains(lower(title), 'token') then 'title' end, case when contains(lower(content), 'src1') or contains(lower(content), 'token') then 'content' end) as matched from kb_document")
def hybrid_match_explain(spark, d):
    return retrieval.matched_in(kb.documents(spark, d), ["src1", "token"])


_CHUNKS = """, ch as (select id, content as t, 0 as chunk_index, 0 as s, null::int as prev from kb_document where length(content) > 0
  union all select id, t, chunk_index + 1, nxt, 0 from (select *, greatest(0, e - 200) as nxt from (select *, case when least(length(t), s + 1800) = length(t) then length(t) else
    (select case when 1800 - p > 900 and p > 0 and 1800 - p + 0 > 900 then s + (1800 - p) + 1 else s + 1800 end from (select position(' ' in reverse(replace(substr(t, s + 1, 1800), chr(10), ' '))) as p)) end as e from ch)) where e < length(t)),
kb_chunk as (select id as document_id, chunk_index, s as start_offset, (case when least(length(t), s + 1800) = length(t) then length(t) else
    (select case when p > 0 and 1800 - p > 900 then s + (1800 - p) + 1 else s + 1800 end from (select position(' ' in reverse(replace(substr(t, s + 1, 1800), chr(10), ' '))) as p)) end)::int as end_offset, t from ch),
chunk as (select document_id, chunk_index, start_offset, end_offset, substr(t, start_offset + 1, end_offset - start_offset) as content, sha256(substr(t, start_offset + 1, end_offset - start_offset)) as content_hash from kb_chunk)
"""


@query(_CHUNKS + "select document_id, chunk_index, start_offset, end_offset, content_hash from chunk")
def chunk_offsets(spark, d):
    return storage.chunk_documents(kb.documents(spark, d)).drop("content")


@query(_CHUNKS + """select document_id, chunk_index, hits, rn from (select *, row_number() over (partition by document_id order by hits desc, chunk_index) as rn from
 (select *, max(hits) over (partition by document_id) as most from (select document_id, chunk_index, contains(lower(content), 'the ')::int + contains(lower(content), 'token')::int + contains(lower(content), 'ion')::int as hits from chunk)) where hits > 0 or most = 0) where rn <= 3""")
def chunk_topk_per_doc(spark, d):
    return retrieval.top_chunks(storage.chunk_documents(kb.documents(spark, d)), ["the ", "token", "ion"]).select("document_id", "chunk_index", "hits", "rn")


def _stored_chunks(spark, d):
    k = F.col("document_id") + F.col("chunk_index")
    old = storage.chunk_documents(kb.documents(spark, d)).filter("chunk_index % 11 <> 10")
    return old.withColumn("content_hash", F.when(k % 5 == 0, F.lit(None)).when(k % 7 == 0, "x").otherwise(F.col("content_hash"))).withColumn("extraction_version", F.when(k % 3 == 0, "v1").otherwise("v2"))


_STORED = """, stored as (select document_id, chunk_index, case when (document_id + chunk_index) % 5 = 0 then null when (document_id + chunk_index) % 7 = 0 then 'x' else content_hash end as content_hash,
 case when (document_id + chunk_index) % 3 = 0 then 'v1' else 'v2' end as extraction_version from chunk where chunk_index % 11 <> 10)
, target as (select * from chunk where document_id % 13 <> 0)
"""


@query(_CHUNKS + _STORED + """select document_id, chunk_index, case when s.chunk_index is null then 'created' when t.chunk_index is null then 'removed' when s.content_hash = t.content_hash then 'unchanged' else 'changed' end as outcome
from (select *, chunk_index as k from stored) s full join target t using (document_id, chunk_index)""".replace("s.chunk_index is null", "s.k is null").replace("t.chunk_index is null", "t.start_offset is null"))
def chunk_incremental_diff(spark, d):
    target = storage.chunk_documents(kb.documents(spark, d)).filter("document_id % 13 <> 0")
    return storage.diff_chunks(_stored_chunks(spark, d), target)


@query(_CHUNKS + _STORED + "select t.document_id, t.chunk_index, s.extraction_version from target t left join stored s on t.document_id = s.document_id and t.chunk_index = s.chunk_index and t.content_hash = s.content_hash where s.extraction_version is null or s.extraction_version <> 'v2'")
def chunk_stale_by_version(spark, d):
    target = storage.chunk_documents(kb.documents(spark, d)).filter("document_id % 13 <> 0")
    return storage.stale(storage.sync_chunks(_stored_chunks(spark, d), target), "v2").select("document_id", "chunk_index", "extraction_version")


@query("select content_hash from kb_document except select content_hash from kb_document where id % 4 = 0")
def embedding_cache_misses(spark, d):
    docs = kb.documents(spark, d)
    return storage.cache_misses(docs, docs.filter("id % 4 = 0").select("content_hash", F.lit("m0").alias("model")), "m0")


@query("select id as document_id from kb_document where length(content) > 0 and id not in (select vec_id from embeddings)")
def embedding_backfill(spark, d):
    rows = kb.documents(spark, d).filter(F.length("content") > 0).select(F.col("id").alias("document_id"))
    return storage.backfill(rows, kb.table(spark, d, "embeddings").select(F.col("vec_id").alias("document_id")))


@query("select id, document_id from (select id, ('d' || (id % 97)) as document_id from kb_claim) where document_id not in ('d3', 'd50')")
def document_cascade_delete(spark, d):
    claims = kb.claims(spark, d).select("id", F.concat(F.lit("d"), (F.col("id") % 97).cast("string")).alias("document_id"))
    gone = claims.select("document_id").distinct().filter(F.col("document_id").isin("d3", "d50"))
    return storage.delete_derived(claims, gone).select("id", "document_id")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by event_id desc) as rn from events) where rn <= 20", prelude=False)
def keep_latest_versions(spark, d):
    return storage.keep_latest(kb.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id", 20)




@query()
def html_import(spark, d):
    return kb.table(spark, d, "pages").select("page_id", html_text("html").alias("text"))


# claims


@query("select c.id, s.name as subject_name, c.predicate, o.name as object_name, c.object_text, c.status from kb_claim c join kb_entity s on s.id = c.subject_id left join kb_entity o on o.id = c.object_id")
def claims_with_names(spark, d):
    return retrieval.with_names(kb.claims(spark, d), kb.entities(spark, d)).select("id", "subject_name", "predicate", "object_name", "object_text", "status")


@query("select id, type, name from kb_entity where type = 'Product' and contains(lower(name), 'e') order by name desc, id limit 25 offset 50")
def entities_filtered_page(spark, d):
    return kb.entities(spark, d).filter((F.col("type") == "Product") & F.lower("name").contains("e")).orderBy(F.col("name").desc(), "id").offset(50).limit(25)


@query("select * from kb_claim where subject_id in (select id from kb_entity where id like 'u:1%') or object_id in (select 'n:' || n_nationkey from nation where n_regionkey = 1)")
def claims_touching(spark, d):
    ids = kb.entities(spark, d).filter(F.col("id").startswith("u:1")).select("id").unionByName(kb.table(spark, d, "nation").filter("n_regionkey = 1").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id")))
    return graph.touching(kb.claims(spark, d), ids)


@query("select id from kb_claim where (subject_id, predicate) in (select (subject_id, predicate) from kb_claim where confidence >= 0.99)")
def claim_group_counterparts(spark, d):
    c = kb.claims(spark, d)
    return c.join(c.filter("confidence >= 0.99").select("subject_id", "predicate").distinct(), ["subject_id", "predicate"], "left_semi").select("id")


@query("select id, count(*) as n from (select subject_id as id from kb_claim union all select object_id from kb_claim where object_id is not null) group by id")
def claim_counts_both_ends(spark, d):
    c = kb.claims(spark, d)
    return c.select(F.col("subject_id").alias("id")).unionAll(c.select("object_id").filter("object_id is not null")).groupBy("id").agg(F.count("*").alias("n"))


@query("select predicate, count(*) as n from kb_claim group by predicate")
def predicate_census(spark, d):
    return kb.claims(spark, d).groupBy("predicate").agg(F.count("*").alias("n"))


@query("select source_id as claim_id, count(*) as n from kb_claim_relation where relationship = 'duplicate' and status = 'accepted' group by 1")
def corroboration(spark, d):
    return lifecycle.attributed(kb.claim_relations(spark, d), "duplicate", "accepted").groupBy("claim_id").agg(F.count("*").alias("n"))


@query("select distinct claim_id from (select source_id as claim_id from kb_claim_relation where relationship = 'contradicts' and status = 'candidate' union all select target_id from kb_claim_relation where relationship = 'contradicts' and status = 'candidate')")
def disputed_claims(spark, d):
    return lifecycle.attributed(kb.claim_relations(spark, d), "contradicts", "candidate", both_ends=True).distinct()


@query("select id, trim(object_text) as object_text from kb_claim where object_id is null and trim(coalesce(object_text, '')) <> ''")
def unlinked_objects(spark, d):
    return kb.claims(spark, d).filter("object_id is null and trim(coalesce(object_text, '')) <> ''").select("id", F.trim("object_text").alias("object_text"))


@query("select r.source_id, r.target_id, r.relationship from kb_claim_relation r join kb_claim a on a.id = r.source_id join kb_claim b on b.id = r.target_id where r.status = 'candidate' and a.status <> 'rejected' and b.status not in ('rejected', 'superseded')")
def pending_decisions(spark, d):
    c = kb.claims(spark, d).select("id", "status")
    r = kb.claim_relations(spark, d).filter("status = 'candidate'")
    a = c.filter("status <> 'rejected'").select(F.col("id").alias("source_id"))
    b = c.filter("status not in ('rejected', 'superseded')").select(F.col("id").alias("target_id"))
    return r.join(a, "source_id", "left_semi").join(b, "target_id", "left_semi").select("source_id", "target_id", "relationship")


@query("""select r.source_id, r.target_id, s.name as subject_name, coalesce(oa.name, a.object_text) as new_object, coalesce(ob.name, b.object_text) as old_object, r.relationship from kb_claim_relation r
 join kb_claim a on a.id = r.source_id join kb_claim b on b.id = r.target_id join kb_entity s on s.id = a.subject_id left join kb_entity oa on oa.id = a.object_id left join kb_entity ob on ob.id = b.object_id where r.status = 'candidate'""")
def relation_queue(spark, d):
    named = retrieval.with_names(kb.claims(spark, d), kb.entities(spark, d)).select("id", "subject_name", F.coalesce("object_name", "object_text").alias("object"))
    r = kb.claim_relations(spark, d).filter("status = 'candidate'").select("source_id", "target_id", "relationship")
    new = named.select(F.col("id").alias("source_id"), "subject_name", F.col("object").alias("new_object"))
    old = named.select(F.col("id").alias("target_id"), F.col("object").alias("old_object"))
    return r.join(new, "source_id").join(old, "target_id").select("source_id", "target_id", "subject_name", "new_object", "old_object", "relationship")


@query("select subject_id, predicate, count(*) as n, count(distinct polarity) as polarities from kb_claim group by all having count(*) >= 2 and count(distinct polarity) > 1")
def polarity_conflicts(spark, d):
    g = kb.claims(spark, d).groupBy("subject_id", "predicate").agg(F.count("*").alias("n"), F.countDistinct("polarity").alias("polarities"))
    return g.filter("n >= 2 and polarities > 1")


_KEYED = ", k as (select *, case when object_id is not null then 'entity:' || object_id else coalesce(lower(trim(object_text)), '') end as key from kb_claim)\n"


@query(_KEYED + """, live as (select *, row_number() over (partition by subject_id, predicate order by created_at, id) as rn from k where status not in ('rejected', 'archived'))
, p as (select a.id as source_id, b.id as target_id, a.key as ka, b.key as kb, a.polarity = b.polarity as same, a.predicate in ('view', 'is') as functional from live a join live b on a.subject_id = b.subject_id and a.predicate = b.predicate and b.rn between a.rn - 10 and a.rn - 1)
, v as (select *, case when ka = '' or kb = '' then 'unclear' when ka = kb and same then 'duplicate' when ka = kb then 'contradicts' when functional then 'contradicts' else 'coexists' end as relationship from p)
select source_id, target_id, relationship, (case relationship when 'duplicate' then 0.97 when 'coexists' then 0.7 else case when ka = kb then 0.9 else 0.55 end end)::double as confidence from v where relationship <> 'unclear'""")
def claim_verdicts(spark, d):
    return lifecycle.related_verdicts(kb.claims(spark, d), ("view", "is"))


@query(_KEYED + """select a.subject_id, a.predicate, a.key, a.id as positive_id, b.id as negative_id from k a join k b using (subject_id, predicate, key) where a.status <> 'superseded' and b.status <> 'superseded' and key <> '' and a.polarity = 'positive' and b.polarity <> 'positive'""")
def conflict_pairs(spark, d):
    return lifecycle.conflict_pairs(kb.claims(spark, d))


_GROUPS = """select subject_id, predicate, sum(p * q)::bigint as opposed, (case when predicate in ('view', 'is') then (sum(p + q) * sum(p + q) - sum((p + q) * (p + q))) // 2 else 0 end)::bigint as differing
 from (select subject_id, predicate, key, count(*) filter (polarity = 'positive') as p, count(*) filter (polarity <> 'positive') as q from {} where status <> 'superseded' and key <> '' group by all) group by subject_id, predicate having opposed + differing > 0"""


@query(_KEYED + _GROUPS.format("k"))
def conflict_groups(spark, d):
    return lifecycle.conflict_groups(kb.claims(spark, d), ("view", "is"))


@query(_KEYED + f""", near_ as (select * from k where subject_id in ('u:1', 'u:2') or object_id in ('u:1', 'u:2')), moved as (select * replace (case when subject_id = 'u:2' then 'u:1' else subject_id end as subject_id) from near_)
, b as (select 'u:1' as subject_id, predicate, sum(opposed + differing) as b from ({_GROUPS.format('near_')}) group by predicate), a as ({_GROUPS.format('moved')})
select a.subject_id, a.predicate, (opposed + differing - coalesce(b.b, 0))::bigint as new_pairs from a left join b using (subject_id, predicate) where opposed + differing - coalesce(b.b, 0) > 0""")
def merge_impact_conflicts(spark, d):
    return lifecycle.merge_impact(kb.claims(spark, d), "u:1", "u:2", ("view", "is"))


@query("select id, case when subject_id = 'u:2' then 'u:1' else subject_id end as subject_id, object_id from kb_claim")
def repointed_claims(spark, d):
    return lifecycle.repointed(kb.claims(spark, d), "u:1", "u:2").select("id", "subject_id", "object_id")


@query("select id, status from (select *, max(case when status <> 'superseded' then 1 else 0 end) over (partition by subject_id, predicate) as c from kb_claim) where status <> 'superseded' or c = 0")
def current_resolution(spark, d):
    return lifecycle.current(kb.claims(spark, d)).select("id", "status")


@query(_KEYED + "select subject_id, predicate, key, id, members from (select *, count(*) over w as members, row_number() over (partition by subject_id, predicate, key order by case status when 'superseded' then 3 when 'candidate' then 2 else 1 end, confidence desc, id) as rn from k where status <> 'rejected' window w as (partition by subject_id, predicate, key)) where rn = 1")
def best_per_statement(spark, d):
    return lifecycle.best_per_statement(kb.claims(spark, d))


@query("""select c.id, case when c.status = 'superseded' then 'historical' when x.claim_id is not null then 'disputed' when c.status = 'candidate' then 'candidate' else 'current' end as state from kb_claim c
 left join (select distinct source_id as claim_id from kb_claim_relation where relationship = 'contradicts' and status = 'candidate') x on x.claim_id = c.id where c.status <> 'rejected'""")
def knowledge_states(spark, d):
    return lifecycle.states(kb.claims(spark, d), lifecycle.attributed(kb.claim_relations(spark, d), "contradicts", "candidate"))


@query(""", e as (select source_id, target_id from kb_claim_relation where relationship = 'supersedes' and status = 'accepted')
, walk as (select source_id as root, target_id as id, 1 as depth from e where source_id not in (select target_id from e) union all select w.root, e.target_id, w.depth + 1 from walk w join e on e.source_id = w.id where w.depth < 64)
select root, id, depth from walk""")
def supersede_chain(spark, d):
    return lifecycle.supersede_chains(kb.claim_relations(spark, d).filter("relationship = 'supersedes' and status = 'accepted'"))


@query("select c.id, c.created_at as effective_from, t.effective_to from kb_claim c left join (select target_id, min(created_at) as effective_to from kb_claim_relation where relationship = 'supersedes' and status = 'accepted' group by 1) t on t.target_id = c.id")
def effective_periods(spark, d):
    return lifecycle.effective_periods(kb.claims(spark, d), kb.claim_relations(spark, d))


@query("select c.id, coalesce(o.status, c.status) as status from kb_claim c left join (select id, arg_max(status, row(happened, op)) as status from (select event_id % 1000 as id, case when event_id % 3 = 0 then 'archived' when event_id % 3 = 1 then 'verified' else 'superseded' end as status, ts as happened, event_id as op from events) group by id) o using (id)")
def operations_folded(spark, d):
    ops = kb.table(spark, d, "events").select((F.col("event_id") % 1000).alias("claim_id"), F.when(F.col("event_id") % 3 == 0, "archived").when(F.col("event_id") % 3 == 1, "verified").otherwise("superseded").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("op_id"))
    return lifecycle.apply_operations(kb.claims(spark, d), ops).select("id", "status")


# graph


def _hops(depth: int):
    sql = """, b as (select source_id as a, target_id as b from kb_relation union all select target_id, source_id from kb_relation), h1 as (select distinct b as id from b where a = 's:1' and b <> 's:1')
, h2 as (select distinct b.b as id from b join h1 on b.a = h1.id where b.b <> 's:1' and b.b not in (select id from h1)), h3 as (select distinct b.b as id from b join h2 on b.a = h2.id where b.b <> 's:1' and b.b not in (select id from h1) and b.b not in (select id from h2))
""" + " union all ".join(f"select id, {k}::int as hop from h{k}" for k in range(1, depth + 1))

    def run(spark, d):
        return graph.neighborhood(kb.relations(spark, d), "s:1", depth)

    run.__name__ = f"graph_neighborhood_{depth}"
    query(sql)(run)


for _k in (1, 2, 3):
    _hops(_k)


@query("select id, count(*) as degree from (select source_id as id from kb_relation union all select target_id from kb_relation) group by id")
def graph_degree(spark, d):
    return graph.degrees(kb.relations(spark, d))


@query("select distinct source_id, predicate, target_id from kb_relation where source_id in (select id from kb_entity where type = 'Location' or id like 's:%') and target_id in (select id from kb_entity where type = 'Location' or id like 's:%')")
def graph_induced_subgraph(spark, d):
    nodes = kb.entities(spark, d).filter((F.col("type") == "Location") | F.col("id").startswith("s:")).select("id")
    return graph.induced(kb.relations(spark, d), nodes)


# entities


@query("""select surface, id, via from (select distinct s.surface, e.id, 'name' as via from (select upper(n_name) as surface from nation union select 'N' || n_nationkey from nation) s join kb_entity e on lower(trim(e.name)) = lower(trim(s.surface))
 union all select distinct 'N' || n_nationkey, 'n:' || n_nationkey, 'alias' from nation where lower('N' || n_nationkey) not in (select lower(trim(name)) from kb_entity))""")
def entity_alias_resolve(spark, d):
    n = kb.table(spark, d, "nation")
    alias = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    surfaces = n.select(F.upper("n_name").alias("surface")).unionByName(n.select(alias.alias("surface")))
    return resolve.resolve(surfaces, kb.entities(spark, d), n.select(alias.alias("alias"), F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id")))


@query("select q.event_id as id, e.name from (select event_id, 'what did user-' || user_id || ' do in ' || event_type as question from events) q join kb_entity e on e.name = regexp_extract(q.question, 'user-[0-9]+')")
def entity_longest_match(spark, d):
    q = kb.table(spark, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("what did user-"), F.col("user_id").cast("string"), F.lit(" do in "), F.col("event_type")).alias("question"))
    return resolve.longest_contained(q, kb.entities(spark, d))


@query("select e.id, e.name, count(c.id) as claims, count(c.id) filter (c.status = 'verified') as verified, count(distinct c.predicate) as predicates, max(c.created_at) as last_at from kb_entity e left join kb_claim c on c.subject_id = e.id where e.type = 'Person' group by e.id, e.name")
def entity_dossier(spark, d):
    g = kb.claims(spark, d).groupBy("subject_id").agg(F.count("*").alias("claims"), F.count(F.when(F.col("status") == "verified", 1)).alias("verified"), F.countDistinct("predicate").alias("predicates"), F.max("created_at").alias("last_at"))
    e = kb.entities(spark, d).filter("type = 'Person'").select("id", "name")
    return e.join(g, e.id == g.subject_id, "left").select("id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("claims", "verified", "predicates")], "last_at")


@query(""", w as (select id, type, list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from kb_entity where type = 'Product')
select distinct a.id as short_id, b.id as long_id from w a join w b on a.type = b.type and a.id <> b.id and list_slice(b.w, 1, len(a.w)) = a.w where len(a.w) < len(b.w) or a.id < b.id""")
def dup_scan_containment(spark, d):
    return resolve.contained_pairs(kb.entities(spark, d).filter("type = 'Product'"))


@query()
def dup_scan_fuzzy(spark, d):
    return resolve.fuzzy_pairs(kb.entities(spark, d).filter("type = 'Product'"), 0.9)


@query()
def near_duplicates(spark, d):
    e = kb.entities(spark, d)
    return resolve.near_duplicates(e.filter("id = 'p:1'"), e.filter("type = 'Product'"))


@query("select c.id as claim_id, min(e.id) as entity_id, case when count(*) = 1 then 'high' else 'ambiguous' end as confidence from (select id, case when id % 3 = 0 then 'user-' || object_text else object_text end as t from kb_claim where object_id is null and trim(coalesce(object_text, '')) <> '') c join kb_entity e on lower(trim(e.name)) = lower(trim(c.t)) group by c.id")
def object_links_exact(spark, d):
    c = kb.claims(spark, d).withColumn("object_text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("user-"), F.col("object_text"))).otherwise(F.col("object_text")))
    return resolve.exact_links(c, kb.entities(spark, d))


# counts and usage


@query("select 'documents' as table_name, count(*) as n from kb_document union all select 'entities', count(*) from kb_entity union all select 'claims', count(*) from kb_claim union all select 'relations', count(*) from kb_relation union all select 'claim_relations', count(*) from kb_claim_relation")
def stats(spark, d):
    return catalog.row_counts({"documents": kb.documents(spark, d), "entities": kb.entities(spark, d), "claims": kb.claims(spark, d), "relations": kb.relations(spark, d), "claim_relations": kb.claim_relations(spark, d)})


@query("select day::date as day, coalesce(n, 0) as n from (select unnest(generate_series(date '2023-12-20', date '2024-02-10', interval 1 day))::date as day) left join (select created_at::date as day, count(*) as n from kb_claim group by 1) using (day)")
def timeseries_filled(spark, d):
    return catalog.daily(kb.claims(spark, d), "created_at", "2023-12-20", "2024-02-10")


@query("select count(*) as stale from kb_claim where status = 'candidate' and created_at < timestamp '2024-04-20' - interval 90 day")
def stale_candidates(spark, d):
    return kb.claims(spark, d).filter("status = 'candidate' and created_at < timestamp'2024-04-20' - interval 90 days").agg(F.count("*").alias("stale"))


@query("select count(*) as claims, count(*) filter (status = 'verified') as verified, count(*) filter (object_id is null) as free_text, round(100.0::double * count(*) filter (status = 'verified') / count(*), 4) as verified_share, round(100.0::double * count(*) filter (object_id is null) / count(*), 4) as free_text_share, round(avg(confidence), 6) as mean_confidence from kb_claim")
def knowledge_health(spark, d):
    return catalog.health(kb.claims(spark, d))


_RUNS = "select o_orderpriority as task_type, count(*) as runs, coalesce(sum(steps), 0)::bigint as steps, coalesce(sum(p), 0)::double as prompt_tokens, coalesce(sum(c), 0)::bigint as completion_tokens, round((coalesce(sum(p), 0) + coalesce(sum(c), 0)) / count(*), 6)::double as tokens_per_run from orders left join (select l_orderkey, count(*) as steps, sum(l_quantity) as p, sum(l_linenumber) as c from lineitem group by 1) on l_orderkey = o_orderkey group by 1"


def _runs(spark, d):
    return kb.table(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("task_type"), F.col("o_orderstatus").alias("status"))


def _steps(spark, d):
    return kb.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("prompt_tokens"), F.col("l_linenumber").alias("completion_tokens"))


@query(_RUNS, prelude=False)
def token_usage_by_task(spark, d):
    return catalog.usage_by(_runs(spark, d), _steps(spark, d), "task_type")


@query("select o_orderkey as run_id, coalesce(n, 0)::bigint as steps, coalesce(p, 0)::bigint as prompt_tokens, coalesce(c, 0)::bigint as completion_tokens from orders left join (select l_orderkey, count(*) as n, sum(l_quantity) as p, sum(l_linenumber) as c from lineitem group by 1) on l_orderkey = o_orderkey", prelude=False)
def run_rollup(spark, d):
    return catalog.roll_up(_runs(spark, d), _steps(spark, d))


@query("select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as last_value, max(o_orderdate) as last_at, count(*) as n from orders group by 1", prelude=False)
def doc_last_run(spark, d):
    return catalog.latest(kb.table(spark, d, "orders"), "o_custkey", F.col("o_orderstatus"), "o_orderdate", "o_orderkey")


@query("select role as agent, count(*) as calls, trunc(avg(length(text)))::bigint as mean_chars, sum(length(text))::bigint as chars, round(avg(length(text)), 4) as mean_exact from conversations group by role", prelude=False)
def context_metrics_agents(spark, d):
    n = F.length("text")
    return kb.table(spark, d, "conversations").groupBy(F.col("role").alias("agent")).agg(F.count("*").alias("calls"), F.avg(n).cast("long").alias("mean_chars"), F.sum(n).alias("chars"), F.round(F.avg(n), 4).alias("mean_exact"))


@query("select count(*) as entries, (sum(n) - count(*))::bigint as hits, round((sum(n) - count(*)) / sum(n)::double, 4) as hit_rate from (select content_hash, count(*) as n from kb_document group by 1)")
def cache_hit_rate(spark, d):
    g = storage.exact_dedup(kb.documents(spark, d))
    hits = F.sum("copies") - F.count("*")
    return g.agg(F.count("*").alias("entries"), hits.alias("hits"), F.round(hits / F.sum("copies"), 4).alias("hit_rate"))


@query("select 'claims' as inbox, count(*) as n from kb_claim where status = 'candidate' union all select 'relations', count(*) from kb_claim_relation where status = 'candidate' union all select 'unlinked', count(*) from kb_claim where object_id is null and status <> 'rejected'")
def inbox_counts(spark, d):
    c, r = kb.claims(spark, d), kb.claim_relations(spark, d)
    return catalog.row_counts({"claims": c.filter("status = 'candidate'"), "relations": r.filter("status = 'candidate'"), "unlinked": c.filter("object_id is null and status <> 'rejected'")}).withColumnRenamed("table_name", "inbox")


@query("select 'dangling_subject' as finding, count(*) as n from kb_claim where subject_id not in (select id from kb_entity) union all select 'dangling_object', count(*) from kb_claim where object_id is not null and object_id not in (select id from kb_entity) union all select 'duplicate_content', coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from kb_document group by content_hash)")
def integrity_counts(spark, d):
    c, e = kb.claims(spark, d), kb.entities(spark, d)
    gone = lambda col: c.filter(F.col(col).isNotNull()).join(e.select(F.col("id").alias(col)), col, "left_anti")
    extra = storage.exact_dedup(kb.documents(spark, d)).agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_content").alias("table_name"), "n")
    return catalog.row_counts({"dangling_subject": gone("subject_id"), "dangling_object": gone("object_id")}).unionByName(extra).withColumnRenamed("table_name", "finding")


@query("select coalesce(b.user_id, a.user_id) as user_id, coalesce(b.event_type, a.event_type) as event_type, case when a.user_id is null then 'removed' when b.user_id is null then 'added' else 'kept' end as outcome from (select distinct user_id, event_type from events where ts < timestamp '2024-01-05') b full join (select distinct user_id, event_type from events where ts >= timestamp '2024-01-25') a on a.user_id = b.user_id and a.event_type = b.event_type", prelude=False)
def snapshot_diff(spark, d):
    e = kb.table(spark, d, "events")
    return catalog.snapshot_diff(e.filter("ts < timestamp'2024-01-05'"), e.filter("ts >= timestamp'2024-01-25'"), ["user_id", "event_type"])


# classifiers and scores

_SAMPLES = "(select event_id as id, case event_id % 12 when 0 then 'https://example.com/a' when 1 then event_id || ' tokens' when 2 then 'src/app/main.py' when 3 then 'A / B' when 4 then 'snake_case_' || event_id when 5 then 'RAG' when 6 then 'high risk' when 7 then '2024-01-0' || event_id % 10 when 8 then 'x@y.org' when 9 then 'plain words here' when 10 then 'user_relations' else ' ' end as t from events)"


def _samples(spark, d):
    n, m = F.col("event_id"), F.col("event_id") % 12
    s = lambda k, v: (m == k, v)
    rows = [s(0, F.lit("https://example.com/a")), s(1, F.concat(n.cast("string"), F.lit(" tokens"))), s(2, F.lit("src/app/main.py")), s(3, F.lit("A / B")), s(4, F.concat(F.lit("snake_case_"), n.cast("string"))), s(5, F.lit("RAG")), s(6, F.lit("high risk")), s(7, F.concat(F.lit("2024-01-0"), (n % 10).cast("string"))), s(8, F.lit("x@y.org")), s(9, F.lit("plain words here")), s(10, F.lit("user_relations"))]
    t = F.when(*rows[0])
    for r in rows[1:]:
        t = t.when(*r)
    return kb.table(spark, d, "events").select(n.alias("id"), t.otherwise(" ").alias("t"))


_KIND = "case when id % 12 in (0, 1, 2, 6, 7, 8) then 'literal' when id % 12 in (4, 5, 10) then 'entity' else 'unknown' end"


@query(f"select id, case when id % 50 = 9 and id % 12 <> 11 then 'entity' else {_KIND} end as object_class from {_SAMPLES}", prelude=False)
def object_classes(spark, d):
    return _samples(spark, d).select("id", classify.object_class(F.col("t"), F.col("id") % 50 == 9).alias("object_class"))


@query(f"select id, case when id % 12 in (0, 1, 2, 6, 7, 8, 10, 11) then 'drop' when id % 2 = 0 then 'keep' else 'review' end as eligibility from {_SAMPLES}", prelude=False)
def entity_eligibility(spark, d):
    return _samples(spark, d).select("id", classify.eligibility(F.col("t"), F.col("id") % 2 == 0).alias("eligibility"))


@query(f"select conv_id, turn, case when {_any('text', registry.RESEARCH_MARKERS)} then 'research' when {_any('text', registry.MULTI_HOP_MARKERS)} then 'structured_reasoning' when {_any('text', registry.TEMPORAL_MARKERS)} then 'structured_reasoning' else 'evidence_synthesis' end as route from conversations", prelude=False)
def query_route(spark, d):
    return kb.table(spark, d, "conversations").select("conv_id", "turn", classify.route(F.col("text")).alias("route"))


@query(f"select conv_id, turn, case when trim(text) = '' then 'unknown' when {_any('text', registry.KNOWLEDGE_MARKS, False)} then 'knowledge' when {_any('text', registry.CORRECT_MARKS, False)} then 'correct' when {_any('text', registry.RESEARCH_MARKS, False)} then 'research' when {_any('text', registry.QUESTION_MARKS, False)} and not {_any('text', registry.QUESTION_NEGATIONS, False)} then 'ask' else 'unknown' end as intent from conversations", prelude=False)
def intent(spark, d):
    return kb.table(spark, d, "conversations").select("conv_id", "turn", classify.intent(F.col("text")).alias("intent"))


_ANSWERS = "(select event_id as id, case event_id % 5 when 0 then '' when 1 then 'see [doc:a chunk:c' || event_id || '] and [doc:b chunk:c1]' when 2 then 'There is no evidence for this.' when 3 then 'I cannot answer that.' else 'It is ' || event_type end as a from events)"


def _answers(spark, d):
    n, m = F.col("event_id"), F.col("event_id") % 5
    a = F.when(m == 0, "").when(m == 1, F.concat(F.lit("see [doc:a chunk:c"), n.cast("string"), F.lit("] and [doc:b chunk:c1]"))).when(m == 2, "There is no evidence for this.").when(m == 3, "I cannot answer that.").otherwise(F.concat(F.lit("It is "), F.col("event_type")))
    return kb.table(spark, d, "events").select(n.alias("id"), a.alias("a"))


@query(f"select id, case when trim(a) = '' then 'unknown' when regexp_matches(a, '(?i){registry.INLINE_CITATION}') then 'non_refusal' when {_any('a', registry.INSUFFICIENT_MARKERS)} then 'insufficient_evidence' when {_any('a', registry.REFUSAL_MARKERS)} then 'refusal' else 'non_refusal' end as kind from {_ANSWERS}", prelude=False)
def refusal_kind(spark, d):
    return _answers(spark, d).select("id", classify.refusal(F.col("a"), F.lit(0)).alias("kind"))


@query(f"select id, array_to_string(case when a like 'see %' then case when id = 1 then ['c1'] else ['c' || id, 'c1'] end else [] end, ',') as chunks from {_ANSWERS}", prelude=False)
def inline_citations(spark, d):
    return _answers(spark, d).select("id", F.array_join(classify.inline_citations(F.col("a")), ",").alias("chunks"))


@query("select predicate, signal, case when signal is null then predicate else substr(predicate, length(signal) + 2) end as base from (select distinct case when event_id % 3 = 0 then 'former_' || event_type when event_id % 3 = 1 then event_type else 'next_' || event_type end as predicate, case when event_id % 3 = 0 then 'former' when event_id % 3 = 2 then 'next' end as signal from events)", prelude=False)
def predicate_resolution(spark, d):
    m = F.col("event_id") % 3
    p = F.when(m == 0, F.concat(F.lit("former_"), F.col("event_type"))).when(m == 1, F.col("event_type")).otherwise(F.concat(F.lit("next_"), F.col("event_type")))
    rows = kb.table(spark, d, "events").select(p.alias("predicate")).distinct()
    return rows.select("predicate", classify.temporal_signal(F.col("predicate")).alias("signal"), classify.without_signal(F.col("predicate")).alias("base"))


@query("select predicate, n, target, migratable from (select case when event_id % 3 = 0 then 'former_' || event_type else event_type end as predicate, count(*) as n, any_value(event_type) as target, any_value(event_id % 3 = 0) as migratable from events group by 1)", prelude=False)
def predicate_migration_plan(spark, d):
    p = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("former_"), F.col("event_type"))).otherwise(F.col("event_type"))
    census = kb.table(spark, d, "events").groupBy(p.alias("predicate")).agg(F.count("*").alias("n"))
    target = classify.without_signal(F.col("predicate"))
    return census.select("predicate", "n", target.alias("target"), (target != F.col("predicate")).alias("migratable"))


def _scored_claims(spark, d):
    """Claims with what their quality is made of; a third have no quote, a third a blank one."""
    c, i = kb.claims(spark, d), F.col("id")
    return c.select(
        "id", "confidence", "predicate", "object_text", F.when(i % 17 != 0, F.col("subject_id")).alias("subject_name"), F.lit("factual").alias("claim_type"), F.col("polarity"), F.when(i % 13 != 0, "asserted").alias("modality"), F.when(i % 9 != 0, "{}").alias("context"),
        F.col("object_id").alias("object_name"), F.when(i % 8 != 0, "d").alias("source_document_id"), F.when(i % 2 == 0, "k").alias("source_chunk_id"), F.when(i % 3 == 1, "quote").when(i % 3 == 2, "  ").alias("source_quote"),
        (i % 6 != 1).alias("quote_found"), (i % 10 != 0).alias("subject_known"), (i % 4 == 0).alias("subject_described"), (F.col("object_id").isNotNull() & (i % 7 != 1)).alias("object_known"),
        (i % 5 != 0).alias("predicate_registered"), (F.col("status") == "superseded").alias("is_superseded"), (i % 7 == 0).alias("conflict_live"),
    )


_SCORES = """, q as (select *, (id % 17 <> 0)::int + 1 + 1 + 1 + (id % 13 <> 0)::int + (id % 9 <> 0)::int + (confidence is not null)::int + (id % 8 <> 0)::int + (id % 3 = 1)::int as present, id % 3 <> 0 as quoted, coalesce(object_id, '') <> '' or coalesce(object_text, '') <> '' as obj from kb_claim)
, x as (select *, present / 9.0::double as sc, case when quoted and id % 2 = 0 then 1.0::double when quoted then 0.6::double else 0 end as ev, case when not quoted then 0 when id % 6 <> 1 then 1.0::double else 0.2::double end as qu,
 least(1.0::double, case when id % 10 <> 0 then 0.6::double else 0.1::double end + case when obj and object_id is not null and id % 7 <> 1 then 0.3::double when obj then 0.15::double else 0 end + case when id % 20 in (4, 8, 12, 16) then 0.1::double else 0 end) as en,
 (id % 5 <> 0)::int::double as pr, case when status = 'superseded' then 1.0::double when id % 7 = 0 then 0.3::double else 0.9::double end as co, 0.5::double * (id % 8 <> 0)::int + 0.3::double * (id % 2 = 0)::int + 0.2::double * (id % 3 = 1)::int as po from q)
, y as (select *, 0.15::double * sc + 0.2::double * ev + 0.15::double * qu + 0.15::double * en + 0.15::double * pr + 0.1::double * co + 0.1::double * po as exact from x)
, z as (select id, round(exact, 4) as overall, case when round(exact, 9) >= 0.85 then 'A' when round(exact, 9) >= 0.7 then 'B' when round(exact, 9) >= 0.5 then 'C' else 'D' end as grade,
 concat_ws(',', case when pr = 0 then 'predicate_unregistered' end, case when ev = 0 then 'no_evidence' end, case when quoted and qu < 1 then 'quote_not_localized' end, case when id % 7 = 0 then 'unresolved_conflict' end,
 case when status = 'superseded' then 'superseded' end, case when not obj then 'missing_object' end, case when confidence < 0.5 then 'low_confidence' end) as flags, pr = 0 or ev = 0 or id % 7 = 0 as critical from y)
"""


@query(_SCORES + "select id, overall, grade, flags from z")
def quality_scores(spark, d):
    return quality.quality(_scored_claims(spark, d)).select("id", "overall", "grade", "flags")


@query(_SCORES + "select id, overall from z where overall < 0.7 or critical order by overall, id limit 50")
def quality_review_queue(spark, d):
    q = quality.quality(_scored_claims(spark, d))
    return q.filter(quality.suggest_review(q)).select("id", "overall").orderBy("overall", "id").limit(50)


@query(""", s as (select id, id % 11 <> 0 as legal, id % 4 <> 0 as ev, round((20 * (id % 11 <> 0)::int + 15 * (id % 9 <> 0)::int + 15 * (id % 10 <> 0)::int + 20 * (id % 4 <> 0)::int + 15 * (id % 6 <> 1)::int + 10 * (id % 7 <> 0)::int + 5::double * case when id % 5 = 0 then 0 else least(greatest(floor(confidence * 100) / 50, 0), 1) end)::double / 100, 4) as score from kb_claim)
select id, score, case when not legal then 'reject' when score >= 0.8 then case when ev then 'accept' else 'review' end when score >= 0.5 then 'review' else 'reject' end as verdict from s""")
def quality_gate(spark, d):
    i = F.col("id")
    signals = kb.claims(spark, d).select("id", (i % 11 != 0).alias("ontology_valid"), (i % 9 != 0).alias("schema_complete"), (i % 10 != 0).alias("entity_resolved"), (i % 4 != 0).alias("evidence_found"), (i % 6 != 1).alias("quote_exact"), (i % 7 != 0).alias("no_contradiction"), F.when(i % 5 != 0, F.floor(F.col("confidence") * 100) / 50).alias("confidence"))
    return quality.gate(signals).select("id", "score", "verdict")


@query("""with a as (select event_id as id, event_id % 5 as m, event_id % 3 as n, event_id % 2 = 0 as odd_one, event_id % 7 <> 0 as loc, event_id % 4 = 0 as old from events where event_id > 1)
, x as (select *, n = 0 and m in (2, 3) as stop, case when n > 0 and loc then 1.0::double else 0 end as lo,
 case when n = 0 and m in (2, 3) then 1.0::double when n = 0 then 0.2::double when m <> 1 then 0.45::double when n = 2 and odd_one then 0.75::double else 1.0::double end as cov, case when n = 0 then 0 when not old then 1.0::double when n = 1 then 0 else 0.5::double end as cur from a)
, y as (select *, (0.25::double * lo + 0.3::double * cov + 0.15::double * cur) / (0.25::double + 0.3::double + 0.15::double) as exact from x)
select id as answer_id, n::bigint as n, lo as locatability, cov as coverage, cur as currentness, round(exact, 4) as overall, case when round(exact, 9) >= 0.85 then 'A' when round(exact, 9) >= 0.7 then 'B' when round(exact, 9) >= 0.5 then 'C' else 'D' end as grade,
 concat_ws(',', case when stop and m = 3 then 'refusal' end, case when stop and m = 2 then 'insufficient_evidence' end, case when n = 0 then 'no_citations' end, case when n > 0 and m <> 1 then 'no_inline_citations' end,
 case when n > 0 and (m <> 1 or n = 2 and odd_one) then 'uncited_evidence' end, case when n > 0 and cur < 1 then 'stale_source' end) as flags from y""", prelude=False)
def citation_validation(spark, d):
    answers = _answers(spark, d).filter("id > 1").select(F.col("id").alias("answer_id"), F.col("a").alias("answer"))
    i = F.col("answer_id")
    own, other = F.concat(F.lit("c"), i.cast("string")), F.when(i % 2 == 0, "z").otherwise("c1")
    cites = F.when(i % 3 == 1, F.array(F.lit("c1"))).when(i % 3 == 2, F.array(own, other)).otherwise(F.array().cast("array<string>"))
    citations = answers.select("answer_id", F.posexplode(cites).alias("k", "chunk_id")).select("answer_id", "chunk_id", (i % 7 != 0).alias("located"), ((i % 4 == 0) & (F.col("k") == 0)).alias("stale"))
    return quality.citation_report(answers, citations)


# context


@query("select id, (ceil(length(coalesce(content, '')) / 4.0))::bigint as tokens from kb_document")
def token_estimates(spark, d):
    return kb.documents(spark, d).select("id", tx.estimate_tokens(F.col("content")).alias("tokens"))


def _items(spark, d):
    i = F.col("event_id")
    share = lambda n: (i % n) / F.lit(float(n))
    e = kb.table(spark, d, "events")
    return context.valued(e.select(F.col("user_id").alias("context_id"), i.alias("id"), (i % 300 + 20).alias("tokens"), (i % 97 == 0).alias("required"), (i % 31).alias("fingerprint"), share(7).alias("relevance"), share(11).alias("gain"), share(5).alias("freshness"), share(3).alias("strength"), share(4).alias("priority")))


_ITEMS = "items as (select *, round(1000 * value / tokens, 6) as utility from (select user_id as context_id, event_id as id, event_id % 300 + 20 as tokens, event_id % 97 = 0 as required, event_id % 31 as fingerprint, round(0.35::double * ((event_id % 7) / 7.0::double) + 0.25::double * ((event_id % 11) / 11.0::double) + 0.15::double * ((event_id % 5) / 5.0::double) + 0.15::double * ((event_id % 3) / 3.0::double) + 0.1::double * ((event_id % 4) / 4.0::double), 9) as value from events))"


@query(f"with {_ITEMS} select context_id, id, value, utility, row_number() over (partition by context_id order by required desc, utility desc, tokens, id) as rank from items", prelude=False)
def context_value_rank(spark, d):
    w = Window.partitionBy("context_id").orderBy(F.col("required").desc(), F.col("utility").desc(), "tokens", "id")
    return _items(spark, d).withColumn("rank", F.row_number().over(w)).select("context_id", "id", "value", "utility", "rank")


@query(f"with {_ITEMS} select context_id, fingerprint, id from (select *, row_number() over (partition by context_id, fingerprint order by utility desc, id) as rn from items) where rn = 1", prelude=False)
def context_dedup(spark, d):
    return context.dedup(_items(spark, d)).select("context_id", "fingerprint", "id")


@query(f"""with recursive {_ITEMS}, o as (select *, row_number() over (partition by context_id order by (not required)::int, -utility, tokens, id) as rn from items)
, f as (select context_id, 0::bigint as rn, 0::bigint as used, null::bigint as id, false as took from (select distinct context_id from o)
 union all select o.context_id, o.rn, f.used + case when o.required or f.used + o.tokens <= 1500 then o.tokens else 0 end, o.id, o.required or f.used + o.tokens <= 1500 from f join o on o.context_id = f.context_id and o.rn = f.rn + 1)
select context_id, id, max(used) over (partition by context_id) as used from f where took""", prelude=False)
def context_allocate(spark, d):
    return context.allocate(_items(spark, d), 1500)


@query("select id, greatest(case when id % 3 = 0 or id % 7 = 0 then 3 else 1 end, case when confidence < 0.6 or id % 13 = 0 then 2 else 1 end)::int as level from kb_claim")
def evidence_levels(spark, d):
    i = F.col("id")
    return context.escalation(kb.claims(spark, d).select("id", "confidence", (i % 3 != 0).alias("has_quote"), (i % 7 == 0).alias("conflicted"), (i % 13 == 0).alias("conditional"))).select("id", "level")


@query("""select conv_id, count(*) as folded, arg_min(u, turn) filter (u is not null) as goal, arg_max(u, turn) filter (u is not null) as last_request, sum(ceil(length(text) / 4.0))::bigint as tokens from
 (select *, case when role = 'user' then substr(text, 1, 80) end as u, row_number() over (partition by conv_id order by turn desc) as rn from conversations) where rn > 4 group by conv_id""", prelude=False)
def conversation_compress(spark, d):
    return context.compress_history(kb.table(spark, d, "conversations"))


# evaluation


def _cases(spark, d):
    e = kb.table(spark, d, "events")
    g = e.groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct((F.col("event_id") * 7919 % 1009).alias("o"), "event_id"))).alias("r"), F.sort_array(F.collect_list(F.when(F.col("event_id") % 4 == 0, F.col("event_id")))).alias("relevant"))
    return g.select("id", F.transform("r", lambda x: x["event_id"]).alias("retrieved"), "relevant")


@query("""with r as (select user_id, event_id % 4 = 0 as rel, row_number() over (partition by user_id order by event_id * 7919 % 1009, event_id) as rank from events)
, c as (select user_id, count(*) filter (rel and rank <= 5) as hits, count(*) filter (rel) as relevant_n, least(5, count(*)) as returned, coalesce(1.0::double / min(rank) filter (rel), 0) as rr from r group by 1)
select count(*) as cases, round(sum(hits) / sum(relevant_n)::double, 4) as recall, round(sum(hits) / sum(returned)::double, 4) as precision, round(avg(rr), 4) as mrr from c""", prelude=False)
def retrieval_eval(spark, d):
    return evaluate.retrieval_report(_cases(spark, d), 5)


@query("""with x as (select n_chars < 120 as p, quality = 0 as t from documents join labels using (doc_id)), c as (select count(*) filter (p and t) as tp, count(*) filter (p and not t) as fp, count(*) filter (not p and t) as fn from x)
, m as (select *, round(case when tp + fp = 0 then 0 else tp / (tp + fp)::double end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn)::double end, 6) as recall from c)
select *, round(case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end, 6) as f1 from m""", prelude=False)
def label_eval(spark, d):
    x = kb.table(spark, d, "documents").select("doc_id", "n_chars").join(kb.table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return evaluate.precision_recall(x.select((F.col("n_chars") < 120).alias("p"), (F.col("quality") == 0).alias("t")), "p", "t")


@query("select suite, metric, value, pinned from (select event_type as suite, 'mean' as metric, round(avg(value), 6) as value, 50.0::double as pinned from events group by 1) where value < pinned - 1e-6", prelude=False)
def eval_regression(spark, d):
    cur = kb.table(spark, d, "events").groupBy(F.col("event_type").alias("suite")).agg(F.round(F.avg("value"), 6).alias("value")).withColumn("metric", F.lit("mean"))
    base = cur.select("suite", "metric", F.lit(50.0).alias("value"))
    return evaluate.regressions(cur, base).select("suite", "metric", "value", "pinned")


# search over knowledge


@query(_KEYED.replace("kb_claim)", "(select c.*, s.name as subject_name, o.name as object_name from kb_claim c join kb_entity s on s.id = c.subject_id left join kb_entity o on o.id = c.object_id) where status <> 'rejected')") + """
, r as (select *, contains(z, 'user-1')::int + contains(z, 'click')::int + contains(z, 'nation')::int as relevance, case status when 'superseded' then 3 when 'candidate' then 2 else 1 end as state from (select *, lower(concat_ws(' ', subject_name, predicate, object_name, object_text)) as z from k))
, b as (select *, count(*) over (partition by subject_id, predicate, coalesce(object_id, lower(object_text))) as members, row_number() over (partition by subject_id, predicate, coalesce(object_id, lower(object_text)) order by state, relevance desc, confidence desc, id) as rn from r where relevance > 0)
select id, subject_name, predicate, coalesce(object_name, object_text) as object, state::int as state, relevance::int as relevance, members from b where rn = 1 order by state, relevance desc, confidence desc, id limit 8""")
def search_knowledge(spark, d):
    return retrieval.knowledge(kb.claims(spark, d), kb.entities(spark, d), ["user-1", "click", "nation"], 8)


@query("select time_bucket(interval 1 hour, ts) as start, time_bucket(interval 1 hour, ts) + interval 1 hour as \"end\", event_type, count(*) as n from (select distinct on (event_id) * from events) group by all", prelude=False)
def windowed_counts(spark, d):
    from ..streaming.events import windowed_counts as counts

    return counts(kb.table(spark, d, "events"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return search_knowledge(spark, d)


from . import drafts, knowledge, reads, state  # noqa: E402, F401  they register their queries
