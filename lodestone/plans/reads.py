"""Queries of the small reads and text functions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.udfs import quote_locator
from ..operators import classify, reads
from ..sources import tables as kb
from .queries import query


def _entities(spark, d):
    """Entities with a status, an eligibility (or none) and times, from customers."""
    k = F.col("c_custkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (k % n).cast("int"))
    return kb.table(spark, d, "customer").select(F.concat(F.lit("c:"), k.cast("string")).alias("id"), F.col("c_name").alias("name"), F.when(k % 3 == 0, "confirmed").otherwise("candidate").alias("status"), F.when(k % 4 == 1, "keep").when(k % 4 == 2, "review").alias("eligibility"), day(17).alias("created_at"), day(23).alias("updated_at"))


_ENTITIES = """, en as (select 'c:' || c_custkey as id, c_name as name, case when c_custkey % 3 = 0 then 'confirmed' else 'candidate' end as status, case c_custkey % 4 when 1 then 'keep' when 2 then 'review' end as eligibility,
 date '2024-01-01' + (c_custkey % 17)::int as created_at, date '2024-01-01' + (c_custkey % 23)::int as updated_at from customer)
"""


@query(_ENTITIES + "select id, eligibility from (select * from en where status = 'candidate' order by created_at desc, id limit 100) where eligibility is null or eligibility <> 'keep'")
def entity_review_pool(spark, d):
    return reads.review_pool(_entities(spark, d), 100).select("id", "eligibility")


@query(_ENTITIES + "select id from (select * from en order by updated_at desc, id limit 120) where eligibility = 'keep'")
def entity_semantic_pool(spark, d):
    return reads.semantic_pool(_entities(spark, d), 120).select("id")


@query(_ENTITIES + "select id, name from en where id <> 'c:22' order by updated_at desc, id limit 80")
def entity_similarity_pool(spark, d):
    return reads.similarity_pool(_entities(spark, d), "c:22", 80).select("id", "name")


@query(_ENTITIES + "select id, case when id = 'c:5' then 'renamed' else name end as name, status from en")
def entity_update(spark, d):
    return reads.updated(_entities(spark, d), "c:5", {"name": F.lit("renamed"), "status": F.lit("gone")}, frozenset({"name"})).select("id", "name", "status")


@query(_ENTITIES + "select id, case when id in ('c:3', 'c:6') and status = 'confirmed' or id in ('c:4', 'c:5') and status = 'archived' then 'archived' else status end as status from en")
def status_compare_and_set(spark, d):
    wanted = spark.createDataFrame([("c:3", "archived", "confirmed"), ("c:6", "archived", "confirmed"), ("c:4", "archived", "archived"), ("c:5", "archived", "archived")], "id string, status string, only_if string")
    return reads.compare_and_set(_entities(spark, d), wanted).select("id", "status")


@query("select c.id, s.name as subject_name, c.predicate, coalesce(o.name, c.object_text) as object from (select * from kb_claim where status = 'verified' order by created_at desc, id limit 40) c join kb_entity s on s.id = c.subject_id left join kb_entity o on o.id = c.object_id")
def claims_newest(spark, d):
    return reads.newest_claims(kb.claims(spark, d), kb.entities(spark, d), 40, "verified").select("id", "subject_name", "predicate", F.coalesce("object_name", "object_text").alias("object"))


@query("select id, title from kb_document where source = 'src1' order by id limit 1")
def document_by_origin(spark, d):
    return reads.by_source_uri(kb.documents(spark, d), "src1", "source").select("id", "title")


@query("select id, coalesce(object_id, case when id % 2 = 0 then 'n:' || id % 25 end) as object_id from kb_claim")
def claims_linked_if_free(spark, d):
    c = kb.claims(spark, d)
    links = c.filter("id % 2 = 0").select("id", F.concat(F.lit("n:"), (F.col("id") % 25).cast("string")).alias("entity_id"))
    return reads.linked(c, links).select("id", "object_id")


@query("select id, subject_id, (3 - substr(subject_id, 3)::bigint % 3) % 3 as ord from kb_claim where substr(subject_id, 3)::bigint < 30")
def claims_for_keys(spark, d):
    # each key comes twice; its first place counts
    n = F.substring("id", 3, 20).cast("long")
    users = kb.entities(spark, d).filter("type = 'Person'").select(F.col("id").alias("subject_id"), n.alias("n")).filter("n < 30")
    keys = users.select("subject_id", ((3 - F.col("n") % 3) % 3).alias("ord")).union(users.select("subject_id", F.lit(9).cast("long")))
    return reads.for_keys(kb.claims(spark, d), keys, "subject_id").select("id", "subject_id", "ord")


@query("select id from kb_claim where id % 6 <> 1 and id % 6 <> 4")
def derived_rows_without_chunks(spark, d):
    c = kb.claims(spark, d).withColumn("source_chunk_id", F.col("id") % 6)
    return reads.delete_for_chunks(c, spark.createDataFrame([(1,), (4,), (4,)], "id long")).select("id")


@query("select c.id as claim_id, 'q' || c.id as source_quote, e.name as subject_name, c.predicate from kb_claim c join kb_entity e on e.id = c.subject_id where c.id % 5 = 2 and c.id % 3 <> 0 order by c.created_at desc, c.id limit 100")
def document_quotes(spark, d):
    c = kb.claims(spark, d).withColumn("source_document_id", (F.col("id") % 5).cast("string")).withColumn("source_quote", F.when(F.col("id") % 3 != 0, F.concat(F.lit("q"), F.col("id").cast("string"))))
    return reads.quoted_spans(c, kb.entities(spark, d), "2")


_LOCATED = "select distinct r.source_id, r.predicate, r.target_id, a.name as source_name, b.name as target_name from kb_relation r join kb_entity a on a.id = r.source_id join kb_entity b on b.id = r.target_id"


@query(_LOCATED + " where r.source_id in ('n:1', 'n:2', 'r:1') or r.target_id in ('n:1', 'n:2', 'r:1')")
def incident_edges(spark, d):
    ids = spark.createDataFrame([("n:1",), ("n:2",), ("r:1",), ("n:1",)], "id string")
    return reads.incident_edges(kb.relations(spark, d), ids, kb.entities(spark, d))


@query(_LOCATED + " where r.predicate <> 'supplies'")
def named_edges(spark, d):
    return reads.named_edges(kb.relations(spark, d).filter("predicate <> 'supplies'"), kb.entities(spark, d))


@query(f""", ed as ({_LOCATED}), h1 as (select *, 1 as hop from ed where source_id = 'n:1' or target_id = 'n:1' order by source_id, predicate, target_id limit 12)
, f1 as (select source_id as id from h1 union select target_id from h1)
, h2 as (select *, 2 as hop from ed where (source_id in (select id from f1 where id <> 'n:1') or target_id in (select id from f1 where id <> 'n:1'))
 and (source_id, predicate, target_id) not in (select (source_id, predicate, target_id) from h1) order by source_id, predicate, target_id limit 12)
select * from h1 union all select * from h2""")
def graph_edges_limited(spark, d):
    return reads.limited_neighborhood(kb.relations(spark, d), kb.entities(spark, d), "n:1", 2, 12)


_PAIRS = """, pr as (select case when a.c_custkey % 2 = 0 then a.c_custkey else b.c_custkey end as a_id, case when a.c_custkey % 2 = 0 then b.c_custkey else a.c_custkey end as b_id, round(1.0::double / (1 + abs(a.c_acctbal - b.c_acctbal)), 6) as similarity
 from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_mktsegment = b.c_mktsegment and a.c_custkey < b.c_custkey)"""


@query(_PAIRS + " select a_id, b_id, similarity from pr where (a_id + b_id) % 5 <> 0 order by similarity desc, a_id, b_id limit 40")
def undecided_pairs(spark, d):
    """Customers of one nation and segment, the two named in one order or the other; decided ones are named the other way round."""
    c = kb.table(spark, d, "customer").select("c_nationkey", "c_mktsegment", F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"))
    decided = lambda pairs: pairs.filter((F.col("a_id") + F.col("b_id")) % 5 == 0).select(F.col("b_id").alias("a_id"), F.col("a_id").alias("b_id"))
    return reads.closest_undecided(c, ["c_nationkey", "c_mktsegment"], lambda x, y: F.when(x % 2 == 0, x).otherwise(y), decided, 40)


@query("select surface, id from (values ('EUROPE', 'r:3'), (' asia ', 'r:2'), ('gaul', 'n:6'), ('asia', 'r:2'), ('nowhere', null), ('', null)) t(surface, id)", prelude=False)
def entity_resolve_first(spark, d):
    surfaces = spark.createDataFrame([("EUROPE",), (" asia ",), ("gaul",), ("asia",), ("nowhere",), ("",), ("gaul",)], "surface string")
    aliases = spark.createDataFrame([("n:6", "Gaul"), ("n:9", "Europe"), ("n:7", "")], "id string, alias string")
    return reads.resolve_first(surfaces, kb.entities(spark, d), aliases)


@query("select id, predicate from kb_claim where subject_id = 'n:3' or object_id = 'n:3' order by created_at desc, id limit 100")
def claims_of_entity(spark, d):
    return reads.claims_of_entity(kb.claims(spark, d), "n:3").select("id", "predicate")


@query("select id, predicate from (select *, row_number() over (partition by id % 40 order by confidence desc, id) as rn from kb_claim) where rn <= 3")
def claims_capped_per_chunk(spark, d):
    c = kb.claims(spark, d).withColumn("chunk", F.col("id") % 40)
    return reads.capped(c, "chunk", 3, F.col("confidence").desc(), "id").select("id", "predicate")


@query("select event_id as chunk_id, case when row_number() over (partition by user_id order by event_id * 31 % 1009, event_id) > 2 then 'document_cap' end as dropped from events", prelude=False)
def evidence_document_cap(spark, d):
    hits = kb.table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("chunk_id"), (F.col("event_id") * 31 % 1009).alias("arrival"))
    return reads.capped_evidence(hits).select("chunk_id", "dropped")


@query("""select o as origin, string_agg(name, '|' order by at_) as names, sum(n)::bigint as claims, sum(p)::bigint as pending from (select c.id % 50 as o, e.name, min(c.id) as at_, count(*) as n, count(*) filter (c.status = 'candidate') as p
 from kb_claim c join kb_entity e on e.id = c.subject_id group by 1, 2) group by o""")
def document_contribution(spark, d):
    return reads.contribution(kb.claims(spark, d).withColumn("origin", F.col("id") % 50), kb.entities(spark, d), "origin")


@query("select count(*) as entities, count(*) filter (id not in (select subject_id from kb_claim union select object_id from kb_claim where object_id is not null)) as unsupported, round(count(*) filter (id not in (select subject_id from kb_claim union select object_id from kb_claim where object_id is not null)) / count(*)::double, 3) as rate from kb_entity")
def unsupported_entities(spark, d):
    return reads.unsupported_rate(kb.entities(spark, d), kb.claims(spark, d))


@query("select status, count(*) as n from kb_claim group by status")
def claims_by_status(spark, d):
    return reads.counts_by(kb.claims(spark, d), "status")


# text functions. Values beside their results, worked out by hand from the rules.

_FINGERPRINTED = "select id, substr(sha1(trim(regexp_replace(content, '\\s+', ' ', 'g'))), 1, 12) as fingerprint from kb_document where content is not null"


@query(_FINGERPRINTED)
def content_fingerprints(spark, d):
    return kb.documents(spark, d).filter("content is not null").select("id", tx.fingerprint(F.col("content")).alias("fingerprint"))


@query("select id, substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 240) as preview from kb_document where trim(content) <> ''")
def evidence_previews(spark, d):
    docs = kb.documents(spark, d).filter("trim(content) <> ''")
    return docs.select("id", tx.preview(F.lit("  "), F.lit(None).cast("string"), F.col("content")).alias("preview"))


@query("select doc_id, doc_id % 7 + ceil(length(text) / 4)::bigint as tokens from documents", prelude=False)
def token_estimates_wide(spark, d):
    wide = F.concat(F.expr("repeat('字', cast(doc_id % 7 as int))"), F.col("text"))
    return kb.table(spark, d, "documents").select("doc_id", tx.estimate_tokens(wide).alias("tokens"))


@query(r"""with t as (select conv_id, turn, replace(text, '. ', '.' || chr(10)) as t, (turn % 9 + 1) * 3 as most from conversations), c as (select *, t[1:4 * most] as cut from t),
l as (select *, length(cut) - position(chr(10) in reverse(cut)) as line from c)
select conv_id, turn, case when ceil(length(t) / 4) <= most then t else regexp_replace(case when contains(cut, chr(10)) and line > length(cut) // 2 then cut[1:line] else cut end, '\s+$', '') end as t from l""", prelude=False)
def token_truncation(spark, d):
    turns = kb.table(spark, d, "conversations").withColumn("t", F.replace("text", F.lit(". "), F.lit(".\n")))
    return turns.select("conv_id", "turn", tx.truncate_to_tokens(F.col("t"), ((F.col("turn") % 9 + 1) * 3).cast("int")).alias("t"))


_QUOTED = """with q as (select conv_id, turn, text, conv_id * 1000 as s, conv_id * 1000 + length(text) as e, trim(text[5:24]) as piece, case turn % 4 when 0 then ' ' || text[5:24] || ' ' when 1 then replace(trim(text[5:24]), ' ', '   ') when 2 then replace(upper(trim(text[5:24])), ' ', '-') else 'zzzz qqqq' end as quote from conversations)
select conv_id, turn, case when turn % 4 = 0 or turn % 4 = 1 and not contains(piece, ' ') then s + position(piece in text) - 1 else s end as start,
 case when turn % 4 = 0 or turn % 4 = 1 and not contains(piece, ' ') then s + position(piece in text) - 1 + length(piece) else e end as "end", turn % 4 < 3 as found from q"""


@query(_QUOTED, prelude=False)
def quote_localisation(spark, d):
    """Quotes as they stand, with wider blanks, in capitals with other signs, and of nothing that is there; a line end at a quote's edge is part of it."""
    piece = F.trim(F.substring("text", 5, 20))
    kind = F.col("turn") % 4
    quote = F.when(kind == 0, F.concat(F.lit(" "), F.substring("text", 5, 20), F.lit(" "))).when(kind == 1, F.replace(piece, F.lit(" "), F.lit("   "))).when(kind == 2, F.replace(F.upper(piece), F.lit(" "), F.lit("-"))).otherwise("zzzz qqqq")
    start = F.col("conv_id") * 1000
    at = quote_locator(" ")(F.col("text"), quote, start, start + F.length("text"))
    return kb.table(spark, d, "conversations").select("conv_id", "turn", at.alias("p")).select("conv_id", "turn", "p.start", "p.end", "p.found")


@query(r"""with t as (select doc_id, text, split_part(text, ' ', 40) as anchor from documents),
p as (select *, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([。！？!?；;])', '\1' || chr(10), 'g'), '(\.\s)', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as parts, regexp_replace(anchor, '^\s+|\s+$', '', 'g')[1:24] as needle from t),
i as (select *, greatest(coalesce(case when needle <> '' then list_position(list_transform(parts, lambda x: contains(x, needle)), true) end, 1), 1) as i from p)
select doc_id, coalesce(array_to_string(parts[greatest(i - 1, 1):i + 1], ''), '') as w from i""", prelude=False)
def sentence_windows(spark, d):
    anchor = F.split_part("text", F.lit(" "), F.lit(40))
    return kb.table(spark, d, "documents").select("doc_id", tx.sentence_window(F.col("text"), anchor).alias("w"))


@query("""with t as (select conv_id, turn, case turn % 4 when 0 then []::varchar[] when 1 then ['user'] else [role] end as a, case conv_id % 3 when 0 then []::varchar[] when 1 then ['user', 'x'] else ['assistant'] end as b from conversations)
select conv_id, turn, len(a) = 0 or len(b) = 0 or list_has_any(a, b) as ok from t""", prelude=False)
def type_compatibility(spark, d):
    none = F.array().cast("array<string>")
    a = F.when(F.col("turn") % 4 == 0, none).when(F.col("turn") % 4 == 1, F.array(F.lit("user"))).otherwise(F.array("role"))
    b = F.when(F.col("conv_id") % 3 == 0, none).when(F.col("conv_id") % 3 == 1, F.array(F.lit("user"), F.lit("x"))).otherwise(F.array(F.lit("assistant")))
    return kb.table(spark, d, "conversations").select("conv_id", "turn", tx.types_compatible(a, b).alias("ok"))


@query("select event_id, case event_type when 'view' then 'seen' when 'click' then 'click' when 'purchase' then 'buy' end as v from events", prelude=False)
def enum_canonical(spark, d):
    written = F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" "))
    return kb.table(spark, d, "events").select("event_id", tx.canonical(written, ("click", "seen", "buy"), {"view": "seen", "purchase": "buy"}).alias("v"))


#: (text, its class, whether its name drops) by the rules for objects and names.
_OBJECTS = (
    ("https://example.com/a", "literal", True), ("12 tokens", "literal", True), ("src/app/main.py", "literal", True), ("A / B", "unknown", False), ("snake_case", "entity", False), ("RAG", "entity", False),
    ("high risk", "literal", True), ("2024-01-05", "literal", True), ("x@y.org", "literal", True), ("plain words here", "unknown", False), ("user_relations", "entity", True), (" ", "unknown", True),
    ("runtime.md", "literal", True), ("one/two/three", "literal", True), ("pkg/mod.py::Thing", "literal", True), ("src\\core\\util", "literal", True), ("客户端/服务端", "unknown", True), ("12 条", "literal", True),
    ("订单状态", "unknown", True), ("现在", "unknown", True), ("this, that", "unknown", True), ("HTTP2", "entity", False), ("camelCase name two", "entity", False), ("a/b", "unknown", True), ("仅在生产环境", "literal", True),
    ("Use HTTP2! now", "unknown", False), ("one two three camelCase", "unknown", False), ("C:\\x", "literal", False), ("~/notes", "literal", True), ("50％", "literal", True), ("张三", "unknown", False),
)
_OBJECT_SQL = ", ".join(f"({k}, '{c}', '{'drop' if drop or c == 'literal' else 'keep'}', {str(not drop and c != 'literal').lower()})" for k, (_, c, drop) in enumerate(_OBJECTS))


@query(f"select event_id, c as object_class, e as eligibility, p as plausible from events join (values {_OBJECT_SQL}) t(id, c, e, p) on id = event_id % {len(_OBJECTS)}", prelude=False)
def object_rules(spark, d):
    """The forms, whose classes were worked out by hand, as the objects of all events."""
    form = F.element_at(F.array(*[F.lit(t) for t, _, _ in _OBJECTS]), (F.col("event_id") % len(_OBJECTS) + 1).cast("int"))
    df = kb.table(spark, d, "events").select("event_id", form.alias("t"))
    return df.select("event_id", classify.object_class(F.col("t"), F.lit(False)).alias("object_class"), classify.eligibility(F.col("t"), F.lit(True)).alias("eligibility"), classify.plausible_subject(F.col("t")).alias("plausible"))
