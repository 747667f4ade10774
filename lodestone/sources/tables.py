"""The knowledge-base relations, projected from the tables of an analytics store."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, content, source, source_type, content_hash."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"), "source", F.col("lang").alias("source_type"), F.sha2("text", 256).alias("content_hash"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, type, name."""
    t = lambda n: table(spark, sf_dir, n)
    row = lambda df, mark, key, kind, name: df.select(F.concat(F.lit(mark + ":"), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"), name.alias("name"))
    users = t("events").select("user_id").distinct()
    parts = [
        row(t("region"), "r", "r_regionkey", "Location", F.col("r_name")), row(t("nation"), "n", "n_nationkey", "Location", F.col("n_name")),
        row(t("customer"), "c", "c_custkey", "Organization", F.col("c_name")), row(t("supplier"), "s", "s_suppkey", "Organization", F.col("s_name")),
        row(t("part"), "p", "p_partkey", "Product", F.col("p_name")), row(users, "u", "user_id", "Person", F.concat(F.lit("user-"), F.col("user_id").cast("string"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, subject_id, predicate, object_id or object_text, confidence, polarity, status, created_at."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    digit = F.col("event_id") % 10
    return e.select(
        F.col("event_id").alias("id"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("subject_id"), F.col("event_type").alias("predicate"),
        F.when(k < 25, F.concat(F.lit("n:"), k.cast("string"))).alias("object_id"), F.when(k >= 25, k.cast("string")).alias("object_text"),
        F.least(F.greatest(F.col("value") / 100.0, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.when(F.col("event_id") % 7 == 0, "negative").otherwise("positive").alias("polarity"),
        F.when(digit == 0, "rejected").when(digit <= 2, "superseded").when(digit <= 5, "candidate").otherwise("verified").alias("status"),
        F.col("ts").alias("created_at"),
    )


def claim_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id (newer), target_id (older), relationship, status, created_at: consecutive claims of a subject and predicate."""
    w = Window.partitionBy("subject_id", "predicate").orderBy("created_at", "id")
    c = claims(spark, sf_dir).withColumn("target_id", F.lag("id").over(w)).filter("target_id is not null")
    kind = F.element_at(F.array(*map(F.lit, ("supersedes", "contradicts", "duplicate", "coexists"))), (F.col("id") % 4 + 1).cast("int"))
    return c.select(F.col("id").alias("source_id"), "target_id", "subject_id", "predicate", kind.alias("relationship"), F.when(F.col("id") % 2 == 0, "accepted").otherwise("candidate").alias("status"), "created_at")


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, predicate, target_id: supplies, located_in, part_of."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda mark, c: F.concat(F.lit(mark + ":"), F.col(c).cast("string"))
    row = lambda df, a, p, b: df.select(a.alias("source_id"), F.lit(p).alias("predicate"), b.alias("target_id"))
    supplies = row(t("lineitem").select("l_suppkey", "l_partkey").distinct(), key("s", "l_suppkey"), "supplies", key("p", "l_partkey"))
    located = row(t("customer"), key("c", "c_custkey"), "located_in", key("n", "c_nationkey")).unionByName(row(t("supplier"), key("s", "s_suppkey"), "located_in", key("n", "s_nationkey")))
    return supplies.unionByName(located).unionByName(row(t("nation"), key("n", "n_nationkey"), "part_of", key("r", "n_regionkey")))


#: The same projections for a SQL engine, as common table expressions.
SQL = """
kb_document as (select doc_id as id, source || '-' || doc_id as title, text as content, source, lang as source_type, sha256(text) as content_hash from documents),
kb_entity as (select 'r:' || r_regionkey as id, 'Location' as type, r_name as name from region union all select 'n:' || n_nationkey, 'Location', n_name from nation
  union all select 'c:' || c_custkey, 'Organization', c_name from customer union all select 's:' || s_suppkey, 'Organization', s_name from supplier
  union all select 'p:' || p_partkey, 'Product', p_name from part union all select 'u:' || user_id, 'Person', 'user-' || user_id from (select distinct user_id from events)),
kb_claim as (select event_id as id, 'u:' || user_id as subject_id, event_type as predicate, case when k < 25 then 'n:' || k end as object_id, case when k >= 25 then k::varchar end as object_text,
  least(greatest(value / 100.0, 0.0), 1.0) as confidence, case when event_id % 7 = 0 then 'negative' else 'positive' end as polarity,
  case when event_id % 10 = 0 then 'rejected' when event_id % 10 <= 2 then 'superseded' when event_id % 10 <= 5 then 'candidate' else 'verified' end as status, ts as created_at
  from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)),
kb_claim_relation as (select id as source_id, target_id, subject_id, predicate, ['supersedes', 'contradicts', 'duplicate', 'coexists'][(id % 4 + 1)::int] as relationship,
  case when id % 2 = 0 then 'accepted' else 'candidate' end as status, created_at
  from (select *, lag(id) over (partition by subject_id, predicate order by created_at, id) as target_id from kb_claim) where target_id is not null),
kb_relation as (select distinct 's:' || l_suppkey as source_id, 'supplies' as predicate, 'p:' || l_partkey as target_id from lineitem
  union all select 'c:' || c_custkey, 'located_in', 'n:' || c_nationkey from customer union all select 's:' || s_suppkey, 'located_in', 'n:' || s_nationkey from supplier
  union all select 'n:' || n_nationkey, 'part_of', 'r:' || n_regionkey from nation)
"""
