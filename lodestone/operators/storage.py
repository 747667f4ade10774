"""Document storage: duplicates, chunks with exact offsets, incremental diff, versions, embedding cache, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.udfs import chunks


def exact_dedup(docs: DataFrame) -> DataFrame:
    """The first id of each content; contents are compared by hash, so texts aren't shuffled."""
    return docs.groupBy("content_hash").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """document_id, chunk_index, start_offset, end_offset, content, content_hash."""
    out = docs.select(F.col("id").alias("document_id"), F.posexplode(chunks("content")).alias("chunk_index", "c"))
    return out.select("document_id", "chunk_index", "c.start_offset", "c.end_offset", "c.content").withColumn("content_hash", F.sha2("content", 256))


def diff_chunks(stored: DataFrame, target: DataFrame) -> DataFrame:
    """outcome of each (document_id, chunk_index): unchanged, changed (a null stored hash too), created, removed."""
    s = stored.select("document_id", "chunk_index", F.col("content_hash").alias("old"), F.lit(True).alias("was"))
    t = target.select("document_id", "chunk_index", F.col("content_hash").alias("new"), F.lit(True).alias("is"))
    both = s.join(t, ["document_id", "chunk_index"], "full")
    outcome = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return both.select("document_id", "chunk_index", outcome.alias("outcome"))


def sync_chunks(stored: DataFrame, target: DataFrame) -> DataFrame:
    """The chunk table after a diff: unchanged rows keep their extraction_version, new and changed ones have none."""
    kept = stored.select("document_id", "chunk_index", "content_hash", "extraction_version")
    return target.join(kept, ["document_id", "chunk_index", "content_hash"], "left")


def stale(chunk_rows: DataFrame, version: str) -> DataFrame:
    return chunk_rows.filter(F.col("extraction_version").isNull() | (F.col("extraction_version") != version))


def cache_misses(rows: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct contents without an embedding by ``model``."""
    return rows.select("content_hash").distinct().join(cache.filter(F.col("model") == model).select("content_hash"), "content_hash", "left_anti")


def backfill(chunk_rows: DataFrame, embedded: DataFrame) -> DataFrame:
    """Documents that have chunks, none of them embedded."""
    return chunk_rows.select("document_id").distinct().join(embedded.select("document_id"), "document_id", "left_anti")


def delete_derived(derived: DataFrame, documents: DataFrame) -> DataFrame:
    return derived.join(documents.select("document_id"), "document_id", "left_anti")


def keep_latest(rows: DataFrame, key: str, version: str, n: int) -> DataFrame:
    """The ``n`` highest versions of each key."""
    w = Window.partitionBy(key).orderBy(F.col(version).desc())
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def conform(df: DataFrame, schema) -> DataFrame:
    """``df`` under a schema: missing columns null, others cast, in the schema's order."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])
