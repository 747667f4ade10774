"""A training-data pipeline over ``documents``: quality rules, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next one's docs; all but the last return the columns of ``documents``.

Defined results: null or empty text is rejected by the first stage; a null doc_id takes part in no group and stays;
of near copies the row with the smallest doc_id stays, of one id the first; rows of one id and unlike texts all stay; a null source counts as
the source '' in the mixing; very long texts go through whole; an empty table gives no rows; columns beside those of
``documents``, whatever their names, are left out at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard, mixing, packing, quality, secrets
from lodestone.llm.common import staged, table

#: Rows: the pieces of packed sequences. Mixing orders by Spark's hash and packing encodes: no SQL.
ORACLE_SQL = None

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality.keep(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest doc_id, of one id the first. Rows without id, or without words, stay as they are.

    Rows, not ids, are compared and dropped: two rows of one id may hold different texts. A row is known by its place
    in ``docs``, which are read from files, so that it is the same each time.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *COLUMNS)
    known = rows.filter("doc_id is not null")
    found = jaccard.similar_components(known.select(F.col("_row").alias("doc_id"), "text")).filter("n_shingles > 0")
    at = found.select(F.col("doc_id").alias("_row"), "component_id").join(known.select("_row", "doc_id"), "_row")
    best = at.groupBy("component_id").agg(F.min(F.struct("doc_id", "_row")).alias("best"))
    gone = at.select("_row").join(best.select("best._row"), "_row", "left_anti")
    return rows.join(gone, "_row", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    return secrets.redact(docs.select(*COLUMNS))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought nearer to equal weight: every document passes at least once, those of small sources up to twice."""
    return mixing.mix(docs.select(*COLUMNS), budget=None).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("source_mixing", source_mixing), ("sequence_packing", sequence_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
