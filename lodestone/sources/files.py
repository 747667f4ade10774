"""File sources and sinks: documents from folders, golden sets, table export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.udfs import html_text

TEXT, HTML = ("md", "markdown", "txt", "text"), ("html", "htm")


def import_documents(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, content of the text and HTML files under a folder; undecodable bytes are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,markdown,txt,text,html,htm}").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.element_at(F.split(name, "\\."), -1))
    text = raw.select("path", name.alias("name"), kind.alias("kind"), F.decode(F.col("content"), F.lit("UTF-8")).alias("content"))
    plain = text.filter(F.col("kind").isin(*TEXT)).drop("kind")
    return plain.unionByName(text.filter(F.col("kind").isin(*HTML)).withColumn("content", html_text("content")).drop("kind"))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a golden-set file, one row each."""
    return spark.read.json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")


def export_json(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as JSON lines in a folder of its name, ordered by its first column within files."""
    for name, df in tables.items():
        df.sortWithinPartitions(df.columns[0]).write.mode("overwrite").json(f"{folder}/{name}")


def insert_documents(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` whose content isn't stored yet, one for each content (the smallest id)."""
    hashed = new.withColumn("content_hash", F.sha2("content", 256))
    first = hashed.groupBy("content_hash").agg(F.min("id").alias("id"))
    return hashed.join(first, ["content_hash", "id"], "left_semi").join(stored.select("content_hash"), "content_hash", "left_anti")
