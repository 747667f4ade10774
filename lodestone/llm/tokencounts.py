"""Token counts: an exact length histogram whose suffix sums answer every context limit.

Documents are encoded whole; each task folds its lengths into (length, documents) pairs before the one
shuffle, so what moves follows the number of distinct lengths, not of documents. Suffix sums run in two
levels (blocks of lengths, then within each block), so no task sees the whole histogram.

Defined results: null or empty text has length ``end_tokens``; repeated rows count each time; ties share
a histogram row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, staged
from .tokens import encoder, vocabulary

BLOCK = 64


def length_histogram(docs: DataFrame, name: str = "byte_bpe_50k.json", end_tokens: int = 0) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length."""

    def fold(batches):
        own, found = encoder(vocabulary(name)), Counter()
        for b in batches:
            for _, _, _, bounds in own.runs(b.column(0)):
                found.update((np.diff(bounds) + end_tokens).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["n_tokens", "n_docs"])

    folded = documents(docs).select("text").mapInArrow(fold, "n_tokens long, n_docs long")
    return folded.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def context_limits(histogram: DataFrame, block: int = BLOCK) -> DataFrame:
    """For every distinct length as the context limit: documents and tokens up to it and beyond it.

    Columns: n_tokens, n_docs, docs_to (documents no longer), docs_over, tokens_to (tokens in documents no
    longer), tokens_total, truncated_total (sum of min(length, limit)), share_to (docs_to over all).
    Between two lengths the totals of the lower one hold: truncated = tokens_to + limit * docs_over.
    The histogram is used three times over, so it is written first, and documents are encoded once.
    """
    histogram = staged(histogram, "histogram")
    own = histogram.withColumn("block", F.floor(F.col("n_tokens") / block)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = own.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"))
    totals = own.agg(F.sum("n_docs").alias("docs_total"), F.sum("tokens").alias("tokens_total"))
    longer = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = own.join(blocks, "block").crossJoin(F.broadcast(totals))  # one row
    over = F.col("d_after") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))
    tokens_over = F.col("t_after") + F.coalesce(F.sum("tokens").over(longer), F.lit(0))
    out = out.withColumn("docs_over", over).withColumn("tokens_to", F.col("tokens_total") - tokens_over)
    return out.select(
        "n_tokens", "n_docs", (F.col("docs_total") - F.col("docs_over")).alias("docs_to"), "docs_over", "tokens_to", "tokens_total",
        (F.col("tokens_to") + F.col("n_tokens") * F.col("docs_over")).alias("truncated_total"),
        F.round((F.col("docs_total") - F.col("docs_over")) / F.col("docs_total"), 9).alias("share_to"),
    )


def truncated_total(limits: DataFrame, limit: int) -> DataFrame:
    """One row: the tokens left when every document is cut to ``limit`` tokens."""
    below = limits.filter(F.col("n_tokens") <= limit).agg(F.max_by(F.struct("tokens_to", "docs_over"), "n_tokens").alias("s"))
    whole = limits.agg(F.coalesce(F.max(F.col("docs_to") + F.col("docs_over")), F.lit(0)).alias("n"))
    return below.crossJoin(whole).select(F.coalesce(F.col("s.tokens_to") + limit * F.col("s.docs_over"), limit * F.col("n")).alias("truncated_total"))


def quantile(limits: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least a share ``q`` of documents doesn't exceed."""
    return limits.filter(F.col("docs_to") >= F.lit(q) * (F.col("docs_to") + F.col("docs_over"))).agg(F.min("n_tokens").alias("n_tokens"))
