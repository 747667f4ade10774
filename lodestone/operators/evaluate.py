"""Evaluation: ratios, ranked retrieval, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, 0.0).otherwise(num / den)


def precision_recall(labelled: DataFrame, predicted: str, truth: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of a boolean prediction."""
    n = lambda c: F.count(F.when(c, 1))
    p, t = F.col(predicted), F.col(truth)
    out = labelled.agg(n(p & t).alias("tp"), n(p & ~t).alias("fp"), n(~p & t).alias("fn"))
    out = out.withColumn("precision", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6))
    return out.withColumn("f1", F.round(F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))), 6))


def retrieval_cases(cases: DataFrame, k: int) -> DataFrame:
    """Per case (id, relevant, retrieved: arrays of ids): hits at k, recall, precision (over what was returned, at most k), reciprocal rank."""
    top = F.slice("retrieved", 1, k)
    hits = F.size(F.array_intersect(F.array_distinct(top), F.col("relevant")))
    first = F.array_min(F.filter(F.transform("retrieved", lambda x, i: F.when(F.array_contains(F.col("relevant"), x), i + 1)), lambda v: v.isNotNull()))
    return cases.select("id", hits.alias("hits"), F.size("relevant").alias("relevant_n"), F.least(F.lit(k), F.size("retrieved")).alias("returned"), F.coalesce(1.0 / first, F.lit(0.0)).alias("rr"))


def retrieval_report(cases: DataFrame, k: int) -> DataFrame:
    """Micro-averaged recall and precision at k, and mean reciprocal rank."""
    per = retrieval_cases(cases, k)
    return per.agg(F.count("*").alias("cases"), F.round(ratio(F.sum("hits"), F.sum("relevant_n")), 4).alias("recall"), F.round(ratio(F.sum("hits"), F.sum("returned")), 4).alias("precision"), F.round(F.avg("rr"), 4).alias("mrr"))


def regressions(current: DataFrame, baseline: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Metrics that fell below their baseline by more than the tolerance."""
    return current.join(baseline.withColumnRenamed("value", "pinned"), ["suite", "metric"]).filter(F.col("value") < F.col("pinned") - tolerance)
