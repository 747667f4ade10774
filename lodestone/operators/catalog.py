"""Counts, series, usage, health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    one = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, one)


def daily(rows: DataFrame, ts: str, first: str, last: str) -> DataFrame:
    """day and n from ``first`` to ``last``, zero where nothing happened."""
    spine = rows.sparkSession.sql(f"select explode(sequence(date'{first}', date'{last}', interval 1 day)) as day")
    counts = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    return spine.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def usage_by(runs: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """Runs (distinct), steps and tokens of each key; steps are summed per run before the join."""
    per = steps.groupBy("run_id").agg(F.count("*").alias("steps"), F.sum("prompt_tokens").alias("prompt"), F.sum("completion_tokens").alias("completion"))
    out = runs.join(per, "run_id", "left").groupBy(key).agg(F.count("*").alias("runs"), F.coalesce(F.sum("steps"), F.lit(0)).alias("steps"), F.coalesce(F.sum("prompt"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion"), F.lit(0)).alias("completion_tokens"))
    return out.withColumn("tokens_per_run", F.round((F.col("prompt_tokens") + F.col("completion_tokens")) / F.col("runs"), 6))


def roll_up(runs: DataFrame, steps: DataFrame) -> DataFrame:
    per = steps.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("prompt_tokens").alias("p"), F.sum("completion_tokens").alias("c"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return runs.join(per, "run_id", "left").select("run_id", zero("n").alias("steps"), zero("p").alias("prompt_tokens"), zero("c").alias("completion_tokens"))


def latest(rows: DataFrame, key: str, value: Column, ts: str, tie: str) -> DataFrame:
    """The latest value of each key, without a sort."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(ts, tie)).alias("last_value"), F.max(ts).alias("last_at"), F.count("*").alias("n"))


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage, 0 where there is no whole."""
    return F.when(whole == 0, 0.0).otherwise(F.round(100.0 * part / whole, digits))


def health(claims: DataFrame) -> DataFrame:
    n, verified, free = F.count("*"), F.count(F.when(F.col("status") == "verified", 1)), F.count(F.when(F.col("object_id").isNull(), 1))
    return claims.agg(n.alias("claims"), verified.alias("verified"), free.alias("free_text"), share(verified, n, 4).alias("verified_share"), share(free, n, 4).alias("free_text_share"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def next_index(steps: DataFrame, key: str, order: str) -> DataFrame:
    return steps.withColumn("step_index", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """removed, added and kept rows between two snapshots."""
    b, a = before.select(*keys).distinct().withColumn("b", F.lit(1)), after.select(*keys).distinct().withColumn("a", F.lit(1))
    return b.join(a, keys, "full").select(*keys, F.when(F.col("a").isNull(), "removed").when(F.col("b").isNull(), "added").otherwise("kept").alias("outcome"))
