"""Context assembly: value, duplicates, budgets, history."""

from __future__ import annotations

from functools import reduce

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import registry
from ..functions.text import truncate_to_tokens
from .folds import ordered_fold


def valued(items: DataFrame) -> DataFrame:
    """Items with value and utility (value per token, by a thousand)."""
    w = registry.CONTEXT_WEIGHTS
    value = reduce(lambda a, b: a + b, [F.lit(v) * F.col(k) for k, v in w.items()])
    return items.withColumn("value", F.round(value, 9)).withColumn("utility", F.round(1000 * F.col("value") / F.greatest(F.col("tokens"), F.lit(1)), 6))


def dedup(items: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Of equal content in a context the item of highest utility."""
    w = Window.partitionBy("context_id", key).orderBy(F.col("utility").desc(), "id")
    return items.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def allocate(items: DataFrame, budget: int) -> DataFrame:
    """Items taken: required ones always, others by utility while they fit; one that doesn't fit is skipped, later ones may still fit.

    The fold runs over one context's items, whose number is bounded by what a context offers.
    """
    key = F.struct((~F.col("required")).cast("int").alias("r"), (-F.col("utility")).alias("u"), "tokens", "id", "required")
    held = items.groupBy("context_id").agg(F.sort_array(F.collect_list(key)).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("ids"))

    def step(a, x):
        fits = x["required"] | (a["used"] + x["tokens"] <= budget)
        return F.struct(F.when(fits, a["used"] + x["tokens"]).otherwise(a["used"]).alias("used"), F.when(fits, F.array_append(a["ids"], x["id"])).otherwise(a["ids"]).alias("ids"))

    out = held.select("context_id", F.aggregate("xs", start, step).alias("a"))
    return out.select("context_id", F.explode("a.ids").alias("id"), F.col("a.used").alias("used"))


def escalation(hits: DataFrame) -> DataFrame:
    """Evidence level 1 to 4: 3 without a quote or in conflict, 2 for low confidence or a conditional claim, else 1."""
    level = F.greatest(F.when(~F.col("has_quote") | F.col("conflicted"), 3).otherwise(1), F.when((F.coalesce("confidence", F.lit(1.0)) < 0.6) | F.col("conditional"), 2).otherwise(1))
    return hits.withColumn("level", level)


def compress_history(turns: DataFrame, keep: int = 4) -> DataFrame:
    """Per conversation: number of turns folded, the first and last folded user text (clipped to 80), and the tokens they held."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    old = turns.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") > keep)
    user = F.when(F.col("role") == "user", F.substring("text", 1, 80))
    return old.groupBy("conv_id").agg(F.count("*").alias("folded"), F.min_by(user, F.when(user.isNotNull(), F.col("turn"))).alias("goal"), F.max_by(user, F.when(user.isNotNull(), F.col("turn"))).alias("last_request"), F.sum(F.ceil(F.length("text") / 4)).cast("long").alias("tokens"))


def load_policy(section: Column, tokens: Column, required: Column, summarizable: Column, id_only: Column) -> Column:
    """NEVER_LOAD, RETRIEVE_LATER, SUMMARIZE or LOAD; the first that fits, required small sections before long ones."""
    long = tokens > registry.SUMMARIZE_TOKENS
    return F.when(section.isin(*registry.NEVER_LOAD_SECTIONS), "NEVER_LOAD").when(id_only, "RETRIEVE_LATER").when(required & ~long, "LOAD").when(summarizable | long, "SUMMARIZE").otherwise("LOAD")


def reasoning_level(intent: Column, complexity: Column, coverage: Column, conflict: Column, evidence: Column) -> Column:
    """0 to 5: a start by intent, and one more each for complexity, thin coverage, conflicts, and much evidence wanted of what isn't well covered."""
    start = F.when(intent == "research", 3).when(intent == "review", 4).when(intent.isin("extract", "curate", "chat"), F.when(complexity < 0.3, 0).otherwise(1)).otherwise(1)
    more = [complexity >= 0.6, coverage < 0.5, conflict >= 0.3, (evidence >= 0.9) & (coverage < 0.8)]
    return F.least(reduce(lambda a, b: a + b, [c.cast("int") for c in more], start), F.lit(5))


def budget_plan(tasks: DataFrame) -> DataFrame:
    """Of each task (task_id, task_type, budget) its sections: section, tokens (its share, 60 at least), required, lazy, target (75 %) and reserve. References are lazy and have none."""
    def rows(shares):
        return F.array(*[F.struct(F.lit(k).alias("section"), F.lit(v).alias("share"), F.lit(k in registry.REQUIRED_SECTIONS).alias("required")) for k, v in shares])

    own = F.when(F.col("task_type").isin(*registry.ANSWER_TASKS), rows(registry.ANSWER_SHARES)).otherwise(rows(registry.SYSTEM_SHARES))
    target = F.floor(F.col("budget") * 0.75).cast("long")
    each = tasks.select("task_id", "budget", target.alias("target"), (F.col("budget") - target).alias("reserve"), F.explode(own).alias("s"))
    lazy = F.col("s.section") == "reference"
    tokens = F.when(lazy, 0).otherwise(F.greatest(F.lit(60), F.floor(F.col("budget") * F.col("s.share")))).cast("long")
    return each.select("task_id", "s.section", tokens.alias("tokens"), "s.required", lazy.alias("lazy"), "target", "reserve")


def trimmed(sections: DataFrame) -> DataFrame:
    """Sections (context_id, id, section, content, tokens, budget) with action (keep, trim, drop), keep_tokens and the new content.

    While a context is over its budget, its sections give way by rank, those of one rank in order of id: each is cut by
    what is too much, or dropped where less than a quarter would stay. All before the first that can be cut are dropped,
    and a cut ends it, so running sums say the whole. Protected and empty sections stay; unknown ones go last.
    """
    rank = reduce(lambda a, kv: a.when(F.col("section") == kv[1], kv[0]), enumerate(registry.COMPRESSION_ORDER), F.when(F.lit(False), 0)).otherwise(len(registry.COMPRESSION_ORDER))
    open_ = ~F.col("section").isin(*registry.NEVER_TRIM) & (F.coalesce("content", F.lit("")) != "")
    whole = Window.partitionBy("context_id")
    order = Window.partitionBy("context_id", "_open").orderBy("_rank", "id")
    df = sections.withColumn("_open", open_).withColumn("_rank", rank).withColumn("_total", F.sum("tokens").over(whole))
    before = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = df.withColumn("_over", F.col("_total") - F.col("budget") - before)
    keep = F.greatest(F.col("tokens") - F.col("_over"), F.lit(0))
    df = df.withColumn("_keep", keep).withColumn("_cut", F.col("_open") & (F.col("_over") > 0) & (keep >= F.col("tokens") * registry.MIN_KEEP_RATIO))
    done = F.coalesce(F.max(F.col("_cut").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    action = F.when(~F.col("_open") | (F.col("_over") <= 0) | done, "keep").when(F.col("_cut"), "trim").otherwise("drop")
    kept = F.when(action == "keep", F.col("tokens")).when(action == "trim", F.col("_keep")).otherwise(0)
    df = df.withColumn("action", action).withColumn("keep_tokens", kept.cast("long"))
    # texts differ in length, so each is cut by its own number of tokens
    content = F.when(F.col("action") == "keep", F.col("content")).when(F.col("action") == "trim", truncate_to_tokens(F.col("content"), F.col("keep_tokens"))).otherwise("")
    return df.withColumn("content", content).drop("_open", "_rank", "_total", "_over", "_keep", "_cut")


def evidence_dedup(hits: DataFrame, cap: int = registry.DOCUMENT_CAP, ratio: float = registry.SIMILAR_QUOTE_RATIO) -> DataFrame:
    """context_id, chunk_id, document_id, outcome (kept, duplicate_chunk, duplicate_quote, document_cap) and kept_id of hits (context_id, arrival, chunk_id, document_id, quote, score).

    In order of arrival: a chunk that was taken before goes; a quote equal to an earlier one, or nearly so where both have
    40 characters, goes as well, unless its score is higher, when it takes the other's place. Then each document keeps
    ``cap``. In hand is what was taken in one context, whose hits retrieval bounds; a quote is compared with those only.
    """
    least = registry.MIN_FUZZY_CHARS

    def near(a: str, b: str) -> bool:
        if a == b:
            return True
        if min(len(a), len(b)) < least or 2 * min(len(a), len(b)) < ratio * (len(a) + len(b)):
            return False
        match = difflib.SequenceMatcher(None, a, b)
        return match.real_quick_ratio() >= ratio and match.quick_ratio() >= ratio and match.ratio() >= ratio

    def step(state, row):
        taken, chunks, out = state  # places taken: key, hit; in order
        if row.chunk_id in chunks:
            out.append((row, "duplicate_chunk", None))
            return state
        key = " ".join((row.quote or "").split()).casefold()
        place = next((p for p in taken if key and near(p[0], key)), None)
        if place is None:
            taken.append([key or row.chunk_id, row])
            chunks.add(row.chunk_id)
        elif row.score > place[1].score:
            out.append((place[1], "duplicate_quote", row.chunk_id))
            place[1] = row
            chunks.add(row.chunk_id)
        else:
            out.append((row, "duplicate_quote", place[1].chunk_id))
        return state

    def finish(key, state):
        taken, _, out = state
        rows, count = [], {}
        for _, hit in taken:
            count[hit.document_id] = count.get(hit.document_id, 0) + 1
            rows.append((hit, "kept" if count[hit.document_id] <= cap else "document_cap", None))
        return [(key[0], h.arrival, h.chunk_id, h.document_id, why, kept) for h, why, kept in [*rows, *out]]

    kinds = {f.name: f.dataType.simpleString() for f in hits.schema}
    schema = f"context_id {kinds['context_id']}, arrival {kinds['arrival']}, chunk_id {kinds['chunk_id']}, document_id {kinds['document_id']}, outcome string, kept_id {kinds['chunk_id']}"
    return ordered_fold(hits, ["context_id"], ["arrival", "chunk_id"], lambda key: ([], set(), []), step, finish, schema)
