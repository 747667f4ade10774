"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is true where a document fails. A sample (about ``sample_rows`` documents, by a hash of the id) gives
each rule's rejection rate, and the time that it takes over what it alone needs; rules then run in the order
of rejection per cost. `keep` cuts the documents rule by rule: a rule's features are made of what the rules before
it left, so a rejected document costs nothing more. `judged` must give the base features of every document; the
rules' other features stand in the branches of a ``CASE``, so they too are made only where no earlier rule
has failed. The order never changes a verdict, only how early it falls.

Windows of eight words are compared by 64-bit hashes within one text.

Defined results: null or empty text has no words and fails ``too_short``; null doc_id is kept as it is;
repeated rows are judged alike; an empty table gives no rows (and rules in their given order); other
columns are ignored by the features and kept by ``keep``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, documents, dropped, staged, words_of

WINDOW, SYMBOLS, SAMPLE_ROWS = 8, "#*$%&|<>", 2000


def _length_without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


#: feature: (the columns it is made of, how). n_repeat_words is made by `_repeats`, of words.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[[], Column] | None]] = {
    "words": (("text",), lambda: words_of(F.col("text"))),
    "lines": (("text",), lambda: F.filter(F.split("text", "\n"), lambda x: x.rlike("[^ \\t-\\r]"))),
    "n_words": (("words",), lambda: F.size("words").cast("long")),
    "word_chars": (("text",), lambda: _length_without(F.col("text"), SEPARATORS).cast("long")),
    "n_symbols": (("text",), lambda: (F.length("text") - _length_without(F.col("text"), SYMBOLS)).cast("long")),
    "n_lines": (("lines",), lambda: F.size("lines").cast("long")),
    "n_dup_lines": (("lines",), lambda: (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")),
    "n_alpha_words": (("words",), lambda: F.size(F.filter("words", lambda w: w.rlike("\\p{L}"))).cast("long")),
    "n_repeat_words": (("words", "n_words"), None),
}
#: What `judged` gives of every document.
GIVEN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _with(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with the features named and what they are made of, where it has them not."""
    for name in names:
        if name not in docs.columns:
            of, make = FEATURES[name]
            docs = _with(docs, *of)
            docs = docs.withColumn(name, make()) if make else _repeats(docs)
    return docs


def _repeats(out: DataFrame) -> DataFrame:
    """n_repeat_words (words in windows of eight found twice or more) beside the other columns."""
    # a window's hash is that of its halves' hashes: eight words in three passes
    out = out.withColumn("h1", F.when(F.col("n_words") >= WINDOW, F.transform("words", lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>")))
    for k in (1, 2, 4):
        rest = F.greatest(F.size(f"h{k}") - k, F.lit(0))
        out = out.withColumn(f"h{2 * k}", F.zip_with(F.slice(f"h{k}", 1, rest), F.slice(f"h{k}", k + 1, rest), lambda x, y: F.xxhash64(x, y))).drop(f"h{k}")
    some = F.size(F.array_distinct("h8")) < F.size("h8")
    empty = F.array().cast("array<struct<h:long,i:int>>")
    sorted_ = F.when(some, F.sort_array(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty)
    out = out.withColumn("ranked", sorted_).drop("h8")
    n = F.size("ranked")
    # what stands before and after each window in the order of hashes tells whether it occurs again
    earlier = F.when(n > 0, F.concat(F.array(F.lit(None).cast("struct<h:long,i:int>")), F.slice("ranked", 1, F.greatest(n - 1, F.lit(0)))))
    later = F.when(n > 0, F.concat(F.slice("ranked", 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:long,i:int>"))))
    out = out.withColumn("earlier", F.coalesce(earlier, empty)).withColumn("later", F.coalesce(later, empty))
    flagged = F.zip_with(F.zip_with("ranked", "earlier", lambda x, y: F.when(x["h"] == y["h"], x["i"])), F.zip_with("ranked", "later", lambda x, y: F.when(x["h"] == y["h"], x["i"])), lambda p, q: F.coalesce(p, q))
    out = out.withColumn("starts", F.array_sort(F.filter(flagged, lambda i: i.isNotNull()))).drop("ranked", "earlier", "later")
    step = F.aggregate("starts", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")))
    return out.withColumn("n_repeat_words", step["n"]).drop("starts")


@dataclass(frozen=True)
class Rule:
    """``fails`` gives the condition under which a document fails, of a function from a feature's name to its column; ``needs`` names the features."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[Callable[[str], Column]], Column]


RULES = (
    Rule("repeated_windows", ("n_repeat_words", "n_words"), lambda f: 100 * f("n_repeat_words") > 30 * f("n_words")),
    Rule("too_short", ("n_words",), lambda f: f("n_words") < 20),
    Rule("symbols", ("n_symbols", "n_words"), lambda f: 10 * f("n_symbols") > f("n_words")),
    Rule("word_length", ("word_chars", "n_words"), lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words"))),
    Rule("few_letters", ("n_alpha_words", "n_words"), lambda f: 100 * f("n_alpha_words") < 60 * f("n_words")),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda f: 2 * f("n_dup_lines") > f("n_lines")),
)
BASE = ("too_short", "repeated_windows")


def plan(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, rejection rate, seconds) in the order of rejection per cost, from a sample of about ``sample_rows`` documents, taken by a filter so that nothing is sorted.

    A rule's cost is the time of one task that makes what the rule needs of the sample, beyond that of one which only reads it.
    """
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = documents(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = staged(sample, "rule_sample").coalesce(1)

    def timed(of: DataFrame, what: Column) -> tuple[float, float]:
        began = time.monotonic()
        found = of.agg(F.avg(what.cast("double"))).first()[0]
        return float(found or 0), time.monotonic() - began

    idle = min(timed(sample, F.length("text") < 0)[1] for _ in range(2))
    found = []
    for r in rules:
        rate, seconds = timed(_with(sample, *r.needs), r.fails(F.col))
        found.append((r, rate, max(seconds - idle, 1e-3)))
    return sorted(found, key=lambda x: -x[1] / x[2])


def _inline(have):
    """Features that ``have`` lacks as expressions over what it has."""
    return lambda name: F.col(name) if name in have else FEATURES[name][1]()


def judged(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the features ``GIVEN``, base_failed, kept and first_failed (the first rule, in the order run, that the document fails; null: none) of every document."""
    out = _with(documents(docs), *GIVEN)
    order = [r for r, _, _ in plan(docs, rules, sample_rows)]
    f, verdict = _inline(out.columns), F.lit(None).cast("string")
    for rule in reversed(order):
        verdict = F.when(rule.fails(f), F.lit(rule.name)).otherwise(verdict)
    base = F.lit(False)
    for r in rules:
        base = base | r.fails(f) if r.name in BASE else base
    out = out.withColumn("first_failed", verdict).withColumn("base_failed", base).withColumn("kept", F.col("first_failed").isNull())
    return out.select("doc_id", *GIVEN, "base_failed", "kept", "first_failed")


def keep(docs: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents, all columns as they were, that no rule rejects, cut rule by rule in the measured order.

    The whole row travels beside its features, so no join back to the text is needed.
    """
    left = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    for rule, _, _ in plan(docs, rules, sample_rows):
        # the running id keeps each filter above the features it needs, and below those of later rules
        left = _with(left, *rule.needs).withColumn("at", F.monotonically_increasing_id())
        left = left.filter(~rule.fails(F.col) & (F.col("at") >= 0)).drop("at")
    return left.select("row.*")
