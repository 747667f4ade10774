"""Mixing sources to target weights, in DataFrame functions only.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is bisected
between 0 (all sources alike) and 1 (as they are): the smallest that keeps every source within
``max_repeats`` passes of its documents, or the largest whose weights reach ``entropy`` (a share of the
greatest possible, the logarithm of the number of sources), whichever is larger.

A budget of tokens then gives each source whole passes and a rest. A pass is a block: a permutation of
the source's documents by a hash of (seed, pass, doc_id). The last block is cut where the running sum of
tokens would pass the rest. That sum is found in two levels: totals of hash ranges (``RANGES`` a source,
pre-aggregated) show which range holds the cut; only that range's documents are ordered. So a source with
a third of all rows costs no task more than another.

Tokens are the words ``[^\\x20\\x09-\\x0D]+``, or a column.

Defined results: a null source counts as the source ''; null or empty text has no tokens and goes with its
source's whole passes; repeated rows are mixed each (their ties in the order of a hash of their text);
sources without tokens pass once; an empty table gives no rows; all columns are kept, but ones named
mix_pass or mix_order give way to this operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, words_of

RANGES = 4096
SEED, ENTROPY, MAX_REPEATS = 17, 0.97, 2.0


def _tokens(column: str | None) -> Column:
    if column:
        return F.coalesce(F.col(column).cast("long"), F.lit(0))
    return F.coalesce(F.size(words_of(F.col("text"))), F.lit(0)).cast("long")


def source_shares(docs: DataFrame, tokens: str | None = None) -> DataFrame:
    """source, tokens, docs: one row for each source."""
    return docs.select(F.coalesce("source", F.lit("")).alias("source"), _tokens(tokens).alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))


def _measures(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float, float, float]]:
    """For each exponent, in one pass: entropy of the weights, and the least and greatest ratio of weight to share."""
    p = F.col("p")
    aggs = [F.sum(p).alias("one"), F.min("p").alias("lo"), F.max("p").alias("hi")]
    for k, a in enumerate(exponents):
        aggs += [F.sum(F.pow(p, F.lit(a))).alias(f"s{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{k}")]
    import math

    r = shares.agg(*aggs).first()
    out = []
    for k, a in enumerate(exponents):
        s = r[f"s{k}"]
        out.append((math.log(s) - a * r[f"l{k}"] / s, r["hi"] ** (a - 1) / s, r["lo"] ** (a - 1) / s, s))
    return out


def bisect_exponent(shares: DataFrame, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = 1.0, cuts: int = 15, rounds: int = 7) -> float:
    """The exponent, to 16 to the power of -``rounds``. ``shares`` has p, positive, for each source; ``budget`` is a multiple of all tokens, or None for as many as let every document pass once.

    Each round cuts the interval at ``cuts`` places in one aggregation, so any number of sources is served
    by ``rounds`` small jobs.
    """
    import math

    n = shares.count()
    if n < 2:
        return 1.0
    want = entropy * math.log(n)

    def meets(m) -> tuple[bool, bool]:
        spread = m[2] / m[1] if budget is None else m[2] * budget
        return spread <= max_repeats * (1 + 1e-9), m[0] >= want - 1e-12

    (repeats0, _), (_, natural) = (meets(m) for m in _measures(shares, [0.0, 1.0]))
    exponent = 0.0
    # the repetition limit holds from some exponent up; the entropy is reached from some exponent down
    for which, at_once in ((0, repeats0), (1, natural)):
        if at_once:
            exponent = max(exponent, float(which))
            continue
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            grid = [lo + (hi - lo) * (k + 1) / (cuts + 1) for k in range(cuts)]
            ok = [meets(m)[which] for m in _measures(shares, grid)]
            first = ok.index(not which) if (not which) in ok else cuts
            edges = [lo, *grid, hi]
            lo, hi = edges[first], edges[first + 1]
        exponent = max(exponent, hi if which == 0 else lo)
    return exponent


def mix(docs: DataFrame, entropy: float = ENTROPY, max_repeats: float = MAX_REPEATS, budget: float | None = 1.0, seed: int = SEED, tokens: str | None = None) -> DataFrame:
    """``docs`` with mix_pass (from 0) and mix_order (the hash that orders a block), a row for each use of a document.

    ``budget``: tokens to give, as a multiple of all tokens; None: as many as let every document pass at
    least once.
    """
    docs = docs.drop("mix_pass", "mix_order")
    shares = staged(source_shares(docs, tokens), "sources")
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return docs.withColumn("mix_pass", F.lit(0).cast("long")).withColumn("mix_order", _place(seed, F.lit(0)))
    positive = staged(shares.filter("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(float(total))).alias("p")), "shares")
    a = bisect_exponent(positive, entropy, max_repeats, budget)
    (_, least, _, s) = _measures(positive, [a])[0]
    size = total * (budget if budget is not None else 1 / least)
    passes = F.pow("p", F.lit(a)) / F.lit(s) * F.lit(size) / F.col("tokens")
    whole = F.floor(passes + 1e-9)
    weights = positive.select("source", whole.alias("whole"), F.floor((F.greatest(passes - whole, F.lit(0.0))) * F.col("tokens") + 1e-6).alias("rest"))
    weights = shares.select("source").join(weights, "source", "left").select("source", F.coalesce("whole", F.lit(1)).alias("whole"), F.coalesce("rest", F.lit(0)).alias("rest"))
    weights = staged(weights, "weights")

    names = docs.columns
    rows = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.coalesce("source", F.lit("")).alias("source"), F.col("doc_id"), F.col("text"), *([F.col(tokens)] if tokens else []))
    rows = rows.join(weights, "source").withColumn("at", _place(seed, F.col("whole"))).withColumn("range", F.shiftright("at", 52))
    sums = rows.groupBy("source", "range", "rest").agg(F.sum(_tokens(tokens)).alias("n"))
    running = Window.partitionBy("source").orderBy("range")  # at most RANGES rows
    sums = sums.withColumn("upto", F.sum("n").over(running))
    cut = sums.filter("upto > rest").groupBy("source").agg(F.min(F.struct("range", "upto", "n")).alias("c"))
    cut = staged(cut.select("source", F.col("c.range").alias("cut"), (F.col("c.upto") - F.col("c.n")).alias("before")), "cuts")
    rows = rows.join(cut, "source", "left")
    clear = rows.filter(F.col("cut").isNull() | (F.col("range") != F.col("cut"))).withColumn("last", F.coalesce(F.col("range") < F.col("cut"), F.lit(True)) & (F.col("rest") > 0))
    near = rows.filter(F.col("range") == F.col("cut")).withColumn("n", _tokens(tokens))
    order = Window.partitionBy("source").orderBy("at", "doc_id", F.xxhash64("text"), "n").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("last", (F.col("before") + F.sum("n").over(order) <= F.col("rest")) & (F.col("rest") > 0))
    keep = ["row", "whole", "last"]
    out = clear.select(*keep).unionByName(near.select(*keep))
    out = out.withColumn("times", F.col("whole") + F.col("last").cast("int")).filter("times > 0")
    out = out.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("mix_pass"))
    return out.select("row.*", "mix_pass").withColumn("mix_order", _place(seed, F.col("mix_pass")))


def _place(seed: int, block: Column) -> Column:
    return F.xxhash64(F.lit(seed), block.cast("long"), F.col("doc_id"))
