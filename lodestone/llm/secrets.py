"""Secret scans, in DataFrame functions only.

Three base patterns give spans; two character Markov models (order one) add more. The models are trained
from labelled samples, strings drawn at random and ordinary identifiers (the names that Python's own library
defines, cut into words and joined as programs, paths and addresses join them), and a token is reported where the
log-likelihood ratio per character exceeds a threshold. Letters alone are a word unless their case is mixed inside,
and a UUID is a name; neither is judged. What the base patterns found is blanked out before, so
what is left of a token around it is a token of its own. Their table of transition log ratios has a fixed
size, so it travels in the plan as a literal.

Spans are (kind, start, end) in code points, end exclusive. A text is cut at a pattern's matches; the
lengths of the pieces before each match give its place, so one pass of the pattern serves all its spans; to
blank or mask them, the text is cut into blocks once, from which the pieces between spans are taken.

Defined results: null or empty text has no spans; null doc_id is kept; repeated rows are scanned alike; an
empty table gives no rows; other columns are ignored by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import functools
import importlib
import math
import random
import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

#: kind: (pattern, group that must be long enough, its least length, what a text must hold for a match). Runs too short to
#: count are no matches of the last two: a run is taken whole or not at all, so no other match changes.
PATTERNS = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, "(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\\x20*[:=]"),
    "access": ("AKIA[A-Z0-9]{16,}+", 0, 20, "AKIA[A-Z0-9]{16}"),
    "hex": ("(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24, "(?<![0-9a-f])[0-9a-f]{24}"),
}
BASE = tuple(PATTERNS)
#: A token long enough to be judged by the models, what of these is judged, and what is not.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
JUDGED, UUID = "[0-9+/_=-]|[a-z][A-Z]", "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
THRESHOLD, SAMPLES, RANDOM = 0.35, 1500, 12_000
#: Modules whose names make the labelled sample of ordinary identifiers.
MODULES = (
    "ast asyncio builtins calendar collections concurrent.futures configparser csv datetime decimal difflib email.message errno ftplib functools gzip html.parser http http.client imaplib inspect io "
    "itertools json locale logging logging.handlers mailbox math mimetypes multiprocessing operator os pathlib pickle platform queue random re sched shutil signal smtplib socket socketserver statistics "
    "string subprocess tarfile tempfile textwrap threading time tokenize traceback types typing unittest.mock urllib.parse urllib.request uuid warnings weakref xml.dom.minidom xml.sax.handler xmlrpc.client zipfile"
).split()

_SPAN = "array<struct<kind:string,start:int,end:int>>"


def words(modules=MODULES) -> list[str]:
    """The words of the names that modules define, and their classes: cut at signs and at changes of case."""
    names: set[str] = set()
    for m in map(importlib.import_module, modules):
        names.update(dir(m))
        names.update(x for n in dir(m) if isinstance(getattr(m, n, None), type) for x in dir(getattr(m, n)))
    return sorted({w.lower() for n in names for w in re.findall("[A-Z]?[a-z]+|[A-Z]+(?![a-z])", n) if 3 <= len(w) <= 16})


def identifiers(vocabulary: list[str] | None = None, samples: int = SAMPLES, seed: int = 11) -> list[str]:
    """The labelled sample of ordinary identifiers: joins of words as names, paths, options and dated addresses have them, numbers, rules of signs, runs of the alphabet."""
    draw, vocabulary = random.Random(seed), vocabulary or words()
    number = lambda k: "".join(draw.choices(string.digits, k=k))
    title = lambda w: "".join(x.title() for x in w)
    short = lambda w: "".join(x.upper() if len(x) < 5 and draw.random() < 0.5 else x.title() for x in w)  # noqa: E731  acronyms
    date = lambda sep: sep.join([str(draw.randint(1970, 2039)), number(2), number(2)])
    shapes = (
        "_".join, "-".join, title, lambda w: w[0] + title(w[1:]), short, "/".join, lambda w: "/".join(w) + "/", lambda w: "/" + "/".join(w), lambda w: "_".join(w).upper(), "".join,
        lambda w: "_".join(w) + number(draw.randint(1, 3)), lambda w: "-".join(w) + "-" + number(draw.randint(1, 4)), lambda w: short(w) + number(draw.randint(1, 2)), lambda w: "/".join(w[:2]) + "/" + title(w[1:]),
        lambda w: "--" + "-".join(w), lambda w: "__" + "_".join(w) + "__", lambda w: w[0] + "=" + "_".join(w[1:]), "+".join, lambda w: "-".join(x.title() for x in w), lambda w: "_".join(x.title() for x in w),
        lambda w: "/".join(short(draw.choices(vocabulary, k=2)) for _ in w), lambda w: f"{w[0]}-{number(1)}/{'-'.join(w[1:])}", lambda w: f"{date('-')}/{'-'.join(w)}", lambda w: f"{date('/')}/{'-'.join(w)}",
        lambda w: f"{date('')}{number(6)}-{number(6)}", lambda w: number(draw.randint(20, 30)), lambda w: draw.choice("-=_+/") * draw.randint(20, 60), lambda w: draw.choice(["-=", "=-", "+-", "_-", "/-"]) * draw.randint(10, 30),
    )
    out = [shape(draw.choices(vocabulary, k=draw.randint(2, 5))) for _ in range(samples) for shape in shapes]
    return out + [draw.choice([string.ascii_lowercase, string.ascii_uppercase, string.digits * 2])[draw.randint(0, 5) :] for _ in range(samples // 2)]


def random_strings(samples: int = RANDOM, seed: int = 7) -> list[str]:
    """The labelled sample of random strings: hexadecimal, base 62, base 64 and its URL form, in either case of letters."""
    draw = random.Random(seed)
    kinds = ["0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
    return ["".join(draw.choices(draw.choice(kinds), k=draw.randint(20, 64))) for _ in range(samples)]


def _transitions(samples: list[str]) -> list[list[float]]:
    n = len(ALPHABET)
    place = {c: k for k, c in enumerate(ALPHABET)}
    counts = [[0.5] * n for _ in range(n)]
    for s in samples:
        at = [place[c] for c in s if c in place]
        for a, b in zip(at, at[1:]):
            counts[a][b] += 1
    return [[math.log(v / sum(row)) for v in row] for row in counts]


@functools.lru_cache(maxsize=4)
def trained(random_sample: tuple | None = None, ordinary_sample: tuple | None = None) -> tuple[float, ...]:
    """The log ratio of every transition, row by row in the order of ``ALPHABET``: above 0 where random strings make it more often."""
    r = _transitions(list(random_sample) if random_sample else random_strings())
    o = _transitions(list(ordinary_sample) if ordinary_sample else identifiers())
    return tuple(round(a - b, 4) for x, y in zip(r, o) for a, b in zip(x, y))


def score(token: Column, model: tuple[float, ...]) -> Column:
    """The mean log-likelihood ratio of a token's transitions."""
    n = len(ALPHABET)
    at = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to a literal
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum"))
    total = F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), F.when((a["last"] > 0) & (i > 0), a["sum"] + F.element_at(table, (a["last"] - 1) * n + i)).otherwise(a["sum"]).alias("sum")))
    return total["sum"] / F.greatest(F.length(token) - 1, F.lit(1))


def _let(value: Column, body) -> Column:
    """``body`` of the value, which is worked out once, however often and in whatever loop ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _running(values: Column, step, block: int = 128) -> Column:
    """For each of the values (int) what ``step`` makes of those before it, from 0.

    A fold that appends copies what it has, so it runs within blocks, and once over the blocks' results: a text of
    many matches costs their number times ``block``, not its square.
    """
    start = lambda at: F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    walk = lambda xs, at: F.aggregate(xs, start(at), lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / block).cast("int")), lambda k: F.slice(v, k * block + 1, block))
    long = lambda v: _let(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, _running_ends(blocks, step), walk)))
    return _let(values, lambda v: F.when(F.size(v) > block, long(v)).otherwise(walk(v, F.lit(0))))


def _running_ends(blocks: Column, step) -> Column:
    """What ``step`` makes of all blocks before each."""
    done = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(done, start, lambda a, x: F.struct(step(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def _before(lengths: Column) -> Column:
    """For each of the lengths the sum of those before it."""
    return _running(lengths, lambda a, x: a + x)


def _blocks(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def _replaced(text: Column, spans: Column, filler, size: int = 2048) -> Column:
    """The text with ``filler(span, end of all spans before)`` in place of its spans, which are in order of start.

    Each piece is taken from the blocks that it lies in, so the whole costs the text's length and, for each span, a block's.
    """

    def of(blocks, own):
        def piece(lo, hi):  # places from 0
            first, last = F.floor(lo / size).cast("int"), F.floor((hi - 1) / size).cast("int")
            inside = F.substr(F.get(blocks, first), lo - first * size + 1, hi - lo)
            head, tail = F.substr(F.get(blocks, first), lo - first * size + 1), F.substr(F.get(blocks, last), F.lit(1), hi - last * size)
            across = F.concat(head, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
            return F.when(hi <= lo, F.lit("")).when(first == last, inside).otherwise(across)

        ends = F.transform(own, lambda s: s["end"])
        parts = F.zip_with(own, _running(ends, lambda a, x: F.greatest(a, x)), lambda s, reach: F.concat(piece(reach, s["start"]), filler(s, reach)))
        return F.concat(F.array_join(parts, ""), _let(F.array_max(ends), lambda end: piece(end, F.length(text))))

    return F.when(F.size(spans) > 0, _let(_blocks(text, size), lambda blocks: _let(spans, lambda own: of(blocks, own)))).otherwise(text)


def _matches(text: Column, kind: str, pattern: str, group: int) -> Column:
    """The matches of a pattern, leftmost and non-overlapping, with their places."""

    def of(matches, pieces):
        before = _before(F.zip_with(pieces, matches, lambda p, m: F.length(p) + F.length(m)))
        zipped = F.arrays_zip(matches.alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), pieces.alias("p"), before.alias("b"))

        def row(x):
            start = x["b"] + F.length(x["p"])
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("text"), x["g"].alias("group"))

        return F.transform(zipped, row)

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return _let(every, lambda matches: _let(F.slice(F.split(text, pattern, -1), 1, F.size(matches)), lambda pieces: of(matches, pieces)))


def _at_least(n: int):
    return lambda s: F.length(s["group"]) >= n


def _bare(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def with_spans(docs: DataFrame, text: str = "text", model: tuple[float, ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: the base patterns' spans, and those together with the models'. ``text`` isn't null."""
    t, none = F.col(text), F.array().cast(_SPAN)
    for kind, (pattern, group, least, hint) in PATTERNS.items():
        found = F.filter(_matches(t, kind, pattern, group), _at_least(least))
        docs = docs.withColumn(f"_{kind}", F.when(t.rlike(hint), _bare(found)).otherwise(none))
    docs = docs.withColumn("base", _ordered(F.concat(*[F.col(f"_{k}") for k in BASE]), BASE)).drop(*[f"_{k}" for k in BASE])
    table, left = model or trained(), F.col("_left")
    # spaces, which no token holds, in place of the base spans
    blank = _replaced(t, F.col("base"), lambda s, reach: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], reach), F.lit(0))))
    docs = docs.withColumn("_left", F.when(t.rlike(TOKEN), blank).otherwise(""))
    judged = lambda s: s["text"].rlike(JUDGED) & ~s["text"].rlike(UUID)
    tokens = _bare(F.filter(_matches(left, "markov", TOKEN, 0), lambda s: judged(s) & (score(s["text"], table) > threshold)))
    docs = docs.withColumn("_more", F.when(left.rlike(TOKEN), tokens).otherwise(none))
    return docs.withColumn("spans", _ordered(F.concat("base", "_more"), (*BASE, "markov"))).drop("_more", "_left")


def scan(docs: DataFrame, model: tuple[float, ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end) of every document."""
    return with_spans(documents(docs), model=model, threshold=threshold).select("doc_id", "base", "spans")


def redact(docs: DataFrame, mask: str = "[SECRET]", model: tuple[float, ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns and rows kept, with every span replaced by ``mask`` and n_chars, if there, counted anew. A null text stays null."""
    names = docs.columns
    held = docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    held = with_spans(held, model=model, threshold=threshold)
    clean = _replaced(F.col("text"), F.col("spans"), lambda s, reach: F.when(s["start"] >= reach, F.lit(mask)).otherwise(""))
    held = held.select("row", F.when(F.col("row.text").isNotNull(), clean).alias("clean"))
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNotNull(), F.length("clean")).otherwise(F.col("row.n_chars")).cast("long") if "n_chars" in names else None}
    return held.select(*[(new[c] if new.get(c) is not None else F.col("row")[c]).alias(c) for c in names])


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _ordered(spans: Column, kinds) -> Column:
    """By start, then by kind as listed."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, kinds)), s["kind"]).alias("k"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x["s"])
