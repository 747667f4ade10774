"""Scalar text functions as native expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import registry


#: What ``\\s`` stands for under ``(?U)``.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def fold(c: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(c, "\\s+", " ")))


def normalize_predicate(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9_]+", "_"), "^_+|_+$|(?<=_)_+", "")


def loose_name(c: Column) -> Column:
    """Folded, punctuation to spaces, legal suffixes dropped; never empty unless the name is."""
    words = F.filter(F.split(F.regexp_replace(fold(c), "[^\\p{L}\\p{N}]+", " "), " "), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin(*registry.COMPANY_SUFFIXES))
    return F.coalesce(F.nullif(F.array_join(kept, " "), F.lit("")), F.nullif(F.array_join(words, " "), F.lit("")), fold(c))


def contains_any(c: Column, markers) -> Column:
    low = F.lower(c)
    return reduce(lambda a, b: a | b, [low.contains(m.lower()) for m in markers])


def estimate_tokens(c: Column) -> Column:
    """Wide characters, and a token for every four others begun; none for a null or empty text."""
    c = F.coalesce(c, F.lit(""))
    cjk = F.length(c) - F.length(F.regexp_replace(c, registry.TOKEN_WIDE, ""))
    return (cjk + F.ceil((F.length(c) - cjk) / 4)).cast("long")


def query_terms(c: Column) -> Column:
    """Runs of CJK, or Latin tokens, in order."""
    return F.regexp_extract_all(F.regexp_replace(c, "[，。？！、：；（）「」【】“”]", " "), F.lit("[\\u4e00-\\u9fff]+|[A-Za-z0-9_][A-Za-z0-9_.\\-]*"), F.lit(0))


def query_grams(c: Column, most: int = registry.MAX_QUERY_GRAMS) -> Column:
    """Distinct trigrams of a query in order, ``most`` at the most; none for fewer than three characters."""
    s = F.regexp_replace(F.trim(F.regexp_replace(c, "\\s+", " ")), "[\"']", "")
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3)))
    return F.when(F.length(s) >= 3, F.slice(F.array_distinct(grams), 1, most)).otherwise(F.array().cast("array<string>"))


def clip(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit)), F.lit("…"))).otherwise(c)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def grade(c: Column) -> Column:
    out = F.lit("D")
    for at, name in reversed(registry.GRADES):
        out = F.when(c >= at, name).otherwise(out)
    return out


def fingerprint(c: Column) -> Column:
    """The first 12 hex digits of SHA-1 over the text with white space collapsed."""
    return F.substring(F.sha1(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\\s+", " "))), 1, 12)


def types_compatible(a: Column, b: Column) -> Column:
    """Whether two sets of types meet; an empty one is compatible with any."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def preview(*texts: Column, limit: int = 240) -> Column:
    """The first of the texts that isn't blank, white space collapsed, cut at ``limit`` characters."""
    tidy = [F.trim(F.regexp_replace(t, "(?U)\\s+", " ")) for t in texts]
    return F.substring(F.coalesce(*[F.when(t != "", t) for t in tidy], F.lit("")), 1, limit)


def passthrough(properties: Column, limit: int = 200) -> Column:
    """A small map as its JSON text, a large one as the list of its keys."""
    text = F.to_json(properties)
    return F.when(F.length(text) <= limit, text).otherwise(F.to_json(F.sort_array(F.map_keys(properties))))


def canonical(c: Column, names, aliases: dict[str, str]) -> Column:
    """The registered name of a value, letter case and blanks aside, else that of its alias; null: neither."""
    low = F.lower(F.trim(c))
    out = F.when(low.isin(*names), low)
    for alias, name in aliases.items():
        out = out.when(low == alias, F.lit(name))
    return out


def sentence_window(text: Column, anchor: Column, radius: int = 1, ends: str = "(?<=[。！？!?；;])|(?<=\\.\\s)|\\n+") -> Column:
    """The first sentence that holds the anchor's first 24 characters (else the first of all), with ``radius`` neighbours on each side."""
    strip = lambda c: F.trim(c, F.lit(_WHITE))
    once = lambda value, body: F.transform(F.array(value), body)[0]

    def window(parts, needle):
        hit = F.when(needle != "", F.array_position(F.transform(parts, lambda s: s.contains(needle)), True)).otherwise(0)
        index = F.greatest(hit.cast("int"), F.lit(1))
        first = F.greatest(index - radius, F.lit(1))
        return F.array_join(F.slice(parts, first, index + radius - first + 1), "")

    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ends), strip), lambda s: s != "")
    needle = F.substring(strip(F.coalesce(anchor, F.lit(""))), 1, 24)
    return once(F.struct(parts.alias("parts"), needle.alias("needle")), lambda x: window(x["parts"], x["needle"]))


def truncate_to_tokens(c: Column, most: int | Column) -> Column:
    """The longest prefix of at most ``most`` estimated tokens, cut at its last line end where that lies past its half."""
    most = F.lit(most) if isinstance(most, int) else most
    # the k-th character ends a prefix that fits while four times its wide characters and its others fit four times most
    chars = F.split(F.substr(c, F.lit(1), (most * 4 + 4).cast("int")), "")
    fits = F.aggregate(
        chars, F.struct(F.lit(0).alias("wide"), F.lit(0).alias("other"), F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda a, x: F.struct(
            (a["wide"] + x.rlike(registry.TOKEN_WIDE).cast("int")).alias("wide"), (a["other"] + (~x.rlike(registry.TOKEN_WIDE) & (x != "")).cast("int")).alias("other"),
            F.when(a["on"] & (a["wide"] + x.rlike(registry.TOKEN_WIDE).cast("int") + F.ceil((a["other"] + (~x.rlike(registry.TOKEN_WIDE) & (x != "")).cast("int")) / 4) <= most), a["n"] + F.length(x)).otherwise(a["n"]).alias("n"),
            (a["on"] & (a["wide"] + x.rlike(registry.TOKEN_WIDE).cast("int") + F.ceil((a["other"] + (~x.rlike(registry.TOKEN_WIDE) & (x != "")).cast("int")) / 4) <= most)).alias("on"),
        ),
    )["n"]
    cut = F.substr(c, F.lit(1), fits)
    at = F.length(cut) - F.instr(F.reverse(cut), "\n")  # characters before the last line end
    by_line = F.when((F.instr(cut, "\n") > 0) & (at > F.floor(F.length(cut) / 2)), F.substr(cut, F.lit(1), at)).otherwise(cut)
    return F.when((most <= 0) | c.isNull(), "").when(estimate_tokens(c) <= most, c).otherwise(F.regexp_replace(by_line, "\\s+$", ""))
