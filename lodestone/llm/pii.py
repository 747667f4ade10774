"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

The tagger is trained in numpy on the driver from labelled spans: sentences of invented words around personal data
and look-alikes, ``SAMPLES`` of them at most, drawn from a seeded rule (the tables hold no labelled spans). Every kind
holds a digit, an at sign or a bracketed "at", so windows of ``WINDOW`` characters, half overlapping, cover the
surroundings of all of these in the whole text and nothing else. Each window is decoded; the spans of all windows of
a text are reconciled together: pieces that a window's edge cut are joined with the pieces they meet, each span
passes an exact check (number of digits, check sum, form), and of overlapping ones the set with the largest sum of
scores stays. Base spans stay in any case; a span that touches one goes, unless it is a wider one of
the same kind.

What is added, under the same kinds: cards of 13 to 15 digits or with other separators, phones without a plus,
addresses of IP version 6, e-mail addresses with a bracketed "at" or "dot" or with letters beyond ASCII.

Defined results: null or empty text has no spans; a null doc_id is kept; repeated rows are scanned alike; very long
texts go through whole, in windows; an empty table gives no rows; other columns are ignored by ``scan`` and kept by
``redact``.
"""

from __future__ import annotations

import bisect
import functools
import ipaddress
import random
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import chartagger
from .common import documents

KINDS = ("email", "ip", "card", "phone")
#: What any span of any kind holds, written alike for Java and Python.
TRIGGER = r"[0-9@]|[(\[{<][ \t]?[aA][tT][ \t]?[)\]}>]"
WINDOW, MARGIN = 96, 40
#: Of the training: samples, characters of a window, size of each direction, steps, windows a step, rate.
SAMPLES, CUT, HIDDEN, STEPS, BATCH, RATE = 6000, 64, 32, 700, 32, 0.02
_SPAN = "array<struct<kind:string,start:int,end:int>>"

# the base patterns: lookbehinds and possessive runs only keep a match from being tried again inside a run that failed
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_TRIGGER = re.compile(TRIGGER)
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def _emails(text: str):
    """Leftmost matches: a run of local characters before an at sign starts where it can, the last match's end at the earliest."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        # the next at sign may only look back to here: what lies before was tried
        end = max(end, at + 1)
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for kind, pattern, least, most in ((2, _CARD, 16, 19), (3, _PHONE, 8, 15)):
        for m in pattern.finditer(text):
            digits = "".join(_DIGIT.findall(m[0]))
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                out.append((kind, *m.span()))
    return out


# labelled samples

_SYLLABLES = "ba be ti on er ing the an re st th ne la que mi do ción eau ver sch ung keit ä ö lo ra men te sa pre nor wi ka zu fi gro hel".split()


class Samples:
    """Sentences with labelled spans, from a seed: invented words around personal data and look-alikes."""

    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.draw.choices(string.digits, k=n))

    def word(self) -> str:
        w = "".join(self.draw.choices(_SYLLABLES, k=self.draw.randint(1, 4)))
        return w.title() if self.draw.random() < 0.12 else w

    def name(self) -> str:
        d = self.draw
        return d.choice([self.plain(), f"{self.plain()}.{self.plain()}", f"{self.plain()}_{self.plain()}", f"{self.plain()}{self.digits(2)}", f"{self.plain()}.{self.digits(2)}", f"{self.plain()[0]}-{self.plain()}"])

    def plain(self) -> str:
        return "".join(c for c in self.word().lower() if c.isascii()) or "ann"

    def host(self, dot: str = ".") -> str:
        d = self.draw
        return dot.join([d.choice([self.plain(), f"mail{self.digits(1)}", f"{self.plain()}-{self.plain()}"]), *([self.plain()] if d.random() < 0.4 else []), d.choice("com org net de fr es io co.uk example.com".split())])

    def valid(self, digits: str) -> str:
        """The digits with the last one set so that their check sum is right."""
        return next(digits[:-1] + c for c in string.digits if luhn(digits[:-1] + c))

    def grouped(self, digits: str, sizes, sep: str) -> str:
        out, at = [], 0
        for s in sizes:
            out.append(digits[at : at + s])
            at += s
        return sep.join(out)

    def email(self) -> str:
        d = self.draw
        kind = d.random()
        if kind < 0.45:
            return f"{self.name()}@{self.host()}"
        if kind < 0.6:
            return f"{self.plain()}{d.choice('éüñöç')}{self.plain()}@{self.host()}"
        a, b = d.choice(["()", "[]", "{}", "<>"])
        at, dot = d.choice(["at", "AT"]), d.choice([".", f" {a}dot{b} ", f"{a}dot{b}", "."])
        return f"{self.name()}{d.choice(['', ' '])}{a}{at}{b}{d.choice(['', ' '])}{self.host(dot)}"

    def ip(self) -> str:
        d = self.draw
        if d.random() < 0.5:
            return ".".join(str(d.randint(0, 255)) for _ in range(4))
        groups = [f"{d.randint(0, 65535):x}" for _ in range(8)]
        if d.random() < 0.6:
            n = d.randint(2, 6)
            return ":".join(groups[: n // 2 + 1]) + "::" + ":".join(groups[: n // 2])
        return ":".join(groups)

    def card(self) -> str:
        d, sep = self.draw, self.draw.choice(" -./ ")
        kind = d.random()
        if kind < 0.4:
            return self.grouped(self.valid(d.choice("3456") + self.digits(15)), (4, 4, 4, 4), d.choice(["", sep, sep]))
        if kind < 0.75:
            return self.grouped(self.valid(d.choice(["34", "37"]) + self.digits(13)), (4, 6, 5), d.choice(["", sep, sep]))
        if kind < 0.9:
            return self.grouped(self.valid(d.choice(["36", "38", "30"]) + self.digits(12)), (4, 6, 4), d.choice(["", sep, sep]))
        return self.grouped(self.valid("4" + self.digits(12)), (4, 3, 3, 3), d.choice(["", " ", "-"]))

    def phone(self) -> str:
        d, f = self.draw, self.digits
        area = f"{d.randint(2, 9)}{f(2)}"
        return d.choice([f"+{d.randint(1, 99)} ({area}) {f(3)}-{f(4)}", f"({area}) {f(3)}-{f(4)}", f"({area}) {f(3)} {f(4)}", f"{area}-{f(3)}-{f(4)}", f"{area}.{f(3)}.{f(4)}", f"1-{area}-{f(3)}-{f(4)}", f"00{d.randint(30, 49)} {f(3)} {f(7)}", f"+{d.randint(30, 49)} {f(2)} {f(4)} {f(4)}", f"0{f(3)}/{f(7)}", f"0{f(1)} {f(2)} {f(2)} {f(2)} {f(2)}"])

    def other(self) -> str:
        """What holds digits or at signs and is nobody's data."""
        d, f, w = self.draw, self.digits, self.plain
        hexed = lambda n: "".join(d.choices("0123456789abcdef", k=n))
        return d.choice(
            [
                lambda: f"{d.randint(1900, 2099)}-{d.randint(1, 12):02}-{d.randint(1, 28):02}", lambda: f"{d.randint(1, 28)}.{d.randint(1, 12)}.{d.randint(1900, 2099)}", lambda: f"{d.randint(1, 28)}/{d.randint(1, 12)}/{f(2)}",
                lambda: f"{d.randint(0, 23):02}:{f(2)}:{f(2)}", lambda: f"{d.randint(0, 23)}:{f(2)}", lambda: f"{d.randint(1900, 2099)}-{d.randint(1, 12):02}-{d.randint(1, 28):02}T{d.randint(0, 23):02}:{f(2)}:{f(2)}Z",
                lambda: f"v{f(1)}.{f(1)}.{f(2)}", lambda: f"{f(1)}.{f(2)}", lambda: f"{d.randint(1, 9)}.{d.randint(1, 9)}.{d.randint(1, 9)}", lambda: f"{d.randint(1, 9)}.{d.randint(1, 9)}.", lambda: f"§ {f(2)}", lambda: f"[{f(2)}]", lambda: f"({f(d.randint(1, 4))})",
                lambda: f"${d.randint(1, 999)},{f(3)}.{f(2)}", lambda: f"{f(2)}%", lambda: f(d.randint(1, 6)), lambda: f(d.randint(5, 12)), lambda: f(13), lambda: f"{d.randint(1, 9)} {f(3)} {f(3)}", lambda: f"{d.randint(1, 9)},{f(3)},{f(3)}", lambda: f"{d.randint(1800, 2020)}-{d.randint(1800, 2020)}",
                lambda: f"{w().upper()}-{f(4)}-{f(2)}", lambda: f"#{f(d.randint(2, 7))}", lambda: f"{w()}{f(1)}", lambda: f"{w()}_{f(4)}.png", lambda: f"978-{f(1)}-{f(2)}-{f(6)}-{f(1)}", lambda: f"{f(4)}-{f(3)}{d.choice('0123456789X')}",
                lambda: hexed(40), lambda: f'token = "{hexed(40)}"', lambda: f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", lambda: "0x" + hexed(8), lambda: "".join(d.choices(string.ascii_letters + string.digits, k=d.randint(16, 40))), lambda: "AKIA" + "".join(d.choices(string.ascii_uppercase + string.digits, k=16)),
                lambda: f"@{w()}", lambda: f"{w()} @ {w()}", lambda: f"@{w()}.{w()}({f(1)})", lambda: f"{w()} (at) {w()}", lambda: f"{w()}@{w()}", lambda: f"{w()}[at]{w()}",
                lambda: f"https://{self.host()}/{w()}/{f(5)}?id={f(3)}", lambda: f"{f(2)}°{f(2)}'{f(2)}\"", lambda: f"{f(1)}x{f(1)}", lambda: f"{f(2)}+{f(2)}={f(3)}", lambda: f"{w()}[{f(1)}:{f(2)}]", lambda: f"{f(3)} {w()}", lambda: f"{f(2)}:{f(2)}", lambda: f"{hexed(2)}:{hexed(2)}:{hexed(2)}:{hexed(2)}:{hexed(2)}:{hexed(2)}", lambda: f"{f(20)}", lambda: f"{f(5)}-{f(4)}", lambda: f"{f(3)}-{f(2)}-{f(4)}", lambda: f"{f(1)}.{f(1)}.{f(1)}.{d.randint(256, 999)}",
            ]
        )()

    def one(self) -> tuple[str, list[tuple[int, int, int]]]:
        """A text of some lines with its spans (kind, start, end)."""
        d, text, spans = self.draw, "", []
        for _ in range(d.randint(2, 5)):
            for _ in range(d.randint(0, 4)):
                text += self.word() + d.choice(["", "", "", "", ",", ".", "!", ";", ":", "***", "###"]) + d.choice([" ", " ", " ", " ", " ", "\n"])
            before, after = d.choice([("", "")] * 7 + [("(", ")"), ('"', '"'), ("<", ">"), (": ", ""), ("=", ""), ("", "."), ("", ","), ("", "!!"), ("", "%%%"), ("", "***")])
            if d.random() < 0.5:
                kind = d.randrange(4)
                value = (self.email, self.ip, self.card, self.phone)[kind]()
                spans.append((kind, len(text) + len(before), len(text) + len(before) + len(value)))
            else:
                value = self.other()
            text += before + value + after + d.choice([" ", " ", " ", "\n"])
        return text + self.word(), spans


@functools.lru_cache(maxsize=2)
def trained(seed: int = 29, samples: int = SAMPLES, steps: int = STEPS) -> chartagger.Tagger:
    """The tagger, trained on the driver; the same session trains it once."""
    draw = Samples(seed)
    return chartagger.train([draw.one() for _ in range(samples)], len(KINDS), CUT, HIDDEN, steps, BATCH, RATE)


# spans of whole texts

_EMAIL_FORM = re.compile(r"[^\W_][\w.%+-]*\s?(?:@|[(\[{<]\s?at\s?[)\]}>])\s?[\w-]+(?:\s?(?:\.|[(\[{<]\s?dot\s?[)\]}>])\s?[\w-]+)+", re.IGNORECASE)
_CARD_FORM = re.compile(r"[0-9]+(?:([ ./-])[0-9]+(?:\1[0-9]+)*)?")
_PHONE_FORM = re.compile(r"(?:\+|00)?[0-9]*(?:\([0-9]{2,5}\))?[0-9 ./-]*[0-9]")
#: Dates, spans of years, and the forms of social security numbers, postal codes and book numbers are no phones.
_NO_PHONE = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{5}-[0-9]{4}|97[89]-[0-9-]+|[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{2,4}|(?:19|20)[0-9]{2}[ -](?:19|20)[0-9]{2}")
#: First digits and lengths of the card schemes.
_SCHEMES = {13: ("4",), 14: ("30", "36", "38", "39"), 15: ("34", "37"), 16: ("3", "4", "5", "6"), 17: ("5", "6"), 18: ("5", "6"), 19: ("4", "5", "6")}


def holds(kind: int, text: str) -> bool:
    """The exact check of an added span."""
    if kind == 0:
        return bool(_EMAIL_FORM.fullmatch(text))
    if kind == 1:
        try:
            return text.count(":") >= 2 and bool(ipaddress.IPv6Address(text))
        except ValueError:
            return False
    digits = "".join(_DIGIT.findall(text))
    if kind == 2:
        return bool(_CARD_FORM.fullmatch(text)) and digits.startswith(_SCHEMES.get(len(digits), ("-",))) and luhn(digits)
    groups = len(re.findall("[0-9]+", text))
    return 9 <= len(digits) <= 15 and groups >= 2 and bool(_PHONE_FORM.fullmatch(text)) and not _NO_PHONE.fullmatch(text)


def window_starts(text: str, window: int = WINDOW, margin: int = MARGIN) -> list[tuple[int, int]]:
    """(start, end) of half-overlapping windows that cover every trigger of the text with its surroundings."""
    regions: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - margin), min(len(text), m.end() + margin)
        if regions and lo <= regions[-1][1]:
            regions[-1][1] = hi
        else:
            regions.append([lo, hi])
    out = []
    for lo, hi in regions:
        while lo + window < hi:
            out.append((lo, lo + window))
            lo += window // 2
        lo = max(0, min(lo, len(text) - window))  # the last one is whole where the text is long enough
        out.append((lo, min(len(text), lo + window)))
    return out


def decoded(model: chartagger.Tagger, texts: list[str], size: int = 256):
    """For each text, spans (kind, start, end, score, cut) of each of its windows; cut: the window's edge is the span's."""
    windows = [(k, lo, hi) for k, t in enumerate(texts) for lo, hi in window_starts(t)]
    out: list[list[tuple[int, int, int, float, bool]]] = [[] for _ in texts]
    for first in range(0, len(windows), size):
        part = windows[first : first + size]
        x = np.zeros((size, WINDOW), np.int64)  # always as many, so that a window's figures don't depend on its neighbours' number
        for j, (k, lo, hi) in enumerate(part):
            x[j, : hi - lo] = chartagger.ids(texts[k][lo:hi])
        labels, gain = model.decode(x)
        for j in np.flatnonzero(labels[: len(part)].any(1)):
            k, lo, hi = part[j]
            y, t = labels[j], 0
            while t < hi - lo:
                if y[t] == 0:
                    t += 1
                    continue
                kind, start = (int(y[t]) - 1) // 2, t
                t += 1
                while t < hi - lo and y[t] == 2 + 2 * kind:
                    t += 1
                cut = start == 0 and lo > 0 or t == hi - lo and hi < len(texts[k])
                out[k].append((kind, lo + start, lo + t, float(gain[j, start:t].sum()), cut))
    return out


def reconciled(text: str, found, base) -> list[tuple[int, int, int]]:
    """Of one text's decoded spans those that stay beside the base ones: joined, checked, and of overlapping ones the best set."""
    best: dict[tuple[int, int, int], float] = {}
    for kind, start, end, score, cut in found:
        if not cut:
            best[kind, start, end] = max(score, best.get((kind, start, end), 0.0))
    for kind in {f[0] for f in found if f[4]}:  # pieces of one kind that meet
        chain: list = []
        for _, start, end, score, cut in [*sorted(f for f in found if f[0] == kind), (kind, len(text) + 2, len(text) + 2, 0.0, False)]:
            if chain and start <= chain[1]:
                chain = [chain[0], max(chain[1], end), chain[2] + score, chain[3] or cut]
                continue
            if chain and chain[3]:
                best.setdefault((kind, chain[0], chain[1]), chain[2])
            chain = [start, end, score, cut]
    taken = sorted((s, e) for _, s, e in base)
    reach, most = [], 0
    for _, e in taken:
        most = max(most, e)
        reach.append(most)
    def wider(kind: int, start: int, end: int) -> bool:
        """Whether all base spans that it touches are parts of it, of its kind."""
        own = [b for b in base if b[1] < end and b[2] > start]
        return all(b[0] == kind and start <= b[1] and b[2] <= end and b[2] - b[1] < end - start for b in own)

    spans = []
    for (kind, start, end), score in best.items():
        while start < end and not (text[start].isalnum() or text[start] in "+("):  # white space and marks around it aren't the span's
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        at = bisect.bisect_left(taken, (end, 0))
        free = at == 0 or reach[at - 1] <= start or wider(kind, start, end)
        whole = not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end].isalnum())
        if score > 0 and free and whole and holds(kind, text[start:end]):
            spans.append((end, start, kind, score))
    spans.sort()
    ends, total, pick = [s[0] for s in spans], [0.0], []
    for k, (end, start, _, score) in enumerate(spans):
        before = bisect.bisect_right(ends, start, 0, k)
        pick.append((total[before] + score > total[k], before))
        total.append(max(total[k], total[before] + score))
    out, k = [], len(spans)
    while k:
        use, before = pick[k - 1]
        if use:
            end, start, kind, _ = spans[k - 1]
            out.append((kind, start, end))
        k = before if use else k - 1
    return out


def found_in(model: chartagger.Tagger, texts: list[str]):
    """(base spans, all spans) of each text, by kind and start."""
    for text, found in zip(texts, decoded(model, texts)):
        base = base_spans(text)
        yield base, sorted([*base, *reconciled(text, found, base)])


def with_spans(docs: DataFrame, model: chartagger.Tagger | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``; its ``text`` may be null. Only texts with a trigger are given to Python."""
    shared = docs.sparkSession.sparkContext.broadcast(model or trained())  # fixed size
    out = T.StructType([*docs.schema.fields, *T._parse_datatype_string(f"base {_SPAN}, spans {_SPAN}").fields])
    own = "_looked_at"
    while own in docs.columns:
        own += "_"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def of(batches):
        for b in batches:
            texts, base, spans = b.column(b.num_columns - 1).to_pylist(), [[]] * b.num_rows, [[]] * b.num_rows
            at = [k for k, t in enumerate(texts) if t]
            for lo in range(0, len(at), 512):
                part = at[lo : lo + 512]
                for k, (first, every) in zip(part, found_in(shared.value, [texts[j] for j in part])):
                    base[k], spans[k] = ([{"kind": KINDS[x], "start": s, "end": e} for x, s, e in y] for y in (first, every))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(base, kind), pa.array(spans, kind)], names=out.names)

    t = F.col(text)
    return docs.withColumn(own, F.when(t.rlike(TRIGGER), t)).mapInArrow(of, out)


def scan(docs: DataFrame, model: chartagger.Tagger | None = None) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points, by kind as listed, then start) of every document."""
    d = documents(docs)
    return with_spans(d.select("doc_id", F.when(F.col("text").rlike(TRIGGER), F.col("text")).alias("text")), model).select("doc_id", "base", "spans")


def redact(docs: DataFrame, model: chartagger.Tagger | None = None) -> DataFrame:
    """The documents, all columns and rows kept, with every span replaced by its kind in brackets and n_chars, if there, counted anew. A null text stays null."""
    names = docs.columns
    held = with_spans(docs.select(F.struct(*[F.col(c) for c in names]).alias("row"), F.col("text").alias("text")), model)

    def masked(texts, spans):
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            at, out = 0, []
            for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                at = max(at, s["end"])
            yield text if not own else "".join([*out, text[at:]])

    def of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(masked(b.column(1), b.column(2)), pa.string())], ["row", "clean"])

    schema = T.StructType([held.schema["row"], T.StructField("clean", T.StringType())])
    held = held.select("row", "text", "spans").mapInArrow(of, schema)
    new = {"text": F.col("clean")} | ({"n_chars": F.when(F.col("clean").isNotNull(), F.length("clean")).otherwise(F.col("row.n_chars")).cast("long")} if "n_chars" in names else {})
    return held.select(*[new.get(c, F.col("row")[c]).alias(c) for c in names])


def joined(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
