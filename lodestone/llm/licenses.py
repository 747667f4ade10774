"""License scans, in DataFrame functions only.

A unit of text (a whole document, and each of its lines) is normalised to words of a-z and 0-9; its
distinct word bigrams are compared with each template's by the Dice coefficient 2 * shared / (m + n).
Units without any of the words that every match needs are left before their bigrams are made. Units whose number of bigrams rules a template out (a coefficient of ``threshold`` needs m between
n * t / (2 - t) and n * (2 - t) / t) never meet it.

Notices that are no unit of their own, wrapped over lines of a longer text or inside a line, are found by
windows over the words of the whole text (`windows`). They are reported beside the units, with unit
-2 - (place of the window's first word in the text), unless a matching unit holds the whole window.

The templates' bigrams are a fixed small table, so it is broadcast; only bigrams that a unit shares with a
template that fits its size leave the scan's stage, already counted there.

Defined results: null or empty text has no units; of equal coefficients the first template in the order of
names wins; equal lines of one document are separate units; repeated rows give repeated results (each row
is a unit set of its own); null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents

THRESHOLD = 0.8

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = _BSD2 + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: (licence, template), public notices and licence texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "Released under the Apache License 2.0."), ("Apache-2.0", _APACHE),
    ("BSD-2-Clause", _BSD2), ("BSD-2-Clause", "Released under the BSD 2-Clause License."), ("BSD-3-Clause", _BSD3), ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."), ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", _GPL),
    ("ISC", _ISC), ("ISC", "Released under the ISC License."),
    ("MIT", "Released under the MIT License."), ("MIT", "Licensed under the MIT License."), ("MIT", _MIT_GRANT), ("MIT", _MIT_GRANT + " " + _MIT_WARRANTY),
    ("MPL-2.0", _MPL), ("Unlicense", _UNLICENSE),
)

_EVERYDAY = frozenset("a all an and any as at be by can do for from if in is it may not of on only or that the this to under use with without work you".split())
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bigram_run(text: str) -> list[str]:
    """The word bigrams of a template in order, normalised as units are."""
    words = [w for w in re.split("[^a-z0-9]+", text.translate(str.maketrans(_UPPER, _LOWER))) if w]
    return [f"{a} {b}" for a, b in zip(words, words[1:])]


def bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template."""
    return sorted(set(bigram_run(text)))


def template_rows(templates=TEMPLATES) -> list[tuple[str, int, str, int]]:
    """(licence, template, bigram, bigrams of the template)."""
    return [(name, k, g, len(gs)) for k, (name, text) in enumerate(templates) for gs in [bigrams(text)] for g in gs]


def needed_words(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Words of which every unit that reaches ``threshold`` with some template holds one at least.

    Such a unit shares t / (2 - t) of a template's bigrams; so, those of many templates and long words first
    and everyday words last, as many are taken as leave fewer bigrams than that untouched.
    """
    taken, held = set(), Counter(w for _, text in templates for w in {w for g in bigrams(text) for w in g.split(" ")})
    for _, text in templates:
        left = [set(g.split(" ")) for g in bigrams(text)]
        need = len(left) * threshold / (2 - threshold) - 1e-9
        for w in sorted(set().union(*left), key=lambda w: (w not in taken, w in _EVERYDAY, len(w) == 1, -held[w], -len(w), w)):
            if len(left) < need:
                break
            taken.add(w)
            left = [g for g in left if w not in g]
    return sorted(taken)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z0-9]+", " ")), " "), "")


def _grams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))


def _holding(docs: DataFrame, templates, threshold: float) -> DataFrame:
    """The documents with a needed word somewhere, found in one pass; no unit or window of another can match."""
    some = f"(?i)(?<![a-z0-9])(?:{'|'.join(needed_words(templates, threshold))})(?![a-z0-9])"
    return documents(docs).select("doc_id", "text").filter(F.col("text").rlike(some))


def windows(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit (-2 - the place of the first word), license, dice of notices inside of texts and lines.

    For each template, windows begin and end at one of its bigrams and have at most (2 - t) / t times as many
    bigrams, repeats counted, as the template. Of the windows with one beginning the one that exceeds the
    threshold's bigrams by most is taken; of overlapping ones, of all templates, the one that does so by most,
    then by coefficient, name, template and place. One that lies in a matching unit is that unit's.
    """
    schema = "array<struct<license:string,template:int,size:int,most:int,grams:array<string>>>"
    high, low = (2 - threshold) / threshold * (1 + 1e-12), threshold / (2 - threshold) * (1 - 1e-12)
    fixed = [(name, k, len(set(run)), int(len(run) * high), sorted(set(run))) for k, (name, text) in enumerate(templates) for run in [bigram_run(text)]]
    table = F.from_json(F.lit(json.dumps([dict(zip(("license", "template", "size", "most", "grams"), r)) for r in fixed])), schema)  # folded to a literal
    every = sorted({g for r in fixed for g in r[4]})

    def matches(grams):
        return F.exists(table, lambda t: 2 * F.size(F.array_intersect(t["grams"], grams)) >= threshold * (t["size"] + F.size(F.array_distinct(grams))) - 1e-9)

    # the running ids keep each step above what it uses, as in scan
    step = F.monotonically_increasing_id()
    text = _holding(docs, templates, threshold).select("doc_id", F.transform(F.split("text", "\n"), _words).alias("lines"), step.alias("row"))
    text = text.filter(F.arrays_overlap(F.flatten("lines"), F.array(*map(F.lit, needed_words(templates, threshold)))))
    text = text.select("doc_id", "row", "lines", _grams(F.flatten("lines")).alias("grams"), step.alias("a"))
    hits = F.filter("grams", lambda g: g.isin(*every))
    text = text.select("doc_id", "row", "lines", "grams", F.array_distinct(hits).alias("hits"), step.alias("a")).filter(F.size("hits") > 0)
    near = F.filter(table, lambda t: F.size(F.array_intersect(t["grams"], F.col("hits"))) >= low * t["size"])
    text = text.select("doc_id", "row", "lines", "grams", near.alias("near"), step.alias("a")).filter(F.size("near") > 0)
    of = F.flatten(F.transform("lines", lambda ws, i: F.array_repeat(i, F.size(ws))))  # the line of each word
    good = F.filter(F.transform("lines", lambda ws, i: F.when(matches(_grams(ws)), i)), lambda i: i.isNotNull())
    text = text.select("doc_id", "row", "grams", of.alias("line"), good.alias("good"), matches(F.col("grams")).alias("whole"), "near", step.alias("a")).filter(~F.col("whole"))
    text = text.select("doc_id", "row", "grams", "line", "good", F.explode("near").alias("t"))
    at = F.filter(F.transform("grams", lambda g, i: F.when(F.array_contains(F.col("t.grams"), g), i + 1)), lambda i: i.isNotNull())
    text = text.select("*", at.alias("at"), step.alias("a"))
    # enough of the template's bigrams must follow a beginning: the need-th of them within reach
    need = F.ceil(F.col("t.size") * low).cast("int")
    starts = F.filter(F.transform("at", lambda p, i: F.when(F.coalesce(F.try_element_at("at", i + need), F.lit(2**31 - 1)) - p < F.col("t.most"), p)), lambda p: p.isNotNull())
    text = text.select("doc_id", "row", "grams", "line", "good", "t", F.explode(starts).alias("p"), step.alias("a"))
    text = text.select("doc_id", "row", "line", "good", "t", "p", F.slice("grams", F.col("p"), F.col("t.most")).alias("g"), step.alias("a"))
    # 0: seen before in the window, 1: new, 2: new and the template's
    marks = F.transform("g", lambda g, i: F.when(F.array_position(F.col("g"), g) <= i, 0).when(F.array_contains(F.col("t.grams"), g), 2).otherwise(1))
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0).alias("s"), F.lit(-1.0).cast("double").alias("over"), F.lit(0).alias("end"), F.lit(0.0).cast("double").alias("dice"))

    def walk(a, x):
        i, n, s = a["i"] + 1, a["n"] + (x > 0).cast("int"), a["s"] + (x == 2).cast("int")
        over = 2 * s - F.lit(float(threshold)) * (n + F.col("t.size"))
        more = (over > a["over"] + 1e-9) & (over >= -1e-9)
        pick = lambda new, old: F.when(more, new).otherwise(a[old]).alias(old)
        return F.struct(i.alias("i"), n.alias("n"), s.alias("s"), pick(over, "over"), pick(i, "end"), pick(2 * s / (n + F.col("t.size")), "dice"))

    text = text.select("doc_id", "row", "line", "good", "t", "p", F.aggregate(marks, zero, walk).alias("w"), step.alias("a")).filter("w.end > 0")
    last = F.col("p") + F.col("w.end")  # the window's last word, from 1
    own = (F.element_at("line", F.col("p")) == F.element_at("line", last)) & F.array_contains("good", F.element_at("line", F.col("p")))
    key = F.struct((-F.round("w.over", 9)).alias("over"), (-F.col("w.dice")).alias("d"), F.col("t.license").alias("license"), F.col("t.template").alias("template"), F.col("p").alias("p"), last.alias("last"), own.alias("own"))
    found = text.select("doc_id", "row", key.alias("k")).groupBy("doc_id", "row").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    apart = lambda a, k: ~F.exists(a, lambda b: (b["p"] <= k["last"]) & (k["p"] <= b["last"]))
    none = F.array().cast("array<struct<over:double,d:double,license:string,template:int,p:int,last:int,own:boolean>>")
    best = F.aggregate("ks", none, lambda a, k: F.when(apart(a, k), F.concat(a, F.array(k))).otherwise(a))
    out = found.select("doc_id", F.explode(best).alias("b")).filter("not b.own")
    return out.select("doc_id", (-1 - F.col("b.p")).cast("long").alias("unit"), "b.license", F.round(-F.col("b.d"), 9).alias("dice"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, unit (-1: the whole text, else the line's number), license, dice: the best template of each unit that reaches ``threshold``, and the `windows`."""
    spark = docs.sparkSession
    rows = template_rows(templates)
    table = spark.createDataFrame(rows, "license string, template int, gram string, size int")
    sizes = sorted({r[3] for r in rows})
    low, high = threshold / (2 - threshold) * (1 - 1e-12), (2 - threshold) / threshold * (1 + 1e-12)
    fits = lambda n: " or ".join(f"{n} between {s * low} and {s * high}" for s in sizes)
    whole = F.struct(F.lit(-1).alias("unit"), F.col("text").alias("t"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("unit"), x.alias("t")))
    # a unit of m bigrams has at least 2 m + 2 characters less one; far longer ones are left for the exact bound
    least = 2 * int(min(sizes) * low)
    units = F.filter(F.concat(F.array(whole), lines), lambda u: F.length(u["t"]) > least)
    text = _holding(docs, templates, threshold).select("doc_id", F.explode(units).alias("u"))
    # the running ids keep each filter above what it filters, so words and bigrams are made once
    text = text.select("doc_id", "u.unit", F.monotonically_increasing_id().alias("row"), _words(F.col("u.t")).alias("words"))
    text = text.filter((F.size("words") > int(min(sizes) * low)) & F.arrays_overlap("words", F.array(*map(F.lit, needed_words(templates, threshold)))))
    # d distinct words make d - 1 distinct bigrams at least
    text = text.filter(F.size(F.array_distinct("words")) - 1 <= F.lit(max(sizes) * high))
    grams = F.array_distinct(_grams(F.col("words")))
    text = text.select("doc_id", "unit", F.monotonically_increasing_id().alias("row"), grams.alias("grams")).withColumn("n", F.size("grams")).filter(fits("n"))
    met = text.select("doc_id", "row", "unit", "n", F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")  # a fixed table of some hundreds of rows
    met = met.filter(F.col("n").between(F.col("size") * low, F.col("size") * high))
    shared = met.groupBy("doc_id", "row", "unit", "license", "template", "size", "n").agg(F.count("*").alias("shared"))
    found = shared.withColumn("dice", 2 * F.col("shared") / (F.col("size") + F.col("n"))).filter(F.col("dice") >= threshold - 1e-12)
    best = found.groupBy("doc_id", "row", "unit").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license", "template")).alias("b"))
    whole_units = best.select("doc_id", F.col("unit").cast("long").alias("unit"), "b.license", F.round(-F.col("b.d"), 9).alias("dice"))
    return whole_units.unionByName(windows(docs, templates, threshold))
