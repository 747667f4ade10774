"""N-gram Jaccard join by vertical partitioning.

A document's set holds 64-bit hashes of its distinct word shingles. A global order of shingles (rare ones
by hash, then frequent ones by count) does two jobs:

* candidates: two sets of similarity t or more share a shingle among the first n - ceil(t n) + 1 of each
  (prefix filter, with the positional bound), so only those are ever shuffled by shingle;
* counting: the order is cut into fragments; partial overlaps of a candidate pair are counted fragment by
  fragment and summed per pair. The sum is exact.

Documents with equal sets are one node. Within a shingle's bucket pairs are first made with one leader only,
then with a few of the bucket's largest component; once those links have merged components, only pairs of
different components are left to count, so a group of g near copies costs some g counts, not g squared, and no
component is lost. (A pair already known to be connected can't change any component.)

The frequency order comes from counts over all documents. Each task counts its own and reports what it
saw ``report`` times; the ``frequent`` most frequent are kept, a bound for the broadcast. Any order gives
the same links; this one keeps buckets small.

Defined results: null or empty text and text without words has an empty set, linked with nothing; fewer
words than a shingle make one shingle of all; a null doc_id takes part in no link and its component_id is
null; repeated rows each get their row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, dropped, staged
from .components import components

WORDS, PERCENT, FRAGMENTS = 5, 80, 4
#: COUNTED and MERGED bound what a counting task holds: shingles counted, and shingles of texts not yet added.
FREQUENT, REPORT, COUNTED, MERGED = 200_000, 5, 500_000, 200_000
#: Leaders tried in a bucket where more than MANY pairs of different components are left.
LEADERS, MANY, FIRST_FROM = 8, 256, 20_000
#: Shared shingles of a prefix that the last join of buckets carries along.
HEAD = 64
#: Turns in which prefixes are shuffled by shingle, a range of hashes each, so that one turn's files are on disk at once.
TURNS = 4
SLICE = 500_000  # bytes of text worked on at a time

_random = np.random.default_rng(20240607)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[[32, *range(9, 14)]] = 0
_PLACE = _random.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; A-Z count as a-z. Works on the UTF-8 bytes of many texts at once."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE, "right")) - 1)
        yield from _slice_sets(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], words)
        lo = hi


def _words(b: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of each word of some bytes, in which texts begin at ``edges``."""
    b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
    value = _BYTE[b]
    starts = value != 0
    first = np.zeros(len(b), bool)
    first[edges[edges < len(b)]] = True
    starts[1:] &= (value[:-1] == 0) | first[1:]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), at
    # the sum of byte values times powers of an odd number, brought back to the word's start
    return _mix(np.add.reduceat(value * _powers(_STEP, len(b)), at) * _powers(_BACK, len(b))[at]), at


def _slice_sets(b: np.ndarray, edges: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sets of the texts between ``edges``; of a text longer than a slice, words are hashed slice by slice."""
    found, at, lo = [], [], 0
    while lo < len(b):
        hi = min(lo + SLICE, len(b))
        if hi < len(b):
            gaps = np.flatnonzero(_BYTE[b[lo:hi]] == 0)
            while not len(gaps) and hi < len(b):  # a word longer than a slice
                hi = min(hi + SLICE, len(b))
                gaps = np.flatnonzero(_BYTE[b[lo:hi]] == 0)
            hi = lo + int(gaps[-1]) + 1 if len(gaps) and hi < len(b) else hi
        inside = edges[:-1][(edges[:-1] >= lo) & (edges[:-1] < hi)] - lo
        hashes, places = _words(b[lo:hi], inside)
        found.append(hashes)
        at.append(places + lo)
        lo = hi
    none = np.zeros(0, np.uint64)
    word, at = (np.concatenate(x) if x else none for x in (found, at))
    bounds = np.searchsorted(at, edges)
    run = word[: max(0, len(word) - words + 1)] * _PLACE[0]
    for j in range(1, words):
        run = run + word[j : j + len(run)] * _PLACE[j]
    run = _mix(run)
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= words:
            yield np.unique(run[lo : hi - words + 1])
        elif hi > lo:
            yield _mix(np.sum(word[lo:hi] * _PLACE[8 : 8 + hi - lo], keepdims=True) + _PLACE[40 + hi - lo])
        else:
            yield none


def _least(n: int, percent: int) -> int:
    """The fewest shingles that a set of n shares with any set similar to it."""
    return -(-percent * n // 100)


def frequent_shingles(docs: DataFrame, words: int = WORDS, frequent: int = FREQUENT, report: int = REPORT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of at most ``frequent`` shingles; memory of a task is bounded by lossy counting (Manku and Motwani, 2002)."""

    def count(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge(k, c, more):
            new, n = np.unique(np.concatenate(more), return_counts=True)
            k, c = np.concatenate([k, new]), np.concatenate([c, n])
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            k, c = k[edge], np.add.reduceat(c, edge)
            if len(k) > COUNTED:
                k, c = k[c > 1], c[c > 1]
            return k, c

        for b in batches:
            held, n = [], 0
            for s in text_sets(b.column(0), words):
                held.append(s)
                n += len(s)
                if n > MERGED:
                    keys, counts = merge(keys, counts, held)
                    held, n = [], 0
            if n:
                keys, counts = merge(keys, counts, held)
        often = counts >= report
        yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(counts[often])], ["h", "n"])

    found = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.col("n").desc(), "h").limit(frequent).toPandas()
    keys = top["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy(np.int64)[order]


def _split(s: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rare, places in ``often`` of the frequent) of a sorted set."""
    if not len(often):
        return s, np.zeros(0, np.int64)
    at = np.searchsorted(often, s)
    at[at == len(often)] = 0
    hit = often[at] == s
    return s[~hit], at[hit]


def sets(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (size), set_id (128-bit digest of the set), prefix (its first shingles in the global order, as int64 array)."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def find(batches):
        keys, counts = shared.value
        for b in batches:
            n, ids, prefix = [], [], []
            for s in text_sets(b.column(1), words):
                rare, at = _split(s, keys)
                take = len(s) - _least(len(s), percent) + 1 if len(s) else 0
                if take > len(rare):
                    at = at[np.argsort(counts[at], kind="stable")]
                    rare = np.concatenate([rare, keys[at]])
                n.append(len(s))
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefix.append(rare[:take].view(np.int64))
            flat = pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, prefix)]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), lists], ["doc_id", "n", "set_id", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id long, n long, set_id binary, prefix array<long>")


def fragments(docs: DataFrame, often: tuple[np.ndarray, np.ndarray], words: int = WORDS, parts: int = FRAGMENTS) -> DataFrame:
    """set_id, hashes: each set cut at fixed places of the global order, a fragment each; the last one holds the frequent shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(often[0])
    pivots = np.array([(2**64 // (parts - 1)) * k for k in range(1, parts - 1)], np.uint64)

    def batch(ids, held):
        flat = pa.array([x.tobytes() for row in held for x in row], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * parts, pa.int32()), flat)], ["set_id", "hashes"])

    def cut(batches):
        for b in batches:
            ids, held, size = [], [], 0
            for s in text_sets(b.column(0), words):
                if not len(s):
                    continue
                rare, at = _split(s, shared.value)
                ids.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                held.append([*np.split(rare, np.searchsorted(rare, pivots)), shared.value[at]])
                size += len(s)
                if size > 500_000:
                    yield batch(ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield batch(ids, held)

    return docs.select("text").mapInArrow(cut, "set_id binary, hashes array<binary>")


def cut_nodes(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, often, words: int, parts: int) -> DataFrame:
    """node and its fragments (hashes) for every node in the pairs (a, na, b, nb). Only their texts are read again."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    wanted = staged(nodes.join(wanted, "node").select("node", "set_id", "doc_id"), "wanted")
    texts = docs.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    cut = fragments(texts, often, words, parts).join(wanted.select("node", "set_id"), "set_id").dropDuplicates(["set_id"])
    cut = staged(cut.select("node", "hashes"), "fragments")
    dropped(wanted)
    return cut


def links(cut: DataFrame, pairs: DataFrame, percent: int, parts: int = FRAGMENTS) -> DataFrame:
    """Those of the pairs (a, na, b, nb) that are similar, with their overlap: the sum of the partial overlaps of their fragments.

    Fragments are counted in turn; a pair ends early, with the sum so far, once the rest can't make it similar.
    """
    left = cut.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    right = cut.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    names = [f"part{k}" for k in range(parts)]

    def partial(x: list[bytes], y: list[bytes], need: int) -> list[int]:
        can = [min(len(p), len(q)) // 8 for p, q in zip(x, y)]
        out, most = [0] * parts, sum(can)
        for k, (p, q) in enumerate(zip(x, y)):
            if most < need:
                break
            if can[k]:
                out[k] = len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True))
                most += out[k] - can[k]
        return out

    def count(batches):
        for b in batches:
            need = -(-percent * (b.column("na").to_numpy() + b.column("nb").to_numpy()) // (100 + percent))
            found = np.array([partial(b.column("ha")[k].as_py(), b.column("hb")[k].as_py(), n) for k, n in enumerate(need.tolist())], np.int64).reshape(-1, parts)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("a", "na", "b", "nb")), *map(pa.array, np.ascontiguousarray(found.T))], ["a", "na", "b", "nb", *names])

    met = pairs.join(left, "a").join(right, "b").select("a", "na", "b", "nb", "ha", "hb")
    counted = met.mapInArrow(count, "a long, na long, b long, nb long, " + ", ".join(f"{n} long" for n in names))
    overlap = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    counted = counted.select("a", "na", "b", "nb", overlap.alias("overlap"))
    return staged(counted.filter(100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))), "similar")


def _similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, often, words: int, percent: int, parts: int, known: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that, beside the ``known`` ones, connect all that the similar ones among the staged pairs (a, na, b, nb, shared) connect.

    With ``known``, and pairs by the ten thousand, each node is first counted against a few others: the one whose prefix
    shares most, and some by a hash, the same for all nodes, so that they meet; then only pairs still apart are counted.
    """
    cut, first = cut_nodes(docs, nodes, pairs, often, words, parts), None
    if known is not None and pairs.count() > FIRST_FROM:
        sides = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "a", "na", "b", "nb", "shared")
        sides = sides.union(pairs.select("b", "a", "a", "na", "b", "nb", "shared"))
        pair = F.struct("a", "na", "b", "nb")
        drawn = [F.min(F.struct(F.xxhash64("y", F.lit(k)).alias("o"), pair.alias("p")))["p"] for k in range(LEADERS)]
        some = sides.groupBy("x").agg(F.array(F.max(F.struct("shared", pair.alias("p")))["p"], *drawn).alias("some"))
        now = staged(some.select(F.explode("some").alias("p")).select("p.*").distinct(), "first")
        first = links(cut, now, percent, parts).select("a", "b")
        rooted = components(known.union(first), "a", "b")
        ra, rb = (rooted.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        # the few that were counted and aren't similar are counted again: cheaper than a join that takes them out
        left = pairs.join(ra, "a", "left").join(rb, "b", "left")
        left = staged(left.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "na", "b", "nb"), "apart")
        dropped(now, pairs)
        pairs = left
    found = links(cut, pairs, percent, parts).select("a", "b")
    dropped(cut, pairs)
    return found if first is None else found.union(first)


def _needed(percent: int):
    """The overlap that makes sets of na and nb shingles similar."""
    return F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))


def _may_link(percent: int):
    """Size bound, and positional bound at a shared shingle of two prefixes: the overlap needed against what can still come."""
    low, high = F.least("na", "nb"), F.greatest("na", "nb")
    return (100 * low >= percent * high) & (F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= _needed(percent))


def _postings(prefixes: DataFrame, turns: int = TURNS) -> list[DataFrame]:
    """(h, node, n, pos, leader) of each shingle h that stands in several of the prefixes (node, n, prefix); leader is the bucket's first node, with its n and pos.

    Most shingles are in one prefix only and go where they are counted: each row is shuffled once, in the turn of its hash.
    """
    every = prefixes.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    bucket = Window.partitionBy("h")

    def turn(k: int) -> DataFrame:
        met = every.filter(F.pmod("h", F.lit(turns)) == k)
        met = met.select("h", "node", "n", "pos", F.min(F.struct("node", "n", "pos")).over(bucket).alias("leader"), F.count("*").over(bucket).alias("size"))
        return staged(met.filter("size > 1").drop("size"), "postings")

    return [turn(k) for k in range(turns)]


def _promising(pairs: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """The pairs whose prefixes share enough, and how many (shared): past its prefix, the one whose prefix ends first in the order has fewer than ``_least`` shingles left to share."""
    prefix = lambda c: short.select(F.col("node").alias(c), F.col("prefix").alias(f"x{c}"))
    met = pairs.join(prefix("a"), "a").join(prefix("b"), "b")
    left = F.ceil(F.lit(percent) * F.greatest("na", "nb") / F.lit(100)) - 1
    met = met.withColumn("shared", F.size(F.array_intersect("xa", "xb"))).drop("xa", "xb")
    return staged(met.filter(F.col("shared") + left >= _needed(percent)), "promising")


def _open(live: DataFrame, rooted: DataFrame) -> DataFrame:
    """The rows (h, node, n, pos, root) of buckets that hold more than one component; of buckets with the same nodes the first one's.

    A passage that some texts share makes many such buckets. Their pairs are the same, and the first shingle in the
    global order, which is the first in each of those prefixes, has the widest positional bound. Nodes are compared by 128 bits.
    """
    joined = live.join(rooted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in range(2)]
    each = joined.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct("node", "pos")).alias("at"), *marks)
    several = each.filter("lo < hi").groupBy("m0", "m1").agg(F.min(F.struct("at.pos", "h"))["h"].alias("h")).select("h")
    return staged(joined.join(several, "h"), "open_buckets")


def _cells(rest: DataFrame, percent: int) -> DataFrame:
    """The rows of open buckets by cells (h, cell) of like sizes, those of cells that can hold a pair only; ``own`` marks a row's own size.

    A cell spans the ratio of sizes that can be similar, so of a pair the larger one's cell is the smaller one's or the
    next: a row stands in its own, and in the next too where its place still allows a partner that large.
    """
    width = 1.000001 * max(math.log(100 / percent), 0.01)  # a little wider than the ratio, for rounding
    largest = F.lit((100 + percent) / percent) * (F.col("n") - F.col("pos")) - F.col("n") + F.lit(0.5)
    cell = lambda n: F.floor(F.log(n) / F.lit(width))
    own = rest.withColumn("own_cell", cell(F.col("n"))).withColumn("next", (cell(F.greatest(largest, F.col("n"))) > F.col("own_cell")))
    placed = own.withColumn("cell", F.explode(F.when(F.col("next"), F.array("own_cell", F.col("own_cell") + 1)).otherwise(F.array("own_cell"))))
    placed = placed.select("h", "cell", "node", "n", "pos", "root", (F.col("cell") == F.col("own_cell")).alias("own"))
    several = placed.groupBy("h", "cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("own").alias("met")).filter("met and lo < hi")
    return staged(placed.join(several.select("h", "cell"), ["h", "cell"]), "cells")


def _crossing(rest: DataFrame, short: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, na, b, nb, shared) of nodes of different components that share a cell of `_cells`; shared as in `_promising`, null where not known yet.

    A pair is made in the bucket of the first shingle that both prefixes hold, not in each bucket it shares: an earlier
    one among the first HEAD leaves the others out, as the positional bound is widest there. Where both prefixes
    end within HEAD, their whole overlap is known too, and pairs that `_promising` would drop aren't made.
    """
    head = short.select("node", F.slice("prefix", 1, HEAD).alias("x"), (F.size("prefix") <= HEAD).alias("w"))
    place = F.array_position("x", F.col("h")).cast("int")  # from 1; 0: beyond HEAD
    held = rest.join(head, "node").withColumn("before", F.when(place > 0, place - 1).otherwise(F.size("x")))
    side = lambda c, rows: rows.select(F.col("h").alias(f"h{c}"), F.col("cell").alias(f"c{c}"), F.col("node").alias(c), *[F.col(k).alias(v + c) for k, v in (("n", "n"), ("pos", "p"), ("root", "r"), ("x", "x"), ("w", "w"), ("before", "q"))])
    before = lambda c: F.slice(f"x{c}", F.lit(1), F.col(f"q{c}"))
    rest_of = F.ceil(F.lit(percent) * F.greatest("na", "nb") / F.lit(100)) - 1
    shared = F.when(F.col("wa") & F.col("wb"), F.size(F.array_intersect("xa", "xb")))
    enough = shared.isNull() | (shared + rest_of >= _needed(percent))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = (F.col("ha") == F.col("hb")) & (F.col("ca") == F.col("cb")) & ordered & (F.col("ra") != F.col("rb")) & _may_link(percent)
    return side("a", held).join(side("b", held.filter("own")), met & ~F.arrays_overlap(before("a"), before("b")) & enough).select("a", "na", "b", "nb", shared.alias("shared")).distinct()


def similar_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, parts: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included)."""
    docs = documents(docs)
    often = frequent_shingles(docs, words)
    found = staged(sets(docs, often, words, percent).withColumn("row", F.monotonically_increasing_id()), "sets")
    rows = staged(found.drop("prefix"), "rows")
    full = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    nodes = staged(full.groupBy("set_id").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "nodes")
    prefixes = found.select(F.col("row").alias("node"), "n", "prefix").join(nodes.select("node"), "node", "left_semi")
    prefixes = staged(prefixes, "prefixes")
    dropped(found)
    held = _postings(prefixes)
    dropped(prefixes)
    buckets = reduce(DataFrame.union, held)
    # of a prefix only the shingles that others hold, in order: what it shares with another stays the same
    short = buckets.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("pos", "h")))["h"].alias("prefix"))
    short = staged(short, "short")
    live = buckets
    near = live.filter(F.col("node") != F.col("leader.node")).select(F.col("leader.node").alias("a"), F.col("leader.n").alias("na"), F.col("leader.pos").alias("pa"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    pairs = staged(near.filter(_may_link(percent)).select("a", "na", "b", "nb").distinct(), "pairs")
    found = _similar(docs, nodes, _promising(pairs, short, percent), often, words, percent, parts)
    rooted = components(found, "a", "b")

    live = live.select("h", "node", "n", "pos")
    # a node of the largest component in a bucket: the others' nodes are likeliest to be similar to it. Where many pairs
    # would be left, some of the whole bucket as well, each the least by another hash, the same in all buckets, so that nodes meet
    rest = _open(live, rooted)
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("order"), "node", "n", "pos", "root")).alias(f"l{k}") for k in range(LEADERS)]
    leaders = rest.groupBy("h", "root").agg(F.count("*").alias("size"), *drawn)
    most = F.max(F.struct("size", "root", "l0")).alias("m")
    leaders = leaders.groupBy("h").agg(most, F.sum("size").alias("total"), *[F.min(f"l{k}").alias(f"l{k}") for k in range(LEADERS)])
    many = F.col("m.size") * (F.col("total") - F.col("m.size")) > MANY
    plain = lambda c: F.col(c).dropFields("order")
    some = F.when(many, F.array_distinct(F.array(plain("m.l0"), *[plain(f"l{k}") for k in range(LEADERS)]))).otherwise(F.array(plain("m.l0")))
    near = rest.join(leaders.select("h", some.alias("leaders")), "h")
    near = near.select("node", "n", "pos", "root", F.explode("leaders").alias("leader")).filter(F.col("root") != F.col("leader.root"))
    near = near.select(F.col("leader.node").alias("a"), F.col("leader.n").alias("na"), F.col("leader.pos").alias("pa"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    more = staged(near.filter(_may_link(percent)).select("a", "na", "b", "nb").distinct(), "more_pairs")
    dropped(rest)
    more = _promising(more, short, percent)
    if more.take(1):
        found = found.union(_similar(docs, nodes, more, often, words, percent, parts))
        rooted = components(found, "a", "b")

    rest = _open(live, rooted)
    cells = _cells(rest, percent)
    dropped(rest, *held)
    crossing = met = staged(_crossing(cells, short, percent), "crossing")
    dropped(cells)
    untested, rest = met.filter("shared is null").drop("shared"), None
    if untested.take(1):
        rest = _promising(untested, short, percent)
        crossing = met.filter("shared is not null").unionByName(rest)
    if crossing.take(1):
        found = found.union(_similar(docs, nodes, crossing, often, words, percent, parts, found))
        rooted = components(found, "a", "b")
    dropped(met, rest, short)

    root = F.coalesce("root", "node")
    whole = nodes.join(rooted, "node", "left").select("set_id", "doc_id", root.alias("root"))
    least = whole.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = whole.join(least, "root").select("set_id", "component_id")
    empty = F.col("n") == 0
    linked = rows.filter(~empty & F.col("doc_id").isNotNull()).join(of_set, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter(empty | F.col("doc_id").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
