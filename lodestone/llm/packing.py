"""Packing: documents into fixed-length sequences by cutting-stock column generation.

1. Each document is encoded and cut: full pieces of ``capacity`` tokens and one remainder. Each task
   numbers its pieces within their length bucket while it encodes, so no sort is needed to rank them.
2. The remainders' histogram (a bucket for each length, so its size is bounded by ``capacity``) goes to the
   driver, where a linear program over patterns of lengths rounded up to ``grain`` is solved: a dense revised simplex whose columns are
   priced by an unbounded-knapsack dynamic program.
3. Patterns are rounded down; what is left is packed first-fit over the histogram. Then each pattern takes
   true lengths, and the room that rounding left in it is refilled from the histogram, longest first.
4. A piece's rank within its bucket (numbers of earlier tasks' pieces, then its own number) says which
   copy of which pattern, and which place there, it takes. Only narrow rows (no ids) are shuffled.

Lengths are rounded up to ``grain`` tokens in the linear program alone, not in what a sequence holds; pieces
stand gapless, so a sequence's padding is at its end.

Defined results: null or empty text packs its end id alone; repeated rows are packed each time; an empty
table gives no rows; null doc_id is kept; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, staged
from .tokens import encoder, vocabulary

CAPACITY, GRAIN, END_ID, VOCABULARY = 2048, 8, 1, "word_bpe_49k.json"


def solve_patterns(demand: np.ndarray, capacity: int, gap: float = 5e-4, rounds: int | None = None) -> list[tuple[np.ndarray, int]]:
    """Patterns and their numbers of copies that hold ``demand[k]`` items of size k + 1 in bins of ``capacity``.

    The linear program's solution is rounded down; the rest is packed first-fit, largest first. The
    simplex ends within ``gap`` of the least possible number of bins, or after ``rounds`` steps; any step's
    solution is feasible, so fewer only pad more.
    """
    sizes = np.flatnonzero(demand) + 1
    if not len(sizes):
        return []
    d, m = demand[sizes - 1].astype(float), len(sizes)
    place = np.zeros(capacity, np.int64)
    place[sizes - 1] = np.arange(m)
    basis = np.diag((capacity // sizes).astype(float))
    inverse, x = np.diag(1.0 / np.diag(basis)), d / np.diag(basis)
    for _ in range(rounds or 12 * m + 50):
        y = inverse.sum(axis=0)
        price = np.zeros(capacity)  # by size - 1
        price[sizes - 1] = y
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(1, capacity + 1):
            v = price[:c] + best[c - 1 :: -1]
            k = int(v.argmax())
            if v[k] > best[c - 1] + 1e-12:
                best[c], took[c] = v[k], k
            else:
                best[c] = best[c - 1]
        bins = float(x.sum())
        if bins - bins / best[capacity] <= max(0.25, gap * bins):  # no solution takes fewer than bins / best
            break
        column, c = np.zeros(m), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                column[place[took[c]]] += 1
                c -= took[c] + 1
        w = inverse @ column
        up = w > 1e-9
        if not up.any():
            break
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(x[up], 0) / w[up]
        out = int(ratio.argmin())
        step = ratio[out]
        x -= step * w
        x[out] = step
        pivot = inverse[out] / w[out]
        inverse -= np.outer(w, pivot)
        inverse[out] = pivot
        basis[:, out] = column
    copies = np.floor(np.maximum(x, 0) + 1e-6).astype(np.int64)
    plan, left = [], d.astype(np.int64)
    for k in np.flatnonzero(copies):
        a = basis[:, k].astype(np.int64)
        used = a > 0
        full = min(int(copies[k]), int((left[used] // a[used]).min()))
        if full > 0:
            plan.append((a, full))
            left -= a * full
    while left.any():
        a, room = np.zeros(m, np.int64), capacity
        for k in range(m - 1, -1, -1):
            if left[k] and sizes[k] <= room:
                n = min(int(left[k]), room // int(sizes[k]))
                a[k], room = n, room - n * int(sizes[k])
        full = int((left[a > 0] // a[a > 0]).min())
        plan.append((a, full))
        left -= a * full
    whole = []
    for a, n in plan:
        spread = np.zeros(len(demand), np.int64)
        spread[sizes - 1] = a
        whole.append((spread, n))
    return whole


def refilled(plan: list[tuple[np.ndarray, int]], found: np.ndarray, capacity: int, grain: int) -> list[tuple[np.ndarray, int]]:
    """The plan with true lengths, ``found[k]`` pieces of length k + 1, and no room left that a piece still to come would fit.

    Each copy takes what its pattern asks for as far as pieces are left, so no more copies are made than planned.
    """
    left, out = found.astype(np.int64), []
    for a, n in plan:
        asked = np.flatnonzero(a)[::-1]
        while n > 0 and left.any():
            own, room = np.zeros(len(left), np.int64), capacity
            for b in asked:
                more = int(a[b])
                for k in range(min((b + 1) * grain, len(left)) - 1, b * grain - 1, -1):
                    take = min(more, int(left[k]))
                    own[k], room, more = take, room - take * (k + 1), more - take
                    if not more:
                        break
            for k in np.flatnonzero(left[:room] > own[:room])[::-1]:
                if k < room:
                    take = min(int(left[k] - own[k]), room // int(k + 1))
                    own[k], room = own[k] + take, room - take * int(k + 1)
            used = own > 0
            full = min(n, int((left[used] // own[used]).min()))
            out.append((own, full))
            left, n = left - own * full, n - full
    return out


def places(plan: list[tuple[np.ndarray, int]], first: int, buckets: int) -> list[list[np.ndarray]]:
    """For each bucket the runs of ranks, in order: first rank, first sequence, items a sequence, first slot."""
    runs: list[list[list[int]]] = [[[], [], [], []] for _ in range(buckets)]
    at = np.zeros(buckets, np.int64)
    for a, n in plan:
        slot = 0
        for b in np.flatnonzero(a):
            for r, v in zip(runs[b], (int(at[b]), first, int(a[b]), slot)):
                r.append(v)
            at[b] += a[b] * n
            slot += int(a[b])
        first += n
    return [[np.array(r, np.int64) for r in four] for four in runs]


def pieces(docs: DataFrame, name: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, its task, bucket (its length) and number there; with ``ids`` its ids as well (unsigned 16-bit, little-endian)."""
    ids_too, names = ids, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "bucket", "number", "ids"][: 9 if ids else 8]
    kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.int64(), pa.binary()][: 2 if ids else 1]

    def cut(batches):
        from pyspark import TaskContext

        own, task, seen = encoder(vocabulary(name)), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            keys = b.column(0)
            for lo, hi, ids, bounds in own.runs(b.column(1)):
                size = np.diff(bounds) + 1
                edges = np.concatenate([[0], np.cumsum(size)])
                every = np.full(int(edges[-1]), end_id, "<u2")  # each document's ids, then the end id
                every[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), size - 1)] = ids
                count = -(-size // capacity)
                doc = np.repeat(np.arange(hi - lo), count)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
                length = np.minimum(size[doc] - start, capacity)
                at = edges[doc] + start
                number = np.empty(len(doc), np.int64)
                order = np.argsort(length, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(length[order]) != 0])
                runs = np.diff(np.r_[first, len(order)])
                number[order] = np.arange(len(order)) - np.repeat(first, runs) + seen[length[order]]
                seen[length[order[first]]] += runs
                wide, places = every.astype("<u4"), list(zip(at.tolist(), (at + length).tolist()))
                cols = [keys.slice(lo, hi - lo).take(pa.array(doc)), start, length, [zlib.crc32(wide[x:y]) for x, y in places], size[doc], np.full(len(doc), task), length, number]
                if ids_too:
                    cols.append([every[x:y].tobytes() for x, y in places])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, bucket int, number long" + ", ids binary" * ids
    return documents(docs).select("doc_id", "text").mapInArrow(cut, schema)


def pack(docs: DataFrame, name: str = VOCABULARY, capacity: int = CAPACITY, grain: int = GRAIN, end_id: int = END_ID, ids: bool = False) -> DataFrame:
    """The pieces with sequence_id and offset; see the module for how they are found.

    A sequence with one full piece takes no padding and no part in the linear program.
    """
    cut = staged(pieces(docs, name, capacity, end_id, ids), "pieces")
    counts = staged(cut.groupBy("task", "bucket").agg(F.count("*").alias("n")), "piece_counts")
    earlier = Window.partitionBy("bucket").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("task", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    found = {r["bucket"]: r["n"] for r in counts.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    lengths = np.array([found.get(k, 0) for k in range(1, capacity)], np.int64)
    demand = np.zeros(-(-capacity // grain), np.int64)
    np.add.at(demand, np.arange(capacity - 1) // grain, lengths)
    plan = refilled(solve_patterns(demand, capacity // grain), lengths, capacity, grain)
    runs = places(plan, found.get(capacity, 0), capacity - 1)

    def place(batches):
        for b in batches:
            bucket, rank = b.column("bucket").to_numpy(), b.column("rank").to_numpy()
            sequence, slot = rank.astype(np.int64).copy(), np.zeros(len(rank), np.int64)
            for k in np.unique(bucket[bucket < capacity]):
                at = np.flatnonzero(bucket == k)
                first, base, each, slots = runs[k - 1]
                i = np.searchsorted(first, rank[at], "right") - 1
                past = rank[at] - first[i]
                sequence[at], slot[at] = base[i] + past // each[i], slots[i] + past % each[i]
            keep = [n for n in b.schema.names if n not in ("bucket", "rank")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sequence), pa.array(slot)], [*keep, "sequence_id", "slot"])

    ranked = cut.join(before, ["task", "bucket"]).withColumn("rank", F.col("before") + F.col("number")).drop("before", "number", "task")
    own = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * ids
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids, "bucket", "rank")
    placed = ranked.mapInArrow(place, own + ", sequence_id long, slot long")
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most capacity rows
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0))).drop("slot")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, of ``pack(..., ids=True)``: sequence_id, length, ids (16-bit, gapless, unpadded)."""
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("rows"), F.sum("length").alias("length"))
    return rows.select("sequence_id", "length", F.aggregate("rows", F.lit(b"").cast("binary"), lambda a, r: F.concat(a, r["ids"])).alias("ids"))
