"""Token files: ids under Re-Pair grammar compression, per shard, with random access.

A file set is a folder of Parquet rows, one for each shard of about ``shard_ids`` ids, in ascending order
of documents. A shard holds

* ``doc_ids`` (int64), ``doc_tokens`` and ``doc_symbols`` (int32 each): its documents and their lengths
  before and after compression, so a document is found without decoding what stands before it;
* ``rules`` (pairs of uint16): nonterminal ``vocabulary + k`` stands for pair k, whose members are ids or
  earlier nonterminals;
* ``lengths`` (uint32): how many ids each nonterminal expands to;
* ``body`` (uint16): the symbols.

Re-Pair runs in rounds: all adjacent pairs are counted exactly, the most frequent get nonterminals, and
every leftmost non-overlapping occurrence is replaced. A round gives away a quarter of the symbols left (256 at
least), and only to pairs that are replaced ``least`` times: a rule takes 8 bytes, a replacement saves 2. It ends
when symbols run out, or when neither a round's pairs nor the most frequent alone gain that much. No pair begins with the end id, so documents begin
at symbols.

Defined results: null or empty text is its end id alone; a null doc_id comes first; repeated rows are
written each time (ties in the order of their texts); an empty table gives no shards; other columns are
ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents
from .tokens import encoder, vocabulary

VOCABULARY, END_ID, SHARD_IDS = "byte_bpe_50k.json", 2, 1 << 19
#: The share of the symbols left that a round may give away is one in SHARE.
SHARE = 4
_TABLE, _ODD = 20, np.uint32(0x9E3779B1)
SHARD = "task int, shard int, n_ids long, doc_ids binary, doc_null binary, doc_tokens binary, doc_symbols binary, base int, rules binary, lengths binary, body binary"


def _occurrences(pair: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the leftmost non-overlapping occurrences of the chosen pairs (ascending) begin, and which pair each is.

    Of pairs that share a place in the table of hashes the last one is looked for; the others wait for another round.
    """
    slot = (chosen * _ODD) >> np.uint32(32 - _TABLE)
    taken, table = np.zeros(1 << _TABLE, bool), np.empty(1 << _TABLE, np.uint16)
    taken[slot] = True
    table[slot] = np.arange(len(chosen))
    # most places fall to the small table of flags
    slot = (pair * _ODD) >> np.uint32(32 - _TABLE)
    at = np.flatnonzero(taken.take(slot, mode="clip"))
    where = table[slot[at]]
    same = chosen[where] == pair[at]
    at, where = at[same], where[same]
    begins = np.r_[True, np.diff(at) != 1]
    run = at - at[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    first = (run & 1) == 0
    return at[first], where[first]


def compress(ids: np.ndarray, base: int, end_id: int, rounds: int | None = None, least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(body, rules, lengths) of one shard. ``base`` is the first nonterminal; symbols stay below 65,536. ``rounds`` may bound the rounds."""
    body, rules, size = ids.astype(np.uint32), [], np.ones(base, np.uint32)
    top = base
    while len(body) > 1 and top < 65_536 and (rounds is None or len(rules) < rounds):
        room = max((65_536 - top) // SHARE, min(256, 65_536 - top))
        left = body[:-1]
        pair = (left << np.uint32(16)) | body[1:]
        ordered = np.sort(pair[left != end_id])
        edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        counts = np.diff(edges, append=len(ordered))
        often = np.flatnonzero(counts >= least)
        often = often[np.argsort(-counts[often], kind="stable")[:room]]
        for some in (often, often[:1]):  # together they may take one another's places
            chosen = np.sort(ordered[edges[some]])
            if not len(chosen):
                break
            at, where = _occurrences(pair, chosen)
            good = np.bincount(where, minlength=len(chosen)) >= least
            if good.any():
                break
        if not len(often) or not good.any():
            break
        at, where, chosen = at[good[where]], (np.cumsum(good) - 1)[where[good[where]]], chosen[good]
        body[at] = top + where
        keep = np.ones(len(body), bool)
        keep[at + 1] = False
        body = body[keep]
        rules.append(chosen)
        size = np.r_[size, size[chosen >> np.uint32(16)] + size[chosen & np.uint32(0xFFFF)]]
        top += len(chosen)
    codes = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    pairs = np.stack([codes >> np.uint32(16), codes & np.uint32(0xFFFF)], 1).astype("<u2")
    return body.astype("<u2"), pairs, size[base:].astype("<u4")


def expansions(base: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, starts, sizes): symbol s expands to flat[starts[s] : starts[s] + sizes[s]]."""
    sizes = np.r_[np.ones(base, np.int64), lengths.astype(np.int64)]
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    flat = np.empty(int(sizes.sum()), "<u2")
    flat[:base] = np.arange(base)
    latest, done = np.maximum.accumulate(rules.max(1)) if len(rules) else np.zeros(0, np.uint16), 0
    while done < len(rules):  # a round's rules, whose members all are there, at once
        stop = max(done + 1, int(np.searchsorted(latest, base + done)))
        at = int(starts[base + done])
        found = expand(rules[done:stop].ravel(), (flat, starts, sizes))
        flat[at : at + len(found)] = found
        done = stop
    return flat, starts, sizes


def expand(body: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of symbols."""
    flat, starts, sizes = table
    n = sizes[body]
    ends = np.cumsum(n)
    return flat[np.repeat(starts[body] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]


def symbols_of(doc_tokens: np.ndarray, body: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """How many symbols each document takes."""
    size = np.where(body < base, 1, np.r_[lengths, 1].astype(np.int64)[np.maximum(body.astype(np.int64) - base, -1)])
    ends = np.searchsorted(np.cumsum(size), np.cumsum(doc_tokens), "left") + 1
    return np.diff(np.r_[0, ends]).astype("<i4")


def shards(docs: DataFrame, name: str = VOCABULARY, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shards of all documents: ranges of doc_id go to tasks, each of which encodes and compresses its own in order."""
    def write(batches):
        from pyspark import TaskContext

        own, task, number = encoder(vocabulary(name)), TaskContext.get().partitionId(), 0
        base, keys, held, sizes, n = own.tokenizer.get_vocab_size(), [], [], [], 0

        def shard():
            key, size = pa.chunked_array(keys), np.concatenate(sizes).astype("<i4")
            body, rules, lengths = compress(np.concatenate(held), base, end_id)
            row = (task, number, int(size.sum()), key.fill_null(0).to_numpy().astype("<i8").tobytes(), key.is_null().to_numpy().astype("u1").tobytes(), size.tobytes(), symbols_of(size, body, lengths, base).tobytes(), base, rules.tobytes(), lengths.tobytes(), body.tobytes())
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int32(), *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [x.split()[0] for x in SHARD.split(", ")])

        for b in batches:
            for lo, hi, ids, bounds in own.runs(b.column(1)):
                size = np.diff(bounds) + 1
                edges = np.cumsum(size)
                every = np.full(int(edges[-1]), end_id, "<u2")  # each document's ids, then the end id
                every[np.arange(len(ids)) + np.repeat(np.arange(hi - lo), size - 1)] = ids
                done = 0
                while done < hi - lo:
                    # documents up to the one that fills the shard
                    start = int(edges[done] - size[done])
                    stop = min(int(np.searchsorted(edges, start + shard_ids - n)) + 1, hi - lo)
                    keys.append(b.column(0).slice(lo + done, stop - done))
                    held.append(every[start : int(edges[stop - 1])])
                    sizes.append(size[done:stop])
                    n, done = n + len(held[-1]), stop
                    if n >= shard_ids:
                        yield shard()
                        keys, held, sizes, n, number = [], [], [], 0, number + 1
        if keys:
            yield shard()

    ordered = documents(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, SHARD)


def write_files(docs: DataFrame, path: str, **how) -> None:
    """Write the file set; ``path`` must be a folder that all executors reach."""
    shards(docs, **how).write.option("compression", "zstd").parquet(path)


def read_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32; with ``ids`` its ids as 16-bit bytes."""
    rows = spark.read.schema(SHARD).parquet(path)
    sizes = rows.select("task", "shard", "n_ids")
    tasks = sizes.groupBy("task").agg(F.sum("n_ids").alias("n"))  # a row for each writing task
    to_task = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    in_task = Window.partitionBy("task").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.join(tasks.select("task", F.coalesce(F.sum("n").over(to_task), F.lit(0)).alias("base_start")), "task")
    first = first.select("task", "shard", (F.col("base_start") + F.coalesce(F.sum("n_ids").over(in_task), F.lit(0))).alias("first"))
    names = ["task", "shard", "doc_id", "within", "n_tokens", "ids_crc32", "ids"][: 7 if ids else 6]

    def decode(batches):
        for b in batches:
            for r in b.to_pylist():
                table = expansions(r["base"], np.frombuffer(r["rules"], "<u2").reshape(-1, 2), np.frombuffer(r["lengths"], "<u4"))
                got = expand(np.frombuffer(r["body"], "<u2"), table)
                size = np.frombuffer(r["doc_tokens"], "<i4").astype(np.int64)
                ends = np.cumsum(size)
                keys, null = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_null"], "u1").astype(bool)
                wide = got.astype("<u4")
                crc = [zlib.crc32(wide[e - n : e]) for e, n in zip(ends.tolist(), size.tolist())]
                cols = [pa.array(np.full(len(size), r["task"], np.int32)), pa.array(np.full(len(size), r["shard"], np.int32)), pa.array(keys, mask=null), pa.array(ends - size), pa.array(size), pa.array(crc, pa.int64())]
                if ids:
                    cols.append(pa.array([got[e - n : e].tobytes() for e, n in zip(ends.tolist(), size.tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names)

    got = rows.drop("n_ids", "doc_symbols").mapInArrow(decode, "task int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)
    return got.join(first, ["task", "shard"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def read_document(row, k: int) -> np.ndarray:
    """Random access: the ids of document k of one shard row; only its own symbols are expanded."""
    table = expansions(row["base"], np.frombuffer(row["rules"], "<u2").reshape(-1, 2), np.frombuffer(row["lengths"], "<u4"))
    symbols = np.frombuffer(row["doc_symbols"], "<i4").astype(np.int64)
    at = int(symbols[:k].sum())
    return expand(np.frombuffer(row["body"], "<u2")[at : at + int(symbols[k])], table)
