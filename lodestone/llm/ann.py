"""Approximate nearest neighbours by learned partitions (after Dong et al., 2020).

Fit, on a bounded sample (``sample`` vectors at most): the sample's neighbour graph is cut into balanced
parts by recursive spectral bisection (power iteration on the graph, split at the median); a small network
with one hidden layer learns each vector's part. Held-out sample vectors say how many of the most probable
parts a query must visit for ``recall`` of its true neighbours; that number is the index's ``probes``.
Where vectors have no structure, as many parts as that takes are visited.

Index and search cover every row: each vector goes to its most probable part; parts are cut into blocks
of at most about ``block`` rows, and queries likewise, so a task's work is bounded however full a part is;
each block pair is one matrix product in double precision, and only its best rows leave the task.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors of
different lengths have no inner product, so a query's candidates are those of its own length: the index is of the
sample's commonest length, and rows of each other length are one part of their own, every one of which a query
visits; a query with fewer candidates gets all; ties go to the smaller id; rows of one id are queries and candidates
each, a row is no candidate of itself only; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SAMPLE, PARTS, HIDDEN, RECALL, BLOCK = 8192, 16, 64, 0.97, 16_384


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of double) and row, which tells rows of one id apart, of the vectors that take part.

    ``vectors`` are read from files or otherwise come in the same partitions each time."""
    v = F.col(vector_col).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.monotonically_increasing_id().alias("row"))
    return rows.filter(good & F.col("vec_id").isNotNull())


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, steps: int = 30, seed: int = 3) -> np.ndarray:
    """A part for each node of a neighbour graph (rows of neighbours), all of equal size but for one node."""
    draw, out = np.random.default_rng(seed), np.zeros(len(graph), np.int64)
    stack = [(np.arange(len(graph)), 0, parts)]
    while stack:
        nodes, first, n = stack.pop()
        out[nodes] = first
        if n < 2 or len(nodes) < 2:
            continue
        place = np.full(len(graph), -1)
        place[nodes] = np.arange(len(nodes))
        to = place[graph[nodes]]
        inside = to >= 0
        src = np.repeat(np.arange(len(nodes)), inside.sum(1))
        dst = to[inside]
        degree = np.bincount(src, minlength=len(nodes)) + np.bincount(dst, minlength=len(nodes)) + 1.0
        f = draw.standard_normal(len(nodes))
        for _ in range(steps):
            # lazy random walk without its constant part: tends to the smoothest split
            f -= (f * degree).sum() / degree.sum()
            f = 0.5 * f + 0.5 * (np.bincount(src, f[dst], len(nodes)) + np.bincount(dst, f[src], len(nodes)) + f) / degree
            f /= np.abs(f).max() or 1.0
        order = np.argsort(f, kind="stable")
        left = n // 2
        cut = len(nodes) * left // n
        stack += [(nodes[order[:cut]], first, left), (nodes[order[cut:]], first + left, n - left)]
    return out


@dataclass
class Index:
    """The classifier's weights and how many parts a query visits."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int
    parts: int

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        h = np.maximum(((x - self.mean) * self.scale) @ self.w1 + self.b1, 0)
        return np.argsort(-(h @ self.w2 + self.b2), axis=1, kind="stable")


def train(x: np.ndarray, part: np.ndarray, parts: int, hidden: int = HIDDEN, epochs: int = 30, seed: int = 5) -> Index:
    draw = np.random.default_rng(seed)
    mean, scale = x.mean(0), 1 / (x.std(0) + 1e-9)
    w = [draw.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden), draw.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t, z = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0, (x - mean) * scale
    for _ in range(epochs):
        order = draw.permutation(len(z))
        for lo in range(0, len(z), 256):
            at = order[lo : lo + 256]
            h = np.maximum(z[at] @ w[0] + w[1], 0)
            o = h @ w[2] + w[3]
            p = np.exp(o - o.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(at)), part[at]] -= 1
            p /= len(at)
            back = (p @ w[2].T) * (h > 0)
            t += 1
            for k, g in enumerate((z[at].T @ back, back.sum(0), h.T @ p, p.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] -= 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Index(mean, scale, *w, parts, parts)


def fit(vectors: DataFrame, parts: int | None = None, sample: int = SAMPLE, recall: float = RECALL, k: int = 20) -> Index | None:
    """An index from at most ``sample`` of the usable vectors, chosen by a hash of their ids. None: no usable vector.

    Without ``parts`` their number grows with the square root of the vectors', as far as the sample bears (32 vectors a part).
    """
    n = vectors.count()
    parts = parts or max(PARTS, math.isqrt(n) // 8)
    at = F.xxhash64("vec_id", "row")
    # a share by hash comes first, twice as large as is wanted, so that few rows meet in the one task that cuts it
    share = vectors.filter(F.pmod(at, F.lit(1_000_003)) < F.lit(max(1, min(1_000_003, 2 * sample * 1_000_003 // max(1, n)) if n > 4 * sample else 1_000_003)))
    rows = share.withColumn("at", at).orderBy("at", "vec_id").limit(sample).select("v").toPandas()["v"]
    if not len(rows):
        return None
    lengths = Counter(map(len, rows))
    common = max(lengths, key=lambda k: (lengths[k], -k))
    x = np.array([r for r in rows if len(r) == common], np.float64)
    parts = max(1, min(parts, len(x) // 32))
    held = len(x) // 8
    graph = _neighbours(x, min(16, len(x) - 1)) if len(x) > 1 else np.zeros((1, 0), np.int64)
    index = train(x[held:], balanced_parts(graph, parts)[held:], parts) if parts > 1 else train(x, np.zeros(len(x), np.int64), 1, epochs=1)
    if parts > 1:
        home = index.ranked(x)[:, 0]
        order = index.ranked(x[:held])
        near = _neighbours(x, min(k, len(x) - 1))[:held]
        visited = np.argsort(order, axis=1)[np.arange(held)[:, None], home[near]] + 1  # the probes that reach each true neighbour
        share = [(visited <= p).mean() for p in range(1, parts + 1)]
        index.probes = next((p for p, s in enumerate(share, 1) if s >= recall), parts)
    return index


def search(vectors: DataFrame, queries: DataFrame, index: Index | None, k: int = 20, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, v, row) its ``k`` best candidates, other rows of its length in the parts it visits."""
    spark = vectors.sparkSession
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, shared = len(index.mean), spark.sparkContext.broadcast(index)  # fixed size
    columns = ["vec_id", "v", "row"]

    def route(visits: int):
        def of(batches):
            for b in batches:
                v = b.column(1)
                x = v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims) if len(v) else np.zeros((0, dims))
                best = shared.value.ranked(x)[:, :visits]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(best.astype(np.int32)), pa.list_(pa.int32()))], [*columns, "parts"])

        return of

    right = F.size("v") == dims
    schema = "vec_id long, v array<double>, row long, parts array<int>"
    # parts from 0 are the index's; rows of another length go to the part of that length, below 0
    own = lambda df: df.filter(~right).select(*columns, (-F.size("v")).alias("part"))
    homes = staged(vectors.select(*columns).filter(right).mapInArrow(route(1), schema).select(*columns, F.col("parts")[0].alias("part")).unionByName(own(vectors)), "index")
    asks = staged(queries.select(*columns).filter(right).mapInArrow(route(index.probes), schema).select(*columns, F.explode("parts").alias("part")).unionByName(own(queries)), "asks")
    # how many blocks each part's rows and queries need: as many rows as parts, and as lengths that queries have
    n = homes.groupBy("part").count().join(asks.groupBy("part").agg(F.count("*").alias("q")), "part")
    n = n.select("part", F.ceil(F.col("count") / block).cast("int").alias("rb"), F.ceil(F.col("q") / (block // 4)).cast("int").alias("qb"))
    rows = homes.join(n, "part").select("part", F.pmod(F.xxhash64("vec_id", "row"), F.col("rb")).alias("r"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qb") - F.lit(1).cast("long"))).alias("q"), *columns)
    asks = asks.join(n, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rb") - F.lit(1).cast("long"))).alias("r"), F.pmod(F.xxhash64("vec_id", "row", F.lit(1)), F.col("qb")).alias("q"), *columns)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            left = left.sort_values(["vec_id", "row"], kind="stable")
            ids, at_row, x = left["vec_id"].to_numpy(), left["row"].to_numpy(), np.array(left["v"].tolist(), np.float64)
            asked, own, q = right["vec_id"].to_numpy(), right["row"].to_numpy(), np.array(right["v"].tolist(), np.float64)
            size = np.abs(x).max() * x.shape[1]
            for lo in range(0, len(q), 256):
                s = q[lo : lo + 256] @ x.T
                s[own[lo : lo + 256, None] == at_row] = -np.inf
                top = min(k, len(ids))
                bar = -np.partition(-s, top - 1, axis=1)[:, top - 1]
                for j, y in enumerate(q[lo : lo + 256]):
                    # the product's last bits depend on the block's shape: what it can't tell from the bar is summed again in one order
                    at = np.flatnonzero((s[j] >= bar[j] - 1e-11 * size * np.abs(y).max()) & (s[j] > -np.inf))
                    score = (x[at] * y).sum(1)
                    at, score = (z[np.lexsort((at_row[at], ids[at], -score))[:k]] for z in (at, score))
                    found.append((np.full(len(at), asked[lo + j]), np.full(len(at), own[lo + j]), ids[at], at_row[at], score))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], [], [], []]
        return pd.DataFrame(dict(zip(("query_id", "query_row", "vec_id", "row", "score"), cols)))

    keys = ["part", "r", "q"]
    near = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(best, "query_id long, query_row long, vec_id long, row long, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
