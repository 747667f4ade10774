"""Vector code compression: product codes by a weighted Lloyd iteration over distinct parts.

A vector becomes integers floor(256 * component) and is cut into equal consecutive parts. Equal parts of a
position are one weighted row, so a part that a third of all vectors share is assigned once. Each round assigns
the distinct rows to the nearest entry of the position's codebook (bounded: ``entries`` of each position) and
replaces entries by floor(weighted sum / weight), summed exactly. At the end codes and errors go back to the
vectors by a join, in which frequent parts are broadcast (at most a thousand of each position) and the others
shuffled.

Defined results: vectors that are null or hold null or non-finite components go; an empty vector, and one shorter
than the longest or than a whole number of parts, counts as filled up with zeros; the first codebook takes the
smallest ids, null ids last, ties by the integer components; with fewer vectors than entries the codebook is as
small; ties of distance go to the lower index; repeated rows and ids each keep a row; integers beyond 2^55 either
way count as that bound, and an error that no long holds is null; null labels are one label; an empty table gives
no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, finite, floored, looked_up, staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256.0


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each row's nearest entry, the lower one of equals, and the squared distance; exact in the rows' integers."""
    at, far = np.empty(len(x), np.int64), np.empty(len(x), x.dtype)
    step = max(1, 2**20 // max(1, book.size))
    for lo in range(0, len(x), step):
        d = ((x[lo : lo + step, None, :] - book) ** 2).sum(-1)
        at[lo : lo + step] = d.argmin(1)
        far[lo : lo + step] = d[np.arange(len(d)), at[lo : lo + step]]
    return at, far


def _matrix(column, width: int, kind) -> np.ndarray:
    flat = column.flatten()
    x = flat.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
    return x.astype(kind).reshape(len(column), width) if len(column) else np.zeros((0, width), kind)


def _assigned(batches, books: np.ndarray, kind):
    """For each batch (pos, part, weight) its positions, integers, weights, codes and distances."""
    for b in batches:
        pos = b.column(0).to_numpy(zero_copy_only=False)
        x = _matrix(b.column(1), books.shape[2], kind)
        code, far = np.zeros(len(pos), np.int64), np.zeros(len(pos), kind)
        for p in np.unique(pos):
            own = pos == p
            code[own], far[own] = nearest(x[own], books[p])
        yield b, pos, x, b.column(2).to_numpy(zero_copy_only=False), code, far


def _sums(books: np.ndarray, kind):
    """Task: weights and weighted component sums of every entry that a row of the task is nearest to."""

    def of(batches):
        weight, total = np.zeros(books.shape[:2], kind), np.zeros(books.shape, kind)
        for _, pos, x, w, code, _ in _assigned(batches, books, kind):
            w = w.astype(kind)
            np.add.at(weight, (pos, code), w)
            np.add.at(total, (pos, code), x * w[:, None])
        p, e = np.nonzero(weight)
        both = np.concatenate([weight[p, e][:, None], total[p, e]], axis=1)
        p, e, c = (np.repeat(z, both.shape[1]) if k < 2 else np.tile(np.arange(both.shape[1]), len(p)) for k, z in enumerate((p, e, p)))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(c, pa.int32()), pa.array([str(v) for v in both.ravel().tolist()], pa.string())], ["pos", "entry", "place", "total"])

    return of


def _codes(books: np.ndarray, kind):
    """Task: the distinct rows with code and distance."""

    def of(batches):
        for b, _, _, _, code, far in _assigned(batches, books, kind):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code.astype(np.int32)), pa.array([str(v) for v in far.tolist()], pa.string())], ["pos", "part", "weight", "code", "far"])

    return of


def codebooks(distinct: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks (position, entry, component) after ``rounds`` of weighted Lloyd over distinct rows (pos, part, weight)."""
    books = first.copy()
    for _ in range(rounds):
        sums = distinct.mapInArrow(_sums(books, books.dtype), "pos int, entry int, place int, total string")
        found = sums.groupBy("pos", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # positions x entries x (width + 1) rows at most
        weight = {(r.pos, r.entry): int(r.total) for r in found if r.place == 0}
        for r in found:
            if r.place:
                books[r.pos, r.entry, r.place - 1] = int(r.total) // weight[r.pos, r.entry]
    return books


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE) -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every kept vector."""
    v = F.col(vector_col)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v")).filter(finite(F.col("v")))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", floored(F.col("v"), scale).alias("x")), "vectors")
    label = rows.schema["label"].dataType.simpleString()
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("longest"), F.max(F.greatest(F.array_max("x").cast("double"), -F.array_min("x").cast("double"))).alias("most")).first()
    if not size.n:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long, label_error long, codebooks_sha256 string")
    width = max(1, math.ceil(size.longest / parts))
    most = int(size.most or 0) + 1
    kind = np.int64 if (2 * most) ** 2 * width * parts < 2**62 and most * size.n < 2**62 else object  # machine integers where all sums fit them
    whole = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width * parts) - F.size("x")))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice(whole, p * width + 1, width))
    each = rows.select("row", "vec_id", "label", F.posexplode(cut).alias("pos", "part"))
    distinct = staged(each.groupBy("pos", "part").agg(F.count("*").alias("weight")), "distinct-parts")
    first = [r.x for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(whole.alias("x")).limit(entries).collect()]
    books = np.array(first, kind).reshape(len(first), parts, width).transpose(1, 0, 2)
    books = codebooks(distinct, np.ascontiguousarray(books), rounds)
    coded = distinct.mapInArrow(_codes(books, kind), "pos int, part array<long>, weight long, code int, far string")
    coded = staged(coded.withColumn("far", F.col("far").cast("decimal(38,0)")), "coded-parts")
    met = looked_up(each, coded, ("pos", "part"), "weight", size.n)
    hexed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda s: F.lower(F.lpad(F.hex(s["code"]), 2, "0"))), "")
    out = staged(met.groupBy("row", "vec_id", "label").agg(hexed.alias("code"), F.sum("far").alias("error")).drop("row"), "codes")
    dropped(rows, distinct, coded)
    labels = out.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("rows"))
    sha = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    whole_long = lambda c: F.col(c).cast("decimal(38,0)").try_cast("long").alias(c)
    return looked_up(out, labels, ("label",), "rows", size.n).select("vec_id", "label", "code", whole_long("error"), whole_long("label_error"), F.lit(sha).alias("codebooks_sha256"))
