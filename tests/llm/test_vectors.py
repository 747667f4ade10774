"""Vector code compression and whitening against brute force, on small tables with nulls, ties, repeats, mixed lengths and clashing columns."""

import hashlib
import math
import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from lodestone.llm import codes, queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, `row` string, x string, pos int"


def vectors(n=260, dims=32, seed=5):
    draw = random.Random(seed)
    hot = [draw.uniform(-1, 1) for _ in range(4)]
    rows = []
    for k in range(n):
        v = [draw.gauss(0, 0.3) * (1 + j % 5) for j in range(dims)]
        if k % 3 == 0:
            v[8:12] = hot  # a part that a third of all share
        if k % 17 == 0:
            v = [0.0] * dims
        rows.append((k * 7 % n, v, k % 4 if k % 9 else None, "clash", "clash", k))
    rows += [rows[3], (rows[4][0], rows[5][1], 1, None, None, None), (None, rows[8][1], 2, None, None, None)]
    broken = [None, [None] * dims, [float("nan")] + [0.1] * (dims - 1), [float("inf")] + [0.1] * (dims - 1)]
    return rows + [(1000 + k, v, 0, None, None, None) for k, v in enumerate(broken)]


def kept(rows):
    return [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]


def f32(c):
    return float(np.float32(c))


def brute_codes(rows, parts=16, entries=64, rounds=2):
    rows = kept(rows)
    width = max(1, math.ceil(max(len(r[1]) for r in rows) / parts))
    whole = [[math.floor(256 * f32(c)) for c in r[1]] + [0] * (width * parts - len(r[1])) for r in rows]
    cut = [[tuple(x[p * width : (p + 1) * width]) for p in range(parts)] for x in whole]
    first = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole[k]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda part, book: min(range(len(book)), key=lambda e: (dist(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[near(c[p], books[p])].append(c[p])
            books[p] = [tuple(sum(z) // len(own[e]) for z in zip(*own[e])) if e in own else old for e, old in enumerate(books[p])]
    out, totals = [], defaultdict(int)
    for r, c in zip(rows, cut):
        code = [near(c[p], books[p]) for p in range(parts)]
        error = sum(dist(c[p], books[p][e]) for p, e in enumerate(code))
        totals[r[2]] += error
        out.append((r[0], r[2], "".join(f"{e:02x}" for e in code), error))
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    return sorted((i, code, error, totals[label], sha) for i, label, code, error in out if i is not None), sorted((code, error, totals[label]) for i, label, code, error in out if i is None)


def same_codes(spark, rows, **how):
    got = codes.compressed(spark.createDataFrame(rows, SCHEMA).repartition(5), **how).collect()
    with_id = sorted((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got if r.vec_id is not None)
    assert (with_id, sorted((r.code, r.error, r.label_error) for r in got if r.vec_id is None)) == brute_codes(rows, **how)


def test_codes_match_brute_force(spark):
    same_codes(spark, vectors())


def test_codes_of_few_and_equal_vectors(spark):
    same_codes(spark, vectors()[:7])
    same_codes(spark, [(k, [0.5] * 32, None, None, None, None) for k in range(90)])


def test_codes_of_mixed_and_odd_lengths(spark):
    rows = vectors(80) + [(2000 + k, [0.25 * k] * k, 3, None, None, None) for k in range(6)] + [(3000, [0.1] * 35, 3, None, None, None)]
    same_codes(spark, rows)


def test_codes_are_exact_beyond_machine_integers(spark):
    rows = vectors(70) + [(5000 + k, [1e12 * (-1) ** j for j in range(32)], 1, None, None, None) for k in range(3)]
    same_codes(spark, rows)


def test_codes_with_other_parameters(spark):
    same_codes(spark, vectors(120), parts=8, entries=16, rounds=3)


def test_codes_of_an_empty_table(spark):
    assert codes.compressed(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compressed(spark.createDataFrame([(1, None, 1, None, None, None)], SCHEMA)).collect() == []


def test_codes_sql_is_the_same(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view embeddings as select * from '{d}/embeddings.parquet'")
    want = duckdb.sql(queries.ORACLE_SQL["op13_codes"])
    got = queries.op13_codes(spark, d).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def brute_white(rows, top=16):
    rows = kept(rows)
    dims = max(len(r[1]) for r in rows)
    x = [[math.floor(64 * f32(c)) + 1_000_000 for c in r[1]] + [1_000_000] * (dims - len(r[1])) for r in rows]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(top, int((e > 1e-12 * e[0]).sum()))
    out = []
    for r, own in zip(rows, x):
        c = [n * a - s for a, s in zip(own, sums)]
        white = np.array([a / n for a in c]) @ v[:, :k] / np.sqrt(e[:k])
        out.append((r[0], n, sum(a * a for a in c), white))
    return out, e[:k] / e.sum()


def same_white(spark, rows):
    got = defaultdict(dict)
    for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect():
        got[r.vec_id].setdefault(r.component, []).append(r)
    want, explained = brute_white(rows)
    assert sum(len(c[1]) for c in got.values()) == len(want)
    sign = {}
    for i, n, deviation, white in want:
        mine = got[i]
        assert sorted(mine) == list(range(1, len(white) + 1))
        for k, w in enumerate(white, 1):
            own = [r for r in mine[k] if r.deviation == deviation and r.n == n]
            assert own
            if abs(w) > 1e-3:
                sign.setdefault(k, math.copysign(1, w * own[0].whitened))
            assert any(abs(r.whitened - sign.get(k, 1) * w) < 1e-7 * max(1, abs(w)) for r in own) or abs(w) <= 1e-3
            assert all(math.isclose(r.explained, explained[k - 1], rel_tol=1e-9) and r.identity_error < 1e-8 for r in own)


def test_whitening_matches_brute_force(spark):
    same_white(spark, vectors())


def test_whitening_of_mixed_lengths_and_low_rank(spark):
    same_white(spark, vectors(60, dims=8) + [(900, [0.5, 1.0], 1, None, None, None), (901, [], 1, None, None, None)])
    line = [(k, [0.1 * k * j for j in range(1, 21)], 0, None, None, None) for k in range(9)]
    got = whitening.whitened(spark.createDataFrame(line, SCHEMA)).collect()
    assert {r.component for r in got} >= {1} and all(r.identity_error < 1e-4 for r in got) and abs(max(r.explained for r in got) - 1) < 1e-2


def test_whitening_of_nothing_and_of_one_vector(spark):
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whitened(spark.createDataFrame([(k, [0.5] * 4, 1, None, None, None) for k in range(3)], SCHEMA)).collect() == []


def test_whitening_gives_null_where_no_long_holds_the_deviation(spark):
    rows = vectors(40) + [(4000, [1e7] + [0.0] * 31, 0, None, None, None)]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r.deviation is None for r in got if r.vec_id == 4000) and any(r.deviation is not None for r in got)


@pytest.mark.parametrize("dims,rank,block,basis", [(120, 120, 8, 64), (200, 5, 16, 512), (64, 64, 16, 512), (90, 90, 4, 20), (3, 3, 16, 512)])
def test_lanczos_restarts_and_breakdowns(dims, rank, block, basis):
    draw = np.random.default_rng(dims)
    q, _ = np.linalg.qr(draw.standard_normal((dims, dims)))
    e = np.zeros(dims)
    e[:rank] = np.sort(draw.uniform(1, 9, rank))[::-1]
    if rank > 10:
        e[1] = e[2] = e[3]  # equal ones
    a = (q * e) @ q.T
    found, v = whitening.largest(lambda b: a @ b, dims, 16, block, basis, 1e-12)
    assert np.allclose(found, np.sort(e)[::-1][: len(found)], atol=1e-9)
    assert np.linalg.norm(a @ v - v * found, axis=0).max() < 1e-9 and np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-10)


def test_no_convergence_is_an_error():
    a = np.diag(np.linspace(1, 1.001, 300))
    with pytest.raises(RuntimeError):
        whitening.largest(lambda b: a @ b, 300, 16, 4, 40, 1e-14, passes=3)
