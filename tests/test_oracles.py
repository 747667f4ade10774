"""Every query with SQL gives the rows of its SQL, at the smallest scale."""

import math
from collections import Counter

import duckdb
import pytest

from lodestone.plans.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == Counter(repr(tuple(norm(r[i]) for i in at)) for r in want.fetchall())
