from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelake.llm import neighbours as N
from pagelake.llm import queries


def product(a, b):
    out = 0.0
    for x, y in zip(a, b, strict=True):
        out += float(x) * float(y)
    return out


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, k=20, every=20):
    """(query, rank, id, score) of rows (id, vector): every pair."""
    rows = [r for r in rows if good(r[1])]
    out = []
    for n, (q, v) in enumerate(rows):
        if q is not None and q % every == 0:
            found = [(product(v, w), i) for m, (i, w) in enumerate(rows) if m != n and len(w) == len(v)]
            found.sort(key=lambda x: (x[0] != x[0], -x[0] if x[0] == x[0] else 0, x[1] is None, x[1] or 0))
            out += [(q, rank, i, score) for rank, (score, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect()), key=str)


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    df = queries.op13_block_neighbours(spark, sf)
    assert dict(df.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert shown(df) == brute(rows)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_many_cells(spark, kind):
    """Several groups of queries and candidates, lengths, scales and exact ties."""
    rng = np.random.default_rng(3)
    cast = np.float32 if kind == "float" else np.float64
    rows = []
    for i in range(900):
        dim = 7 if i % 9 else 33
        v = rng.normal(size=dim) * 10.0 ** rng.integers(-3, 4)
        v = np.round(v) if i % 4 == 0 else v
        rows.append((i, [float(x) for x in cast(v)]))
    rows += [(i, rows[i - 1000][1]) for i in range(1000, 1100)]  # copies: ties
    rows = [r for r in rows if good(r[1])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(5)
    assert shown(N.nearest(df, k=6, query_bytes=1500, candidate_bytes=9000)) == brute(rows, k=6)


def test_edges(spark):
    rows = [
        (0, [1.0, 2.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0]),
        (140, [3.0, -1.0]), (140, [3.0, -1.0]), (None, [3.0, -1.0]), (7, [3.0, -1.0]), (8, [5.0]), (160, [5.0, 1.0, 1.0]), (9, [-1e-300, 0.0]), (-20, [-4.0, 0.5]),
        (180, [1e200, 1e200]), (11, [1e200, -1e200]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit("x").alias("dim"), F.lit(1).alias("score"), F.struct(F.lit(1).alias("a b")).alias("query.id"))
    got = shown(N.nearest(df))
    assert str(got) == str(brute(rows))  # a NaN isn't equal to itself
    assert not [r for r in got if r[0] == 160]  # no other vector of that length
    assert sum(r[0] == 140 for r in got) == 2 * 8
    assert N.nearest(df.where("false")).count() == 0 and N.nearest(df.where("vec_id = 7")).count() == 0


def test_overflow(spark):
    rows = [(20 * i, [1e200 * (-1) ** i, 1e200, 1e200 * (i % 3 - 1)]) for i in range(30)]
    got = N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5)
    assert got.count() == 30 * 5


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (3, 64, 2500):
        q, c = (rng.normal(size=(50, dim)) * 10.0 ** rng.integers(-8, 8, size=(50, 1)) for _ in range(2))
        a, b = N.Codes(q), N.Codes(c)
        tile, off = N.bounds(a, slice(0, 50), b)
        assert (np.abs(q @ c.T - tile) <= off).all()


def test_tiles_prune(spark):
    """Few pairs are recomputed: the bounds do the work."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(4000, 64)).astype(np.float32)
    q = N.Codes(vectors[:200])
    found, seen = N.Nearest(q, np.arange(200), np.arange(200), 20), 0
    own = N.products

    def counted(*x):
        nonlocal seen
        seen += len(x[2])
        return own(*x)

    N.products = counted
    try:
        for start in range(0, 4000, 1000):
            found.meet(N.Codes(vectors[start : start + 1000]), np.arange(start, start + 1000), np.arange(start, start + 1000), np.zeros(1000, dtype=bool))
    finally:
        N.products = own
    assert seen < 0.02 * 200 * 4000 * 4


def test_dot_in_name(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "`a.id` long, `v.x` array<double>")
    assert shown(N.nearest(df, id_col="a.id", vector_col="v.x")) == [(0, 1, 1, 2.0)]
