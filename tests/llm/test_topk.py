import math
import random

import numpy as np
from pyspark.sql import functions as F

from refinery.llm import topk as T


def brute(rows, is_query, k=5):
    good = [(v, [math.floor(256 * x) for x in e]) for v, e in rows if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for q, a in {(v, tuple(e)): None for v, e in good}:  # a query row that repeats counts once
        if is_query(q):
            found = sorted((-sum(x * y for x, y in zip(a, b)), v) for v, b in good if v != q and len(a) == len(b))[:k]
            out += [(q, n + 1, v, -s) for n, (s, v) in enumerate(found)]
    return sorted(out)


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_embeddings_against_brute_force(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in df.collect()], lambda v: v % 50 == 0)
    assert rows_of(T.top_k(df, F.col("vec_id") % 50 == 0)) == want
    monkeypatch.setattr(T, "MOST_QUERY_CELLS", 200)  # several blocks of queries
    monkeypatch.setattr(T, "ROWS", 37)
    assert rows_of(T.top_k(df, F.col("vec_id") % 50 == 0)) == want


def test_ties_large_values_and_edges(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1e-4]) for _ in range(3)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 2.0]), (1002, [1.0, float("nan"), 2.0]), (1003, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (2000, [1.0]), (2050, [2.0]), (3000, []), (3050, [])]
    df = spark.createDataFrame([(v, e, 1) for v, e in rows], "vec_id long, embedding array<double>, score int")
    assert rows_of(T.top_k(df, F.col("vec_id") % 50 == 0)) == brute(rows, lambda v: v % 50 == 0)
    assert T.top_k(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []
    big = [(i, [float(2**20 + i), -float(i)]) for i in range(0, 200, 10)]
    assert rows_of(T.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)) == brute(big, lambda v: v % 50 == 0)


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, q = np.floor(rng.normal(0, 400, (500, 16))), np.floor(rng.normal(0, 40, (20, 16)))
    cells = T.Grid(x.min(), x.max())
    low, high = cells.bounds(cells.of(x), q)
    exact = q @ x.T
    assert (low <= exact).all() and (exact <= high).all()


def test_repeated_rows_and_equal_vectors(spark, monkeypatch):
    """A vector that a third of all rows share, repeated query rows, an id with two vectors."""
    rng = random.Random(4)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    hot = vector()
    rows = [(i, hot if i % 3 == 0 else vector()) for i in range(400)]
    rows += rows[:120:10] * 3 + [(100, vector()), (50, hot), (50, hot), (7, hot)] + [(3, hot)] * 20
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, lambda v: v % 50 == 0)
    assert rows_of(T.top_k(df, F.col("vec_id") % 50 == 0)) == want
    monkeypatch.setattr(T, "MOST_HELD", 10)
    monkeypatch.setattr(T, "FIRST", 0)  # nothing is certain after the first reads
    monkeypatch.setattr(T, "ROWS", 19)
    assert rows_of(T.top_k(df, F.col("vec_id") % 50 == 0)) == want


def test_few_exact_vectors_are_read(spark, monkeypatch):
    """The bounds leave a small part of the file."""
    seen = []
    real = T.exact_scores
    monkeypatch.setattr(T, "exact_scores", lambda c, g: seen.append(c.count()) or real(c, g))
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    n = T.top_k(df, F.col("vec_id") % 50 == 0).count()
    assert n <= sum(seen) < 0.05 * df.count() * n / 5
