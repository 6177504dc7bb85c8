"""Exact top-k inner products with a vector-approximation file.

Components are integers, floor(256 x). The approximation file keeps one byte
for each component, the cell of values that it is in; it is written once, to
the shared folder. Queries scan the file, not the vectors: the cells bound
every score from both sides, and a vector whose upper bound is below the k-th
best lower bound of its query is out. Exact vectors are then read by id, in
order of their bounds: the best few of each query first, then those of the
rest that could still beat the k-th result found, which makes it certain.

Rows are scanned where they lie, against blocks of queries that are sent to
all tasks. A block holds about ``MOST_QUERY_CELLS`` components; more queries
are further blocks, scanned one after the other, so what is sent does not
grow with the data. Of equal vectors a task passes on 2 k rows a query at
most, those with the smallest ids: more can't be in a result, so a vector that
a third of all rows share makes no more candidates than any other.

Defined results: vectors that are null or hold null or non-finite components
take no part, as query or candidate; only vectors of equal length have a
product; all rows with the query's own vec_id are its own; candidate rows that
repeat count each time; a query row that repeats counts once, and an id with
several vectors is a query for each of them; fewer candidates than k give
fewer rows; scores are exact while they fit 64 bits, and beyond that stop at
the ends of that range; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_rows, checkpoint

#: Cells per component: one byte.
CELLS = 256
MOST_QUERY_CELLS = 2_000_000
#: Different lengths of vectors.
MOST_LENGTHS = 10_000
#: Vectors, and queries, whose bounds are in memory at a time.
ROWS, QUERIES = 4096, 256
#: Candidates that a task holds before it looks for those that are out by now.
MOST_HELD = 1 << 20
#: Exact vectors that are read first, for each result of a query.
FIRST = 4
#: Largest sums that doubles hold exactly.
EXACT = 2**53

CANDIDATE = "query_id long, query_vector long, vec_id long, vector long, low double, high double"
QUERY = ["query_id", "query_vector"]


def usable(df: DataFrame) -> DataFrame:
    """vec_id, embedding and vector (a hash of it) of the rows whose vector can take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    some = df.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(F.forall("embedding", fine))
    some = some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return some.withColumn("vector", F.xxhash64("embedding"))


def integers(vectors: pa.Array, length: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(256.0 * flat).reshape(len(vectors), length)


class Grid:
    """The cells of vectors of one length, all of one width, and the bounds that they give."""

    def __init__(self, low: float, high: float):
        self.low = low
        self.width = max(1.0, np.ceil((high - low + 1) / CELLS))

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.low) / self.width), 0, CELLS - 1).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of each query with each vector of cells."""
        floor = cells * self.width + self.low
        plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
        base = queries @ floor.T
        reach = self.width - 1
        slack = 1e-9 * (1 + np.abs(queries).sum(axis=1) * max(abs(self.low), abs(self.low + self.width * CELLS)))  # rounding
        return base + (reach * minus.sum(axis=1) - slack)[:, None], base + (reach * plus.sum(axis=1) + slack)[:, None]


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with some vectors."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, len(q))
    if most < EXACT:
        return (x @ q).astype(np.int64)
    ends = np.iinfo(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for v in x]
    return np.array([min(max(s, ends.min), ends.max) for s in exact], np.int64)


def smallest_ids(groups: tuple[np.ndarray, ...], ids: np.ndarray, k: int) -> np.ndarray:
    """Rows of each group that can be in a result of k: k rows of an id, and 2 k rows, by smallest id.

    Whichever id is a query's own, k others are left, or all there are.
    """
    order = np.lexsort((ids, *groups))
    same = np.ones(len(ids), bool)
    for g in groups:
        same[1:] &= g[order[1:]] == g[order[:-1]]

    def rank(begin: np.ndarray) -> np.ndarray:
        at = np.arange(len(begin))
        return at - np.maximum.accumulate(np.where(begin, at, 0))

    begin = ~same
    begin[:1] = True
    other = begin.copy()
    other[1:] |= ids[order[1:]] != ids[order[:-1]]
    few = rank(other) < k  # k copies of one id
    order, begin = order[few], begin[few]
    return order[rank(begin) < 2 * k]


class Scan:
    """What one task has found for a block of queries of one length."""

    def __init__(self, grid: Grid, q: np.ndarray, q_ids: np.ndarray, k: int):
        self.grid, self.q, self.q_ids, self.k = grid, q, q_ids, k
        self.best = np.full((len(q), k), -np.inf)  # the k best lower bounds so far
        self.held: list[tuple[np.ndarray, ...]] = []  # query, vec_id, vector, low, high
        self.limit = MOST_HELD

    def add(self, cells: np.ndarray, ids: np.ndarray, vector: np.ndarray) -> None:
        keep = smallest_ids((vector,), ids, self.k)
        cells, ids, vector = cells[keep], ids[keep], vector[keep]
        for at in range(0, len(self.q), QUERIES):
            low, high = self.grid.bounds(cells, self.q[at : at + QUERIES])
            own = self.q_ids[at : at + QUERIES, None] == ids[None, :]
            low[own] = high[own] = -np.inf
            best = np.concatenate([self.best[at : at + QUERIES], low], axis=1)
            best = self.best[at : at + QUERIES] = -np.partition(-best, self.k - 1, axis=1)[:, : self.k]
            query, row = np.nonzero((high >= best.min(axis=1)[:, None]) & (high > -np.inf))
            self.held.append((query + at, ids[row], vector[row], low[query, row], high[query, row]))
        if sum(len(x[0]) for x in self.held) > self.limit:
            self.prune()
            self.limit = max(MOST_HELD, 2 * len(self.held[0][0]))

    def prune(self) -> None:
        query, ids, vector, low, high = (np.concatenate(x) for x in zip(*self.held, strict=True))
        near = high >= self.best.min(axis=1)[query]
        query, ids, vector, low, high = (x[near] for x in (query, ids, vector, low, high))
        keep = smallest_ids((vector, query), ids, self.k)
        self.held = [(query[keep], ids[keep], vector[keep], low[keep], high[keep])]


def approximate(good: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """The approximation file: vec_id, vector, length and cells of every row, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            for length in np.unique(sizes).tolist():
                rows = b.filter(pa.array(sizes == length))
                cells = grids[length].of(integers(rows.column(1), length))
                packed = pa.array([c.tobytes() for c in cells], pa.binary())
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([length] * rows.num_rows, pa.int32()), packed], ["vec_id", "vector", "length", "cells"])

    return checkpoint(good.select("vec_id", "embedding", "vector").mapInArrow(run, "vec_id long, vector long, length int, cells binary"))


def candidates(file: DataFrame, queries: pa.Table, grids: dict[int, Grid], k: int) -> DataFrame:
    """Rows of the file that the bounds leave to a block of queries (vec_id, embedding, vector), in each task."""
    asked: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    vectors = queries.column("embedding").combine_chunks()
    ids, names = queries.column("vec_id").to_numpy(), queries.column("vector").to_numpy()
    _, first = np.unique(np.stack([ids, names]), axis=1, return_index=True)
    sizes = np.diff(vectors.offsets.to_numpy())
    for length in np.unique(sizes).tolist():
        some = first[sizes[first] == length]
        asked[length] = integers(vectors.take(pa.array(some)), length), ids[some], names[some]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans = {n: Scan(grids[n], q, i, k) for n, (q, i, _) in asked.items()}
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                sizes = part.column(2).to_numpy()
                for length in np.unique(sizes).tolist():
                    if length in scans:
                        rows = part.filter(pa.array(sizes == length))
                        cells = np.frombuffer(b"".join(rows.column(3).to_pylist()), np.uint8).reshape(rows.num_rows, length)
                        scans[length].add(cells, rows.column(0).to_numpy(), rows.column(1).to_numpy())
        for length, scan in scans.items():
            if scan.held:
                scan.prune()
                query, ids, vector, low, high = scan.held[0]
                _, q_ids, q_names = asked[length]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[query], q_names[query], ids, vector, low, high)], [c.split()[0] for c in CANDIDATE.split(", ")])

    return file.mapInArrow(run, CANDIDATE)


def exact_scores(chosen: DataFrame, good: DataFrame) -> DataFrame:
    """query_id, query_vector, vec_id, score of candidates, whose exact vectors are read now."""
    wanted = chosen.select("vec_id", "vector").union(chosen.select(*QUERY)).distinct()
    read = checkpoint(good.join(wanted, ["vec_id", "vector"], "left_semi").dropDuplicates(["vec_id", "vector"]))
    asked = read.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("embedding").alias("q"))
    pairs = chosen.join(read, ["vec_id", "vector"]).join(asked, QUERY).select(*QUERY, "vec_id", "q", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column(3).to_numpy(zero_copy_only=False), b.column(4).to_numpy(zero_copy_only=False), strict=True)
            found = [scores(np.floor(256.0 * q), np.floor(256.0 * x)[None, :])[0] for q, x in both]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.int64())], [*QUERY, "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, query_vector long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: F.Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that ``is_query`` marks."""
    spark = vectors.sparkSession
    good = usable(vectors)
    stats = good.groupBy(F.size("embedding").alias("length")).agg(F.min(F.array_min("embedding")).alias("low"), F.max(F.array_max("embedding")).alias("high"), F.count_if(is_query).alias("queries"))
    stats = bounded_rows(stats, MOST_LENGTHS, "lengths of vectors")
    grids = {r.length: Grid(float(np.floor(256.0 * (r.low or 0.0))), float(np.floor(256.0 * (r.high or 0.0)))) for r in stats}
    blocks = -(-sum(max(1, r.length) * r.queries for r in stats) // MOST_QUERY_CELLS)
    file = approximate(good, grids)
    asked = good.filter(is_query)
    found = [spark.createDataFrame([], CANDIDATE)]
    for i in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == i).toArrow()
        if len(some):
            found.append(candidates(file, some, grids, k))
    near = checkpoint(reduce(DataFrame.unionByName, found[1:] or found))
    by = Window.partitionBy(*QUERY)
    lows = near.withColumn("n", F.row_number().over(by.orderBy(F.desc("low")))).filter(F.col("n") == k).select(*QUERY, F.col("low").alias("least"))
    near = near.join(lows, QUERY, "left").filter(F.col("least").isNull() | (F.col("high") >= F.col("least")))
    near = checkpoint(near.withColumn("n", F.row_number().over(by.orderBy(F.desc("high"), F.desc("low"), "vec_id"))))
    best = checkpoint(exact_scores(near.filter(F.col("n") <= FIRST * k), good))
    kth = best.withColumn("n", F.row_number().over(by.orderBy(F.desc("score")))).filter(F.col("n") == k).select(*QUERY, F.col("score").alias("sure"))
    # where the k-th result is not certain yet, all that could still beat it are read
    open_ones = checkpoint(near.filter(F.col("n") > FIRST * k).join(kth, QUERY, "left").filter(F.col("sure").isNull() | (F.col("high") >= F.col("sure"))).select(*near.columns[:6]))
    if open_ones.limit(1).count():
        best = best.unionByName(exact_scores(open_ones, good))
    order = by.orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
