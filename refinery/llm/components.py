"""Connected components of a large sparse graph, by randomised contraction.

In each round every node takes the name of the neighbour, or of itself, that
is first in a random order drawn for the round; edges take the new names, and
those that have become loops or repetitions go. Connected nodes stay
connected, and a constant share of names disappears each time, on chains and
stars alike, so rounds grow with the logarithm of the graph and all rounds
together handle few more rows than the first. The names of the rounds are
composed backwards at the end. The joins are on narrow rows (Spark splits a
hot node's rows), the minima combine before the shuffle, and each round ends
in a reliable checkpoint, so a lost executor costs one round at most. Once so
few edges are left that their size is nothing, the driver joins them, which
spares it the plans and tasks of further rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Edges that come to the driver, 16 bytes each; more are contracted first.
FEW = 1 << 17


class Union:
    """Union-find over positions; numpy where it is cheap, a loop over the few links."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def _joined(edges: DataFrame) -> DataFrame:
    """node, label of few edges: the smallest node of each component is its label."""
    t = edges.toArrow()
    names, spot = np.unique(np.stack([t.column(k).to_numpy() for k in (0, 1)]), return_inverse=True)
    found = Union(len(names))
    for i, j in zip(*spot.reshape(2, -1).tolist(), strict=True):
        found.join(i, j)
    label = names[[found.find(i) for i in range(len(names))]]
    return checkpoint(edges.sparkSession.createDataFrame(pa.table({"node": names, "label": label})))


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of ``edges`` (a, b: long): nodes have one label if and only if they are connected."""
    edges = checkpoint(_tidy(edges))
    rounds: list[DataFrame] = []
    while (n := edges.count()) > FEW:
        order = lambda c, k=len(rounds): F.struct(F.xxhash64(c, F.lit(k)).alias("at"), F.col(c).alias("node"))
        both = edges.select("a", order("b").alias("near")).unionByName(edges.select(F.col("b").alias("a"), order("a").alias("near")))
        first = both.groupBy("a").agg(F.min("near").alias("near"))
        names = checkpoint(first.select(F.col("a").alias("node"), F.least("near", order("a"))["node"].alias("label")))
        rounds.append(names)
        left = edges.join(names, F.col("a") == F.col("node")).select(F.col("label").alias("a"), "b")
        right = left.join(names, F.col("b") == F.col("node")).select("a", F.col("label").alias("b"))
        edges = checkpoint(_tidy(right))
    if not n and not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = _joined(edges) if n else rounds.pop()
    if not rounds:
        return labels
    while rounds:
        later = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = rounds.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return checkpoint(labels)


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
