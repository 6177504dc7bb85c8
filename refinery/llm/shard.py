"""Sharding by Karmarkar-Karp differencing.

Equal texts form a group that stays in one shard; the law is ``bytes``: shard
sizes as near equal as whole groups allow. Groups go into buckets by hash.
Inside a bucket, differencing keeps a heap of partial partitions (k sums each)
and repeatedly combines the two with the largest spread, the largest sum of
one with the smallest of the other. The buckets' results are such partial
partitions themselves and are combined by the same rule: in tasks while there
are many, at last by the driver, which reads k numbers of each of
``MOST_PARTIALS`` at most. A group larger than an even share of what is left
gets a shard of its own first; there are fewer than k of those.

Slots are numbered in two levels: counts per (slice of ids, shard) give the
slice's first slot, row_number() gives the rest, so no task holds a shard.

Defined results: a null text has no bytes, checksum 0 and forms one group with
the other nulls; repeated rows get a slot each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

GROUPS_A_BUCKET = 20_000
#: Partial partitions that one task, or the driver, combines.
MOST_PARTIALS = 16_384
#: Rows for each slice of slot numbers, and the least number of slices.
ROWS_A_SLICE, LEAST_SLICES = 50_000, 512


def difference(sizes: list[int], k: int) -> tuple[list[int], list[int]]:
    """Bin of each size and the k bin sums, sums falling from bin 0 on."""
    tuples = [((s,) + (0,) * (k - 1)) for s in sizes]
    where, sums = difference_partials(tuples, k)
    return [w[0] for w in where], sums


def difference_partials(partials: list[tuple[int, ...]], k: int) -> tuple[list[list[int]], list[int]]:
    """Combines partial partitions of k sums each; returns where each one's bins went, and the sums."""
    if not partials:
        return [], [0] * k
    nodes: list[tuple | None] = []
    heap = []
    for i, p in enumerate(partials):
        order = sorted(range(k), key=lambda j: (-p[j], j))
        sums = [p[j] for j in order]
        nodes.append((order,))
        heap.append((sums[-1] - sums[0], i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [p + q for p, q in zip(x, reversed(y), strict=True)]
        order = sorted(range(k), key=both.__getitem__, reverse=True)
        sums = [both[j] for j in order]
        nodes.append((order, a, b))
        heapq.heappush(heap, (sums[-1] - sums[0], len(nodes) - 1, sums))
    out: list[list[int]] = [[] for _ in partials]
    # bin of each slot, from the root down: slot j of a node is slot order[j] of what was combined
    place: list[list[int] | None] = [None] * len(nodes)
    place[len(nodes) - 1] = list(range(k))
    for i in range(len(nodes) - 1, -1, -1):
        node, at = nodes[i], place[i]
        place[i] = None
        before = [0] * k
        for slot, was in enumerate(node[0]):
            before[was] = at[slot]
        if len(node) == 1:
            out[i] = before
        else:
            place[node[1]] = before
            place[node[2]] = before[::-1]
    return out, heap[0][2]


def _oversized(top: list, total: int, shards: int) -> list[bytes]:
    """Groups, largest first, that exceed an even share of what the larger ones leave."""
    alone = []
    for r in top:
        left = shards - len(alone)
        if left <= 1 or r.size * left <= total:
            break
        alone.append(r.gid)
        total -= r.size
    return alone


def shard_by_bytes(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = checkpoint(
        docs.select(
            F.col("doc_id").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.when(F.col("text").isNull(), F.lit(b"")).otherwise(F.unhex(F.md5(text))).alias("gid"),
        )
    )
    groups = checkpoint(rows.groupBy("gid").agg(F.sum("size").alias("size")))
    n, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    alone = [bytes(g) for g in _oversized(groups.orderBy(F.desc("size"), "gid").limit(shards).collect(), total, shards)]
    k = shards - len(alone)
    buckets = 1 + n // GROUPS_A_BUCKET
    rest = groups.filter(~F.col("gid").isin(alone)) if alone else groups

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "gid"], ascending=[False, True])
        bins, _ = difference(pdf["size"].tolist(), k)
        return pd.DataFrame({"gid": pdf["gid"], "size": pdf["size"], "bucket": key[0], "bin": bins})

    bucket = F.pmod(F.xxhash64("gid"), F.lit(buckets))
    binned = checkpoint(rest.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(combine, "gid binary, size long, bucket long, bin int"))
    by_bin = binned.groupBy("bucket", "bin").agg(F.sum("size").alias("size"))  # k numbers a bucket
    sums = by_bin.groupBy("bucket").agg(*(F.coalesce(F.max(F.when(F.col("bin") == j, F.col("size"))), F.lit(0)).alias(f"s{j}") for j in range(k)))
    places = _places(checkpoint(sums.select("bucket", F.array(*(f"s{j}" for j in range(k))).alias("sums"))), buckets, k)
    places = places.select("bucket", F.posexplode("place").alias("bin", "place"))
    placed = binned.join(places, ["bucket", "bin"]).select("gid", (F.col("place") + len(alone)).cast("int").alias("shard"))
    if alone:
        placed = placed.unionByName(spark.createDataFrame([(bytearray(g), i) for i, g in enumerate(alone)], "gid binary, shard int"))
    return _slots(rows.join(placed, "gid"))


def _places(sums: DataFrame, buckets: int, k: int) -> DataFrame:
    """bucket and place (the final bin of each of its bins) from each bucket's sums, combined level by level."""
    spark = sums.sparkSession
    if buckets <= MOST_PARTIALS:
        found = sorted((r.bucket, tuple(r.sums)) for r in sums.collect())
        where, _ = difference_partials([s for _, s in found], k)
        return spark.createDataFrame([(b, w) for (b, _), w in zip(found, where, strict=True)], "bucket long, place array<int>")

    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        where, total = difference_partials([tuple(map(int, s)) for s in pdf["sums"]], k)
        return pd.DataFrame({"up": key[0], "bucket": pdf["bucket"].tolist(), "inner": where, "total": [total] * len(pdf)})

    many = -(-buckets // MOST_PARTIALS)
    step = sums.withColumn("up", F.pmod("bucket", F.lit(many))).groupBy("up").applyInPandas(combine, "up long, bucket long, inner array<int>, total array<long>")
    step = checkpoint(step)
    above = checkpoint(step.groupBy(F.col("up").alias("bucket")).agg(F.first("total").alias("sums")))
    over = _places(above, many, k).select(F.col("bucket").alias("up"), F.col("place").alias("outer"))
    return step.join(over, "up").select("bucket", F.transform("inner", lambda j: F.col("outer")[j]).alias("place"))


def _slots(rows: DataFrame) -> DataFrame:
    """Adds slot, gapless from 0 in each shard."""
    slices = max(LEAST_SLICES, rows.count() // ROWS_A_SLICE)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "gid"), F.lit(slices)).cast("int"))
    rows = checkpoint(rows)
    counts = rows.groupBy("slice", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("slice", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("slice", "shard").orderBy("doc_id", "gid")
    return rows.join(starts, ["slice", "shard"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.row_number().over(order) - 1).cast("long").alias("slot")
    )
