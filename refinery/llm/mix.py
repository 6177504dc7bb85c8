"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, repeated up to
``most_epochs`` times. A copy's virtual finish time is the number of source
tokens up to its end divided by the source's target. All copies, ordered by
that time, are taken until the next one would exceed the total budget.

The cumulative sums are taken in two levels (per range of the shuffle key,
then inside a range), so a source that holds a third of all rows is spread
over as many tasks as there are ranges. The global order is cut by nested
histograms of the virtual time: each round sums sizes per cell and descends
into the cell where the budget ends, until that cell is small.

Defined results: a null text has size 0; a null source is a source of its own
and comes last; documents of size 0 are taken 0 words; an empty table gives an
empty result; columns other than doc_id, text and source are ignored; equal
rows are interchangeable, so their order does not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_rows, checkpoint, prefix_for

#: Most sources; their weights are ranks in one global order.
MOST_SOURCES = 1_000_000
#: Most sources whose plan is sent to every task; more are joined.
MOST_SENT = 50_000
CELLS = 4096
#: Copies in the last cell that the driver puts in order itself.
MOST_LAST = 20_000


def targets(sizes: list[tuple[str | None, int]], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the sum of sizes by weight; none above ``most`` times its size, the excess reshared."""
    total = float(sum(s for _, s in sizes))
    caps = [most * s for _, s in sizes]
    order = sorted(range(len(sizes)), key=lambda i: (caps[i] / weights[i], i))
    left, weight = total, float(sum(weights))
    out = [0.0] * len(sizes)
    for k, i in enumerate(order):
        level = left / weight if weight > 0 else 0.0
        if caps[i] / weights[i] > level:
            for j in order[k:]:
                out[j] = weights[j] * level
            break
        out[i] = caps[i]
        left -= caps[i]
        weight -= weights[i]
    return [round(x, 6) for x in out]


def weights_123(sources: list[str | None]) -> list[float]:
    return [float(1 + i % 3) for i in range(len(sources))]


def shuffle_key(seed: str, doc_id: str = "doc_id") -> F.Column:
    """60 bits of an MD5 of the id: a fixed random order that SQL engines agree on."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def keyed(docs: DataFrame, seed: str, prefix: str = "_") -> DataFrame:
    """Adds size in words and h, the place in the shuffled order."""
    return docs.withColumns({f"{prefix}size": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), f"{prefix}h": shuffle_key(seed)})


class Queues:
    """The sources' queues, and where the budget cuts them.

    ``queued`` has doc_id, size, source, rank, h and upto (tokens of the source up to the row's end) of every row;
    ``plan`` has rank, source, source_size and target of every source.
    """

    def __init__(self, docs: DataFrame, weights=weights_123, most_epochs: int = 3, seed: str = "mix-"):
        spark = docs.sparkSession
        self.most_epochs = most_epochs
        rows = checkpoint(keyed(docs.select("doc_id", "source", "text"), seed).select("doc_id", F.col("source").alias("own"), F.col("_size").alias("size"), F.col("_h").alias("h")))
        per_source = rows.groupBy(F.col("own").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
        found = bounded_rows(per_source, MOST_SOURCES, "sources")
        found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-32-be", "surrogatepass")))
        sizes = [(r.source, r.source_size) for r in found]
        wanted = targets(sizes, weights([s for s, _ in sizes]), float(most_epochs))
        total, n = sum(s for _, s in sizes), sum(r.n for r in found)
        plan = spark.createDataFrame(
            [(i, s, z, t) for i, ((s, z), t) in enumerate(zip(sizes, wanted, strict=True))],
            "rank int, source string, source_size long, target double",
        )
        self.plan = plan if len(sizes) > MOST_SENT else F.broadcast(plan)
        # ranges of the shuffle key: some 4000 rows of the whole table each, so a hot source's range stays small
        bits = min(20, max(8, (n // 4000).bit_length()))
        ranged = rows.join(self.plan, rows.own.eqNullSafe(self.plan.source)).withColumn("range", F.shiftright("h", 60 - bits).cast("int"))
        sums = ranged.groupBy("rank", "range").agg(F.sum("size").alias("part"))
        before = Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("rank", "range", F.coalesce(F.sum("part").over(before), F.lit(0)).alias("base"))
        inside = Window.partitionBy("rank", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        self.queued = checkpoint(
            ranged.join(sums, ["rank", "range"])
            .withColumn("upto", F.col("base") + F.sum("size").over(inside))
            .select("doc_id", "size", F.col("own").alias("source"), "source_size", "target", "rank", "h", "upto")
        )
        live = self.queued.filter((F.col("size") > 0) & (F.col("target") > 0))
        ends = F.explode(F.array(*(F.struct(self._finish(e).alias("finish")) for e in range(most_epochs))))
        copies = live.select("size", "rank", "upto", ends.alias("copy")).select("size", "rank", "upto", "copy.finish")
        high = max((most_epochs * z / t for (_, z), t in zip(sizes, wanted, strict=True) if t > 0), default=1.0)
        self.last = _cut(copies, total, high)

    def _finish(self, epoch: int) -> F.Column:
        """Virtual finish time of a copy: tokens of the source up to its end, over the target."""
        return (F.lit(epoch).cast("long") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")

    def takes(self, epoch: int) -> F.Column:
        """Whether the budget reaches a row's copy."""
        if self.last is None:
            return F.lit(False)
        mark = F.struct(F.lit(self.last[0]).cast("double"), F.lit(self.last[1]).cast("int"), F.lit(self.last[2]).cast("long"))
        return (F.col("size") > 0) & (F.col("target") > 0) & (F.struct(self._finish(epoch), F.col("rank"), F.col("upto")) <= mark)


def mix(docs: DataFrame, weights=weights_123, most_epochs: int = 3, seed: str = "mix-") -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every row of ``docs``."""
    q = Queues(docs, weights, most_epochs, seed)
    taken = sum((F.when(q.takes(e), F.col("size")).otherwise(F.lit(0)) for e in range(most_epochs)), F.lit(0))
    return q.queued.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def take(docs: DataFrame, weights=weights_123, most_epochs: int = 3, seed: str = "mix-") -> DataFrame:
    """``docs`` with every row as often as the mix takes it; all columns stay.

    What is taken of a source in one pass is a beginning of its shuffled order, so each source has one last
    key for each pass, and rows are compared with those: texts are not shuffled. Rows with equal keys
    (equal id and size) are taken together.
    """
    q = Queues(docs, weights, most_epochs, seed)
    p = prefix_for(docs.columns)
    key = lambda h, size: F.struct(F.col(h).alias("h"), F.col("doc_id").alias("doc_id"), F.col(size).alias("size"))
    lasts = q.queued.groupBy("rank").agg(*(F.max(F.when(q.takes(e), key("h", "size"))).alias(f"last{e}") for e in range(most_epochs)))
    marks = checkpoint(lasts.join(q.plan, "rank").select(F.col("source").alias(f"{p}source"), *(F.col(f"last{e}").alias(f"{p}last{e}") for e in range(most_epochs))))
    if marks.limit(MOST_SENT + 1).count() <= MOST_SENT:
        marks = F.broadcast(marks)
    rows = keyed(docs, seed, p).join(marks, F.col("source").eqNullSafe(F.col(f"{p}source")))
    copies = sum((F.when((F.col(f"{p}size") > 0) & (key(f"{p}h", f"{p}size") <= F.col(f"{p}last{e}")), 1).otherwise(0) for e in range(most_epochs)), F.lit(0))
    return rows.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.lit(most_epochs)))).filter(F.col(f"{p}copy") <= copies).select(*(F.col(f"`{c}`") for c in docs.columns))


def _cut(copies: DataFrame, budget: int, high: float) -> tuple[float, int, int] | None:
    """(finish, rank, upto) of the last copy that fits the budget, in order of those three; None if none fits.

    ``high`` bounds the finish times. Each round counts one cell row per cell, never rows of the table.
    """
    low, width, taken, here = 0.0, high / CELLS, 0, copies
    while True:
        cell = F.greatest(F.lit(0), F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(CELLS - 1))).cast("int")
        cells = here.groupBy(cell.alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
        chosen = None
        for r in sorted(cells, key=lambda r: r.cell):
            if taken + r.size > budget:
                chosen = r
                break
            taken += r.size
        if chosen is None:  # all of it fits
            top = here.agg(F.max(F.struct("finish", "rank", "upto")).alias("top")).first().top
            return None if top is None else tuple(top)
        here = here.filter(cell == chosen.cell)
        if chosen.n <= MOST_LAST:
            break
        low, width = low + chosen.cell * width, width / CELLS
    rest = sorted((r.finish, r["rank"], r.upto, r.size) for r in here.select("finish", "rank", "upto", "size").collect())
    best = None
    for *key, size in rest:
        if taken + size > budget:
            break
        taken, best = taken + size, tuple(key)
    if best is not None:
        return best
    first = F.struct(F.lit(rest[0][0]), F.lit(rest[0][1]), F.lit(rest[0][2]).cast("long"))
    top = copies.filter(F.struct("finish", "rank", "upto") < first).agg(F.max(F.struct("finish", "rank", "upto")).alias("top")).first().top
    return None if top is None else tuple(top)
