"""Exact quantiles, also of columns too large for one aggregation buffer."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint
from .columns import named

#: Rows up to which ``percentile`` is used: it keeps every distinct value in one buffer.
ONE_BUFFER = 5_000_000
CELLS = 4096
#: Values that may come to the driver once a rank has been narrowed down.
LAST = 20_000
#: Ranks of a column up to which histograms find them; more are read off the sorted column.
FEW_RANKS = 32


def quantiles(df: DataFrame, column: str, probs: Sequence[float], rows: int | None = None, one_buffer: int | None = None) -> list[float] | None:
    """Linearly interpolated quantiles of the non-null values of one column; None if there are none."""
    return quantiles_of(df, {column: probs}, {column: rows} if rows is not None else {}, one_buffer)[column]


def quantiles_of(df: DataFrame, wanted: Mapping[str, Sequence[float]], rows: Mapping[str, int] | None = None, one_buffer: int | None = None) -> dict[str, list[float] | None]:
    """Quantiles of several columns together.

    Columns of at most ``one_buffer`` values take one ``percentile`` each, all in one scan. For larger ones
    nested histograms narrow all ranks of all columns down at once: every round is one scan with a partial
    aggregation of at most ``CELLS`` cells a rank, and no task holds a column. A column of which many ranks are
    asked is sorted, by ranges, and the ranks are read off there.
    """
    limit = ONE_BUFFER if one_buffer is None else one_buffer
    names = list(wanted)
    if not names:
        return {}
    values = df.select(*(F.when(~F.isnan(named(c).cast("double")), named(c).cast("double")).alias(f"x{i}") for i, c in enumerate(names)))
    counts = dict(rows or {})
    if any(c not in counts for c in names):
        got = values.agg(*(F.count(f"x{i}").alias(str(i)) for i in range(len(names)))).first()
        counts = {c: got[str(i)] for i, c in enumerate(names)}
    out: dict[str, list[float] | None] = {c: None for c in names}
    small = [(i, c) for i, c in enumerate(names) if 0 < counts[c] <= limit]
    if small:
        probs = lambda c: F.array(*(F.lit(float(p)) for p in wanted[c]))
        found = values.agg(*(F.percentile(f"x{i}", probs(c)).alias(str(i)) for i, c in small)).first()
        out |= {c: found[str(i)] for i, c in small}
    ranks = {i: sorted({k for p in wanted[c] for k in _ranks(p, counts[c])}) for i, c in enumerate(names) if counts[c] > limit}
    few = {i: r for i, r in ranks.items() if len(r) <= FEW_RANKS}
    at = {i: _from_sorted(values.select(F.col(f"x{i}").alias("x")), r) for i, r in ranks.items() if i not in few}
    at |= _from_histograms(values, few, {i: counts[names[i]] for i in few}) if few else {}
    for i, found in at.items():
        out[names[i]] = [_between(found, p, counts[names[i]]) for p in wanted[names[i]]]
    return out


def _ranks(p: float, n: int) -> tuple[int, int]:
    return math.floor(p * (n - 1)), math.ceil(p * (n - 1))


def _between(found: dict[int, float], p: float, n: int) -> float:
    low, high = _ranks(p, n)
    a, b = found[low], found[high]
    return a + (b - a) * (p * (n - 1) - low) if a != b else a


def _from_sorted(values: DataFrame, ranks: list[int]) -> dict[int, float]:
    """Values at many ranks: the column is dealt by ranges of equal values' counts, and each range knows where it begins."""
    counted = values.filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranged = checkpoint(counted.repartitionByRange("x").withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumn("upto", F.sum("n").over(inside))
    totals = sorted((r["part"], r.n) for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect())
    begin, rows = 0, []
    for part, n in totals:
        rows += [(part, r - begin, r) for r in ranks if begin <= r < begin + n]
        begin += n
    asked = values.sparkSession.createDataFrame(rows, "part int, place long, rank long")
    hit = (placed["part"] == asked["part"]) & (asked["place"] < placed["upto"]) & (asked["place"] >= placed["upto"] - placed["n"])
    return {r["rank"]: r.x for r in placed.join(F.broadcast(asked), hit).select("rank", "x").collect()}


def _from_histograms(values: DataFrame, ranks: dict[int, list[int]], counts: dict[int, int]) -> dict[int, dict[int, float]]:
    """Values at few ranks of each column; ranks in one range share its histogram."""
    edge = lambda f, i: f(F.when(F.abs(f"x{i}") < float("inf"), F.col(f"x{i}")))
    row = values.agg(*(e.alias(f"{k}{i}") for i in ranks for k, e in (("a", edge(F.min, i)), ("b", edge(F.max, i)), ("n", F.count_if(F.col(f"x{i}") == float("-inf"))), ("p", F.count_if(F.col(f"x{i}") == float("inf")))))).first()
    out: dict[int, dict[int, float]] = {i: {} for i in ranks}
    #: A range: column, least and greatest value, values before it, values in it, ranks in it.
    todo: list[tuple[int, float, float, int, int, list[int]]] = []
    for i, asked in ranks.items():
        low, high, below, above = (row[f"{k}{i}"] for k in "abnp")
        here = []
        for r in asked:
            if r < below:
                out[i][r] = float("-inf")
            elif r >= counts[i] - above:
                out[i][r] = float("inf")
            else:
                here.append(r)
        if here:
            todo.append((i, low, high, below, counts[i] - below - above, here))
    while True:
        for i, low, high, *_, asked in todo:
            if low == high:
                out[i] |= dict.fromkeys(asked, low)
        todo = [t for t in todo if t[1] < t[2]]
        wide = [t for t in todo if t[4] > LAST and (t[2] / 2 - t[1] / 2) / (CELLS / 2) > 0]
        if not wide:
            break
        todo = [t for t in todo if t not in wide] + _narrowed(values, wide)
    if todo:  # few values, or values as close as doubles can be
        found = _tagged(values, [(i, low, high, None) for i, low, high, *_ in todo]).groupBy("target", "x").agg(F.count(F.lit(1)).alias("n")).collect()
        for k, (i, _, _, before, _, asked) in enumerate(todo):
            upto, mine = before, sorted((r.x, r.n) for r in found if r.target == k)
            for x, n in mine:
                out[i] |= {r: x for r in asked if upto <= r < upto + n}
                upto += n
    return out


def _tagged(values: DataFrame, targets: list[tuple[int, float, float, Any]]) -> DataFrame:
    """target, x and cell of the values in each target's range."""
    made = []
    for k, (i, low, high, width) in enumerate(targets):
        x = F.col(f"x{i}")
        # halves: the range of two finite doubles may not be one
        cell = F.least(F.floor((x / 2 - F.lit(low / 2)) / F.lit(width)), F.lit(CELLS - 1)).cast("int") if width else F.lit(0)
        made.append(F.when((x >= F.lit(low)) & (x <= F.lit(high)), F.struct(F.lit(k).alias("target"), x.alias("x"), cell.alias("cell"))))
    return values.select(F.explode(F.filter(F.array(*made), lambda s: s.isNotNull())).alias("s")).select("s.*")


def _narrowed(values: DataFrame, wide: list[tuple[int, float, float, int, int, list[int]]]) -> list[tuple[int, float, float, int, int, list[int]]]:
    """The ranges after one more round: for each rank the cell that it falls in."""
    tagged = _tagged(values, [(i, low, high, (high / 2 - low / 2) / CELLS) for i, low, high, *_ in wide])
    cells = tagged.groupBy("target", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    out = []
    for k, (i, _, _, before, _, asked) in enumerate(wide):
        upto = before
        for r in sorted((r for r in cells if r.target == k), key=lambda r: r.cell):
            mine = [a for a in asked if upto <= a < upto + r.n]
            if mine:
                out.append((i, r.low, r.high, upto, r.n, mine))
            upto += r.n
    return out
