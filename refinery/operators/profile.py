"""Profiling: what each column holds, in as few scans as its statistics allow."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.quantiles import quantiles_of
from ..plans.cards import Card, Kind, Stage, Thresholds
from .steps import ROW

#: Name parts that suggest an identifier.
ID_WORDS = {"id", "key", "code", "uuid", "guid", "index", "idx", "identifier", "no", "num"}

#: Texts of flags.
ALL_MISSING = "entirely missing"
ZERO_ONE = "0/1 encoded — may be boolean"
HIDDEN = {Kind.NUMERIC: "numeric stored as string", Kind.DATETIME: "datetime stored as string", Kind.BOOLEAN: "boolean stored as string"}
CONSTANT = "near-constant (1 unique value)"
IDENTIFIER, UNIQUE = "all-unique (possible identifier)", "all-unique values"
NEARLY_EMPTY = "nearly-empty (≥95% missing)"


@dataclass
class Numbers:
    mean: float | None
    median: float | None
    std: float
    min: float | None
    max: float | None
    q25: float | None
    q75: float | None


@dataclass
class Profile:
    name: str
    kind: Kind
    stored: str
    n_total: int
    n_missing: int
    n_unique: int
    samples: list[str] = field(default_factory=list)
    numbers: Numbers | None = None
    top_values: list[tuple[str, int]] | None = None
    flags: list[str] = field(default_factory=list)

    @property
    def missing_rate(self) -> float:
        return self.n_missing / self.n_total if self.n_total else 0.0

    @property
    def n_present(self) -> int:
        return self.n_total - self.n_missing

    def is_number(self) -> bool:
        return self.kind in (Kind.NUMERIC, Kind.INTEGER)

    def is_label(self) -> bool:
        return self.kind in (Kind.CATEGORICAL, Kind.STRING)

    def to_dict(self) -> dict[str, Any]:
        out = asdict(self)
        out |= {"detected_type": str(self.kind), "stored_dtype": self.stored, "missing_rate": self.missing_rate, "sample_values": self.samples}
        for k in ("kind", "stored", "samples"):
            out.pop(k)
        return out


def statistics(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """The aggregates of one scan, named by position; NaN must be null already."""
    out: dict[str, Column] = {}
    for i, name in enumerate(names):
        kind, c = df.schema[name].dataType, X.named(name)
        out[f"{i}_n"] = F.count(c)
        if X.is_numeric(kind):
            x = c.cast("double")
            out |= {f"{i}_mean": F.avg(x), f"{i}_std": F.coalesce(F.stddev_samp(x), F.lit(0.0)), f"{i}_min": F.min(x), f"{i}_max": F.max(x)}
            out[f"{i}_fraction"] = F.count_if((F.abs(x) < float("inf")) & ~X.whole(c))
        elif X.is_text(kind):
            number = X.to_number(c)
            out |= {f"{i}_number": F.count_if(number.isNotNull()), f"{i}_fraction": F.count_if(number.isNotNull() & ~X.whole(number))}
            out |= {f"{i}_date": F.count_if(c.rlike(X.DATE_LIKE)), f"{i}_bool": F.count_if(X.lowered(c).isin(X.TRUE_WORDS + X.FALSE_WORDS))}
    return out


def profile(df: DataFrame, t: Thresholds = Thresholds(), known: dict[str, Profile] | None = None) -> dict[str, Profile]:
    """A profile of every column, but for those in ``known``, which have not changed.

    One scan gives counts, moments and type rates of all columns; distinct counts come a few columns at
    a time, since each multiplies the rows of its aggregation; quantiles are exact at any size, all columns'
    together; the top values of all label columns come from one aggregation.
    """
    every = [c for c in df.columns if c != ROW]
    names = [c for c in every if c not in (known or {})]
    if not names and known:
        return {c: known[c] for c in every}
    df = X.blank_nan(df)
    row = df.agg(F.count(F.lit(1)).alias("total"), *(c.alias(k) for k, c in statistics(df, names).items())).first().asDict()
    total = row["total"]
    countable = [(i, n) for i, n in enumerate(names) if df.schema[n].dataType.typeName() not in ("map", "array", "struct", "variant")]
    for at in range(0, len(countable), t.distinct_batch):
        some = countable[at : at + t.distinct_batch]
        row |= df.agg(*(F.count_distinct(X.named(n)).alias(f"{i}_unique") for i, n in some)).first().asDict()
    numeric = [n for n in names if X.is_numeric(df.schema[n].dataType)]
    spread = quantiles_of(df, {n: [0.25, 0.5, 0.75] for n in numeric}, {n: row[f"{names.index(n)}_n"] for n in numeric})
    order = [X.named(ROW)] if ROW in df.columns else []
    heads = df.orderBy(*order).limit(50).collect() if order else df.limit(50).collect()
    out = {}
    for i, name in enumerate(names):
        kind = df.schema[name].dataType
        n = row[f"{i}_n"]
        p = Profile(name, Kind.UNKNOWN, kind.simpleString(), total, total - n, row.get(f"{i}_unique") or 0)
        p.samples = [str(r[name]) for r in heads if r[name] is not None][: t.samples]
        p.kind = _kind(p, kind, {k.split("_", 1)[1]: v for k, v in row.items() if k.startswith(f"{i}_")}, t)
        if X.is_numeric(kind) and n:
            q25, median, q75 = spread[name]
            p.numbers = Numbers(row[f"{i}_mean"], median, row[f"{i}_std"], row[f"{i}_min"], row[f"{i}_max"], q25, q75)
        if n:
            if p.n_unique == 1:
                p.flags.append(CONSTANT)
            elif p.n_unique == n and n > 1:
                consecutive = p.numbers is not None and p.kind == Kind.INTEGER and p.numbers.max - p.numbers.min + 1 == n
                p.flags.append(IDENTIFIER if looks_like_identifier(name, kind, consecutive) else UNIQUE)
            if p.missing_rate >= t.nearly_empty:
                p.flags.append(NEARLY_EMPTY)
        out[name] = p
    labels = [c for c in names if out[c].kind == Kind.CATEGORICAL]
    for c, found in top_values_of(df, labels, t.top_values).items():
        out[c].top_values = found
    return {c: out[c] if c in out else known[c] for c in every}


def _kind(p: Profile, kind: Any, s: dict[str, Any], t: Thresholds) -> Kind:
    """What the column means: by storage first, then by what its text looks like."""
    n = p.n_present
    if not n:
        p.flags.append(ALL_MISSING)
        return Kind.UNKNOWN
    if X.is_datetime(kind):
        return Kind.DATETIME
    if X.is_boolean(kind):
        return Kind.BOOLEAN
    if X.is_numeric(kind):
        if not s["fraction"]:
            if p.n_unique <= 2 and s["min"] >= 0 and s["max"] <= 1:
                p.flags.append(ZERO_ONE)
            return Kind.INTEGER
        return Kind.NUMERIC
    if not X.is_text(kind):
        return Kind.UNKNOWN
    if s["number"] >= t.type_share * n:
        p.flags.append(HIDDEN[Kind.NUMERIC])
        return Kind.NUMERIC if s["fraction"] else Kind.INTEGER
    for key, found in (("date", Kind.DATETIME), ("bool", Kind.BOOLEAN)):
        if s[key] >= t.type_share * n:
            p.flags.append(HIDDEN[found])
            return found
    if p.n_unique <= t.categorical_unique and p.n_unique <= t.categorical_share * n:
        return Kind.CATEGORICAL
    return Kind.STRING


def looks_like_identifier(name: str, kind: Any, consecutive: bool) -> bool:
    low = name.lower()
    words = set(re.split(r"[^a-z0-9]+", low))
    return bool(words & ID_WORDS) or low.endswith(("id", "key")) or X.is_text(kind) or consecutive


def top_values(df: DataFrame, name: str, k: int) -> list[tuple[str, int]]:
    """The k most frequent values, ties by value."""
    return top_values_of(df, [name], k)[name]


def top_values_of(df: DataFrame, names: list[str], k: int) -> dict[str, list[tuple[str, int]]]:
    """The k most frequent values of each column, from one aggregation over (column, value)."""
    if not names:
        return {}
    best = Window.partitionBy("at").orderBy(F.desc("n"), "value")
    ranked = value_counts(df, names).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    rows = sorted(ranked.collect(), key=lambda r: r["rank"])
    return {c: [(r["value"], r["n"]) for r in rows if r["at"] == i] for i, c in enumerate(names)}


def value_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """at (a column's place in ``names``), value, n of every value of the columns, as text."""
    cells = df.select(F.posexplode(F.array(*(X.named(c).cast("string") for c in names))).alias("at", "value"))
    return cells.filter("value is not null").groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, name: str, bins: int = 15) -> DataFrame:
    """bin, low, high, n of equal bins over the finite range, the last one closed; n_inf counts infinities."""
    x = X.named(name).cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    low, high, n_inf = df.agg(F.min(F.when(good, x)), F.max(F.when(good, x)), F.count_if(F.abs(x) == float("inf"))).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long, n_inf long")
    width = (high - low) / bins or 1.0
    cell = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    counted = df.filter(good).groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n", F.lit(n_inf).cast("long").alias("n_inf"))


def summary_card(profiles: dict[str, Profile]) -> Card:
    kinds: dict[str, int] = {}
    flags: dict[str, int] = {}
    for p in profiles.values():
        kinds[str(p.kind)] = kinds.get(str(p.kind), 0) + 1
        for f in p.flags:
            flags[f] = flags.get(f, 0) + 1
    some = sum(p.n_missing > 0 for p in profiles.values())
    card = Card("profile_summary", Stage.PROFILE, None, f"{len(profiles)} columns profiled", "Go on to cleaning", f"{some} columns have missing cells")
    card.metadata = {"n_columns": len(profiles), "type_counts": kinds, "flag_counts": flags, "n_with_missing": some}
    return card.auto("continue")


SCHEMA = (
    "name string, detected_type string, stored_dtype string, n_total long, n_missing long, n_unique long, missing_rate double, sample_values array<string>, "
    "numeric struct<mean: double, median: double, std: double, min: double, max: double, q25: double, q75: double>, "
    "categorical struct<top_values: array<struct<value: string, count: long>>>, flags array<string>"
)


def frame(spark: SparkSession, profiles: dict[str, Profile]) -> DataFrame:
    """The profile as a table."""
    rows = []
    for p in profiles.values():
        numbers = tuple(asdict(p.numbers).values()) if p.numbers else None
        rows.append((p.name, str(p.kind), p.stored, p.n_total, p.n_missing, p.n_unique, p.missing_rate, p.samples, numbers, (p.top_values,) if p.top_values else None, p.flags))
    return spark.createDataFrame(rows, SCHEMA)
