"""Features: binning, scaling and encoding of clean columns."""

from __future__ import annotations

import math
import uuid
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.quantiles import quantiles
from ..plans.cards import Card, Stage, Thresholds
from ..session import shared_folder
from . import steps
from .profile import Profile
from .steps import Step

BIN, SCALE = ["quantile_bin", "equal_width_bin", "natural_breaks_bin"], ["standard_scale", "minmax_scale", "robust_scale", "log_scale"]
PARTS = ["year", "month", "day", "dayofweek", "hour", "is_weekend"]


def skewness(df: DataFrame, columns: list[str]) -> dict[str, float]:
    if not columns:
        return {}
    row = X.blank_nan(df).agg(*(X.sample_skewness(X.named(c)).alias(str(i)) for i, c in enumerate(columns))).first()
    return {c: row[str(i)] or 0.0 for i, c in enumerate(columns)}


# binning


def assess_binning(df: DataFrame, profiles: dict[str, Profile], t: Thresholds = Thresholds()) -> list[Card]:
    numeric = [c for c, p in profiles.items() if p.is_number() and p.numbers and p.n_unique >= t.bin_unique]
    skews, cards = skewness(df, numeric), []
    for c in numeric:
        s = profiles[c].numbers
        iqr, wide = s.q75 - s.q25, False
        wide = iqr > 0 and s.max - s.min > t.bin_range * iqr
        skewed = abs(skews[c]) > t.bin_skew
        if wide or skewed:
            best = "quantile_bin" if skewed else "natural_breaks_bin"
            card = Card(f"binning_{c}", Stage.BINNING, c, "wide range" if wide else f"skewness {skews[c]:.2f}", best, "", best, [*(a for a in BIN if a != best), "skip"])
            card.metadata = {"skewness": skews[c], "bins": t.bins, "new_col": f"{c}_bin"}
            cards.append(card)
    return cards


def cuts(df: DataFrame, column: str, method: str, bins: int = 4, values: int = 5000) -> list[float]:
    """Edges of right-closed bins, the ends widened a little so that both extremes fall inside."""
    if method == "quantile":
        found = quantiles(df, column, [i / bins for i in range(bins + 1)])
    elif method == "natural_breaks":
        grid = quantiles(df, column, [i / (values - 1) for i in range(values)])
        found = natural_breaks(sorted(grid), bins) if grid else None
    else:
        found = None
    low, high = X.blank_nan(df).agg(F.min(X.named(column).cast("double")), F.max(X.named(column).cast("double"))).first()
    if low is None:
        return []
    edges = sorted(set(found or []))
    if len(edges) < 2:
        edges = [float(e) for e in np.linspace(low, high, bins + 1)]
        edges = sorted(set(edges)) if low < high else [low, high]
    edges[0] -= 1e-9
    edges[-1] += 1e-9
    return edges


def natural_breaks(values: list[float], bins: int) -> list[float]:
    """Least, middle points between the centres, and greatest of the best grouping of sorted values.

    The grouping of least squared distance is found exactly, by dynamic programming over distinct values. The
    best last group of a longer prefix begins no earlier than that of a shorter one, so each layer halves its ranges.
    """
    kinds, weight = np.unique(np.array(values, np.float64), return_counts=True)
    k = min(bins, len(kinds))
    n = np.concatenate([[0], np.cumsum(weight)])
    s = np.concatenate([[0.0], np.cumsum(weight * (kinds - kinds[0]))])
    q = np.concatenate([[0.0], np.cumsum(weight * (kinds - kinds[0]) ** 2)])
    m = len(kinds)
    best = np.concatenate([[0.0], q[1:] - s[1:] ** 2 / n[1:]])  # one group of the first values
    splits = []
    for _ in range(1, k):
        after, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        todo = [(1, m, 0, m - 1)]
        while todo:
            low, high, a, b = todo.pop()
            if low > high:
                continue
            j = (low + high) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + q[j] - q[i] - (s[j] - s[i]) ** 2 / (n[j] - n[i])
            at[j] = i[cost.argmin()]
            after[j] = cost.min()
            todo += [(low, j - 1, a, at[j]), (j + 1, high, at[j], b)]
        splits.append(at)
        best = after
    ends = [m]
    for at in reversed(splits):
        ends.append(int(at[ends[-1]]))
    ends = sorted(set(ends) | {0})
    centres = [kinds[0] + (s[b] - s[a]) / (n[b] - n[a]) for a, b in zip(ends, ends[1:], strict=False)]
    return [float(kinds[0]), *((a + b) / 2 for a, b in zip(centres, centres[1:], strict=False)), float(kinds[-1])]


def bin_labels(edges: list[float]) -> list[str]:
    """A label for each bin, with as few decimals as keep the inner edges apart."""
    if len(edges) == 2:
        return ["all"]
    inner = edges[1:-1]
    for digits in range(7):
        texts = [f"{e:.{digits}f}" for e in inner]
        if len(set(texts)) == len(texts):
            return [f"≤{texts[0]}", *(f"{a}–{b}" for a, b in zip(texts, texts[1:], strict=False)), f">{texts[-1]}"]
    return [f"bin_{i}" for i in range(len(edges) - 1)]


def fit_binning(df: DataFrame, card: Card, t: Thresholds = Thresholds()) -> list[Step]:
    if card.action_taken == "skip":
        return []
    if card.action_taken not in BIN:
        raise ValueError(f"unknown action {card.action_taken!r}")
    one = bin_step(df, card.variable, card.action_taken.removesuffix("_bin"), card.metadata.get("bins", t.bins), card.metadata.get("new_col"), t.break_values)
    return [one] if one else []


def bin_step(df: DataFrame, column: str, method: str, bins: int | list[float] = 4, new: str | None = None, values: int = 5000) -> Step | None:
    if column not in df.columns:
        raise KeyError(column)
    edges = sorted(map(float, bins)) if isinstance(bins, list) else cuts(df, column, method, bins, values)
    return {"op": "bin", "column": column, "edges": edges, "labels": bin_labels(edges), "new": new or f"{column}_bin"} if len(edges) >= 2 else None


def bin_column(df: DataFrame, column: str, method: str = "quantile", bins: int | list[float] = 4, new: str | None = None) -> DataFrame:
    one = bin_step(df, column, method, bins, new)
    return steps.run(df, one) if one else df


# scaling


def assess_scaling(df: DataFrame, profiles: dict[str, Profile], t: Thresholds = Thresholds()) -> list[Card]:
    numeric = {c: p.numbers for c, p in profiles.items() if p.is_number() and p.numbers}
    ranges = {c: s.max - s.min for c, s in numeric.items() if s.max - s.min >= t.scale_range and max(abs(s.max), abs(s.min)) >= t.scale_magnitude and math.isfinite(s.max - s.min)}
    skews, least, cards = skewness(df, list(ranges)), min(ranges.values(), default=0.0), []
    uneven = bool(ranges) and max(ranges.values()) / least >= t.scale_ratio
    for c, r in ranges.items():
        skew, large = skews[c], uneven and r > t.scale_ratio * least
        if not large and abs(skew) <= t.scale_skew:
            continue
        if skew > t.scale_skew:
            best = "log_scale" if numeric[c].min >= 0 else "robust_scale"
        elif skew < -t.scale_skew:
            best = "robust_scale"
        else:
            best = "robust_scale" if abs(skew) > t.robust_skew else "standard_scale"
        card = Card(f"scaling_{c}", Stage.SCALING, c, "large range" if large else f"skewness {skew:.2f}", best, "", best, [*(a for a in SCALE if a != best), "skip"])
        card.metadata = {"skewness": skew, "range": r, "new_col": f"{c}_scaled"}
        cards.append(card)
    return cards


def scale_step(df: DataFrame, column: str, method: str, new: str) -> Step:
    """A fitted scaling; a zero spread only shifts."""
    if column not in df.columns:
        raise KeyError(column)
    x, df = X.named(column).cast("double"), X.blank_nan(df)
    if method == "log":
        return {"op": "log_scale", "column": column, "new": new}
    if method == "standard":
        center, scale = df.agg(F.avg(x), F.stddev_samp(x)).first()
    elif method == "minmax":
        low, high = df.agg(F.min(x), F.max(x)).first()
        center, scale = low, None if low is None else high - low
    elif method == "robust":
        found = quantiles(df, column, [0.25, 0.5, 0.75])
        center, scale = (found[1], found[2] - found[0]) if found else (None, None)
    else:
        raise ValueError(f"unknown method {method!r}")
    return {"op": "shift_scale", "column": column, "center": center or 0.0, "scale": scale or 1.0, "new": new}


def fit_scaling(df: DataFrame, card: Card) -> list[Step]:
    if card.action_taken == "skip":
        return []
    if card.action_taken not in SCALE:
        raise ValueError(f"unknown action {card.action_taken!r}")
    return [scale_step(df, card.variable, card.action_taken.removesuffix("_scale"), card.metadata.get("new_col") or f"{card.variable}_scaled")]


def scale_column(df: DataFrame, column: str, method: str = "standard", inplace: bool = False) -> DataFrame:
    return steps.run(df, scale_step(df, column, method, column if inplace else f"{column}_scaled"))


# encoding


def assess_encoding(df: DataFrame, profiles: dict[str, Profile], t: Thresholds = Thresholds()) -> list[Card]:
    cards = []
    for c, p in profiles.items():
        if p.is_label() and p.n_unique > t.encode_unique and p.n_total and p.n_unique / p.n_total < t.encode_share:
            cards.append(Card(f"encoding_{c}", Stage.ENCODING, c, f"{p.n_unique} labels", "frequency_encode", "", "frequency_encode", ["skip"], metadata={"new_col": f"{c}_freq"}))
    return cards


def shares(df: DataFrame, column: str) -> DataFrame:
    """_value, _share of every value among the rows that have one."""
    counted = df.filter(X.named(column).isNotNull()).groupBy(X.named(column).cast("string").alias("_value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(X.named(column))).first()[0]
    return counted.select("_value", (F.col("n") / F.lit(total)).alias("_share"))


def frequency_step(df: DataFrame, column: str, new: str | None = None, most: int = 10_000, path: str | None = None) -> Step:
    """Shares as literals; more than ``most`` values are written to ``path``, in the shared folder if none is given, and read back by the step."""
    if column not in df.columns:
        raise KeyError(column)
    found, new = shares(df, column), new or f"{column}_freq"
    head = found.orderBy("_value").limit(most + 1).collect()
    if len(head) <= most:
        return {"op": "frequency", "column": column, "new": new, "table": [list(r) for r in head]}
    path = path or f"{shared_folder(df.sparkSession)}/shares-{uuid.uuid4().hex}.parquet"
    found.write.mode("overwrite").parquet(path)
    return {"op": "frequency", "column": column, "new": new, "path": path}


def frequency_encode(df: DataFrame, column: str, new: str | None = None) -> DataFrame:
    """Shares joined directly, for any number of values."""
    return steps.lookup_share(df, column, new or f"{column}_freq", shares(df, column))


def datetime_decompose(df: DataFrame, column: str, parts: list[str] | None = None) -> DataFrame:
    return steps.run(df, {"op": "datetime_parts", "column": column, "parts": parts or PARTS})


def fit_encoding(df: DataFrame, card: Card, path: str | None = None) -> list[Step]:
    if card.action_taken == "skip":
        return []
    if card.action_taken == "frequency_encode":
        return [frequency_step(df, card.variable, card.metadata.get("new_col"), path=path)]
    if card.action_taken == "datetime_decompose":
        return [{"op": "datetime_parts", "column": card.variable, "parts": card.metadata.get("components", PARTS)}]
    raise ValueError(f"unknown action {card.action_taken!r}")


def on_demand(df: DataFrame, column: str, action: str, **options: Any) -> tuple[DataFrame, Card, Step]:
    """One transform asked for by name, with its card and its step."""
    stage = Stage.BINNING if action in BIN or action.startswith("bin") else Stage.SCALING if action in SCALE else Stage.ENCODING
    if stage == Stage.BINNING:
        one = bin_step(df, column, action.removesuffix("_bin"), options.get("bins", 4), options.get("new_col"))
    elif stage == Stage.SCALING:
        one = scale_step(df, column, action.removesuffix("_scale"), column if options.get("inplace") else f"{column}_scaled")
    elif action == "frequency_encode":
        one = frequency_step(df, column, options.get("new_col"), path=options.get("path"))
    elif action == "datetime_decompose":
        one = {"op": "datetime_parts", "column": column, "parts": options.get("components", PARTS[:4])}
    else:
        raise ValueError(f"unknown action {action!r}")
    if one is None:
        raise ValueError(f"{column} has no values to fit")
    card = Card(f"ondemand_{column}_{action}", stage, column, "asked for", action, default_action=action, metadata={"step": one, "new_col": one.get("new"), **options})
    return steps.run(df, one), card.resolve(action), one
