"""Outliers: quartile fences, distance from the mean, and impossible negatives."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.quantiles import quantiles_of
from ..plans.cards import Card, Stage, Thresholds
from . import steps
from .profile import Profile
from .steps import Step

ACTIONS = ["leave_as_is", "inspect", "treat_as_missing", "drop_rows", "winsorize"]


@dataclass
class Fences:
    """What was fitted, and how many values it flags."""

    low: float
    high: float
    mean: float
    std: float
    z: float
    negative: bool
    n_fence: int = 0
    n_z: int = 0
    n_extreme: int = 0
    n_negative: int = 0
    n_flagged: int = 0

    def predicate(self) -> dict[str, Any]:
        return {"low": self.low, "high": self.high, "mean": self.mean, "std": self.std, "z": self.z, "negative": self.negative}

    @property
    def severity(self) -> str:
        return "none" if not self.n_flagged else "implausible" if self.n_negative else "extreme" if self.n_extreme else "mild"


def fit_fences(df: DataFrame, column: str, t: Thresholds = Thresholds()) -> Fences | None:
    """Fences of a numeric column; None if it is not numeric or has too few values."""
    return fences_of(df, [column], t).get(column)


def fences_of(df: DataFrame, columns: list[str], t: Thresholds = Thresholds()) -> dict[str, Fences]:
    """Fences of the numeric columns that have enough values: three scans for all of them."""
    columns = [c for c in columns if X.is_numeric(df.schema[c].dataType)]
    if not columns:
        return {}
    df = X.blank_nan(df)
    x = {c: X.named(c).cast("double") for c in columns}
    row = df.agg(*(e.alias(f"{k}{i}") for i, c in enumerate(columns) for k, e in (("n", F.count(x[c])), ("m", F.avg(x[c])), ("s", F.coalesce(F.stddev_samp(x[c]), F.lit(0.0)))))).first()
    some = {c: i for i, c in enumerate(columns) if row[f"n{i}"] >= t.least_values}
    spread = quantiles_of(df, {c: [0.25, 0.75] for c in some}, {c: row[f"n{i}"] for c, i in some.items()})
    out, counts = {}, []
    for c, i in some.items():
        q25, q75 = spread[c]
        iqr, mean, std = q75 - q25, row[f"m{i}"], row[f"s{i}"]
        f = out[c] = Fences(q25 - t.fence * iqr, q75 + t.fence * iqr, mean, std, t.z, q25 > 0)
        distance = F.abs((x[c] - mean) / std) if std > 0 else F.lit(0.0)
        counts += [F.count_if((x[c] < f.low) | (x[c] > f.high)), F.count_if(distance > t.z), F.count_if(distance > t.extreme_z)]
        counts += [F.count_if((x[c] < 0) & F.lit(f.negative)), F.count_if(steps.flagged(c, **f.predicate()))]
    counted = iter(df.agg(*(n.alias(str(k)) for k, n in enumerate(counts))).first()) if counts else iter(())
    for f in out.values():
        f.n_fence, f.n_z, f.n_extreme, f.n_negative, f.n_flagged = (next(counted) for _ in range(5))
    return out


def detect(df: DataFrame, profiles: dict[str, Profile], t: Thresholds = Thresholds()) -> list[Card]:
    cards = []
    found = {c: f for c, f in fences_of(df, [c for c, p in profiles.items() if p.is_number() and c in df.columns], t).items() if f.n_flagged}
    for c, f in found.items():
        best = {"implausible": "treat_as_missing", "extreme": "inspect", "mild": "leave_as_is"}[f.severity]
        card = Card(f"outlier__{c}", Stage.OUTLIER, c, f"{f.n_flagged} values stand out ({f.severity})", best, "", best, [a for a in ACTIONS if a != best])
        # the 50 that are farthest from the mean, so that a card holds the same values in every run
        value = X.named(c)
        some = X.blank_nan(df).filter(steps.flagged(c, **f.predicate())).select(value).orderBy(F.abs(value.cast("double") - f.mean).desc(), value).limit(50).collect()
        card.metadata = {"severity": f.severity, "n_flagged": f.n_flagged, "n_iqr": f.n_fence, "n_z": f.n_z, "n_extreme": f.n_extreme, "n_implausible": f.n_negative, "values": [r[0] for r in some], "fitted": f.predicate()}
        cards.append(card)
    return cards


def fit(df: DataFrame, card: Card) -> list[Step]:
    action, c, fitted = card.action_taken, card.variable, card.metadata["fitted"]
    if action in ("leave_as_is", "inspect"):
        return []
    if action == "treat_as_missing":
        return [{"op": "null_outliers", "column": c, **fitted}]
    if action == "drop_rows":
        return [{"op": "drop_outliers", "column": c, **fitted}]
    if action == "winsorize":
        return [{"op": "clip", "column": c, "low": fitted["low"], "high": fitted["high"]}]
    raise ValueError(f"unknown action {action!r}")


def apply(df: DataFrame, card: Card) -> DataFrame:
    for one in fit(df, card):
        df = steps.run(df, one)
    return df
