"""Missing values: is missingness related to other columns, and what to do about it."""

from __future__ import annotations

from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.quantiles import quantiles
from ..plans.cards import Card, Kind, Pattern, Stage, Thresholds
from . import steps
from .profile import Profile, top_values
from .steps import ROW, Step

#: What may be done with missing cells, by what the column means.
ACTIONS = {
    "number": ["median_impute", "mean_impute", "regression_impute", "drop_rows", "drop_variable", "flag_missing_indicator", "leave_as_is"],
    "label": ["mode_impute", "drop_rows", "drop_variable", "flag_missing_indicator", "leave_as_is"],
    "boolean": ["flag_missing_indicator", "mode_impute", "drop_rows", "drop_variable", "leave_as_is"],
    "other": ["drop_rows", "flag_missing_indicator", "drop_variable", "leave_as_is"],
}


def _bins(c: str, p: Profile) -> F.Column | None:
    """The quartile bin of a column, by its profile; None if quartiles do not tell two bins apart."""
    s = p.numbers
    edges = sorted({s.min, s.q25, s.median, s.q75, s.max}) if s else []
    if len(edges) < 3:
        return None
    return X.right_closed_bin(X.named(c).cast("double"), edges, [str(i) for i in range(len(edges) - 1)])


def classify(df: DataFrame, var: str, profiles: dict[str, Profile], t: Thresholds = Thresholds()) -> tuple[Pattern, list[tuple[str, float]]]:
    """Whether the rate of missing cells differs between groups of another column, and by how much.

    One job for all predictors: each becomes a text level, and rates come from one aggregation over (predictor, level).
    """
    if not profiles[var].n_missing:
        return Pattern.UNKNOWN, []
    candidates = [c for c, p in profiles.items() if c != var and p.missing_rate < t.predictor_missing][: t.predictors]
    df = X.blank_nan(df)
    levels, numeric = {}, set()
    for c in candidates:
        kind = df.schema[c].dataType
        if X.is_numeric(kind):
            made = _bins(c, profiles[c])
            numeric.add(c)
        elif X.is_text(kind) or (X.is_boolean(kind) and t.probe_booleans):
            made = X.named(c).cast("string")
        else:
            continue
        if made is not None:
            levels[c] = made
    if not levels:
        return Pattern.MCAR, []
    order = list(levels)
    wide = df.select(X.named(var).isNull().cast("int").alias("_missing"), F.array(*levels.values()).alias("_levels"))
    long = wide.select("_missing", F.posexplode("_levels").alias("_p", "_level")).filter("_level is not null")
    rates = long.groupBy("_p", "_level").agg(F.avg("_missing").alias("rate"), F.count(F.lit(1)).alias("n"))
    spreads = rates.groupBy("_p").agg((F.max("rate") - F.min("rate")).alias("spread"), F.count(F.lit(1)).alias("levels"), F.count_if(F.col("n") >= t.least_level_rows).alias("large"), F.sum("n").alias("seen"))
    evidence = []
    for r in spreads.collect():
        c = order[r["_p"]]
        enough = r.seen >= t.least_observed and (r.levels >= 2 if c in numeric else r.levels >= 2 and r.large >= 2)
        if enough and r.spread >= t.mar_spread:
            evidence.append((c, round(r.spread, 3)))
    evidence.sort(key=lambda e: (-e[1], order.index(e[0])))
    return (Pattern.MAR if evidence else Pattern.MCAR), evidence[:3]


def recommend(p: Profile, pattern: Pattern, t: Thresholds = Thresholds()) -> tuple[str, list[str]]:
    """The action to take, and the others that could be."""
    group = "number" if p.is_number() else "label" if p.is_label() else "boolean" if p.kind == Kind.BOOLEAN else "other"
    if p.missing_rate >= t.drop_column_rate:
        best = "drop_variable"
    elif p.missing_rate <= t.drop_rows_rate or p.kind == Kind.DATETIME:
        best = "drop_rows"
    elif group == "number":
        best = "regression_impute" if pattern == Pattern.MAR else "median_impute"
    else:
        best = "mode_impute" if group == "label" else "flag_missing_indicator"
    return best, [a for a in ACTIONS[group] if a != best]


def detect(df: DataFrame, profiles: dict[str, Profile], t: Thresholds = Thresholds()) -> list[Card]:
    cards = []
    for c, p in profiles.items():
        if p.n_missing:
            pattern, evidence = classify(df, c, profiles, t)
            best, others = recommend(p, pattern, t)
            card = Card(f"missing__{c}", Stage.MISSINGNESS, c, f"{p.n_missing} cells ({p.missing_rate:.1%}) are missing", best, f"pattern {pattern}", best, others)
            card.metadata = {"n_missing": p.n_missing, "missing_rate": p.missing_rate, "pattern": str(pattern), "evidence": evidence}
            cards.append(card)
    return cards


def fill_value(df: DataFrame, column: str, method: str) -> Any:
    """The constant that fills: median, mean, or most frequent value with ties to the smallest."""
    if method == "median":
        found = quantiles(df, column, [0.5])
        return found[0] if found else None
    if method == "mean":
        return X.blank_nan(df).agg(F.avg(X.named(column).cast("double"))).first()[0]
    counted = X.blank_nan(df).groupBy(X.named(column).alias("v")).count().filter("v is not null")
    head = counted.orderBy(F.desc("count"), "v").limit(1).collect()
    return head[0].v if head else None


def ridge(gram: np.ndarray, cross: np.ndarray, yy: float, n: int, rounds: int = 300, tol: float = 1e-3) -> np.ndarray:
    """Weights of a Bayesian ridge regression from centred sums: precisions of noise and weights by evidence maximisation."""
    if n < 2 or not len(cross):
        return np.zeros(len(cross))
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0)
    rotated = vectors.T @ cross
    alpha, lam, tiny = 1.0 / max(yy / n, 1e-12), 1.0, 1e-6
    last = None
    for _ in range(rounds):
        w = vectors @ (rotated * alpha / (alpha * values + lam))
        if last is not None and np.abs(w - last).sum() < tol:
            break
        last = w
        effective = float((alpha * values / (alpha * values + lam)).sum())
        rest = max(yy - 2 * w @ cross + w @ gram @ w, 0.0)
        lam = (effective + 2 * tiny) / (float(w @ w) + 2 * tiny)
        alpha = (n - effective + 2 * tiny) / (rest + 2 * tiny)
    return w


#: Patterns of missing cells up to which all rounds are computed from one scan.
MOST_PATTERNS = 4096


def fit_chain(df: DataFrame, column: str, t: Thresholds = Thresholds()) -> Step:
    """Chained Bayesian ridge regressions over the numeric columns.

    Rows in which the same cells are missing have imputed values that are one linear function of what they have,
    in every round. So one aggregation of sums of products by pattern of missing cells is all that the rounds
    need; the driver solves systems as wide as there are numeric columns.
    """
    df = X.blank_nan(df)
    numeric = [f.name for f in df.schema.fields if X.is_numeric(f.dataType) and f.name != ROW]
    row = df.agg(*(F.avg(X.named(n).cast("double")).alias(f"m{i}") for i, n in enumerate(numeric)), *(F.count_if(X.named(n).isNull()).alias(f"n{i}") for i, n in enumerate(numeric))).first()
    names = [n for i, n in enumerate(numeric) if row[f"m{i}"] is not None]
    starts = {n: row[f"m{numeric.index(n)}"] for n in names}
    gaps = {n: row[f"n{numeric.index(n)}"] for n in names}
    order = sorted((n for n in names if gaps[n]), key=lambda n: (gaps[n], names.index(n)))
    rounds = _rounds(_moments(df, names, order, starts), names, order, starts, t.mice_rounds) if order else []
    return {"op": "chained_fill", "targets": order if t.mice_fill_all else [c for c in order if c == column], "starts": starts, "rounds": rounds}


def _moments(df: DataFrame, names: list[str], order: list[str], starts: dict[str, float]) -> dict[tuple[bool, ...], np.ndarray]:
    """By pattern (which columns of ``order`` are missing): sums of products of 1 and the centred columns, missing ones 0."""
    centred = [F.coalesce(X.named(n).cast("double") - F.lit(starts[n]), F.lit(0.0)).alias(f"v{i}") for i, n in enumerate(names)]
    flags = F.concat(*(F.when(X.named(n).isNull(), F.lit("1")).otherwise(F.lit("0")) for n in order)).alias("pattern")
    m = len(names)
    sums = [F.count(F.lit(1)).cast("double").alias("n"), *(F.sum(f"v{i}").alias(f"s{i}") for i in range(m))]
    sums += [F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"p{i}_{j}") for i in range(m) for j in range(i, m)]
    grouped = df.select(flags, *centred).groupBy("pattern").agg(*sums)
    found = grouped.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} patterns of missing cells in {len(order)} columns; fill or drop some of them first")
    out = {}
    for r in found:
        z = np.empty((m + 1, m + 1))
        z[0, 0] = r.n
        for i in range(m):
            z[0, i + 1] = z[i + 1, 0] = r[f"s{i}"]
            for j in range(i, m):
                z[i + 1, j + 1] = z[j + 1, i + 1] = r[f"p{i}_{j}"]
        out[tuple(c == "1" for c in r.pattern)] = z
    return out


def _rounds(moments: dict[tuple[bool, ...], np.ndarray], names: list[str], order: list[str], starts: dict[str, float], rounds: int) -> list[dict[str, Any]]:
    """The equations of all rounds, in the order in which they are applied."""
    m = len(names)
    # the columns (centred) of a pattern's rows as functions of 1 and what the rows have; missing ones start at the mean
    made = {}
    for pattern in moments:
        made[pattern] = np.concatenate([np.zeros((m, 1)), np.eye(m)], axis=1)
        for n, gone in zip(order, pattern, strict=True):
            if gone:
                made[pattern][names.index(n)] = 0.0
    center = np.array([starts[n] for n in names])
    equations: list[dict[str, Any]] = []
    for _ in range(rounds):
        for k, n in enumerate(order):
            seen = [p for p in moments if not p[k]]
            count = sum(moments[p][0, 0] for p in seen)
            if not count:
                continue
            s = sum(made[p] @ moments[p][:, 0] for p in seen)
            products = sum(made[p] @ moments[p] @ made[p].T for p in seen) - np.outer(s, s) / count
            y, xs = names.index(n), [i for i in range(m) if names[i] != n]
            w = ridge(products[np.ix_(xs, xs)], products[xs, y], float(products[y, y]), int(count))
            shift = s / count
            offset = shift[y] - w @ shift[xs]  # of the centred columns
            equations.append({"column": n, "offset": float(offset + center[y] - w @ center[xs]), "weights": {names[i]: float(a) for i, a in zip(xs, w, strict=True)}})
            for p in moments:
                if p[k]:
                    made[p][y] = w @ made[p][xs]
                    made[p][y, 0] += offset
    return equations


def fit(df: DataFrame, card: Card, t: Thresholds = Thresholds()) -> list[Step]:
    action, c = card.action_taken, card.variable
    if action == "leave_as_is":
        return []
    if action == "drop_variable":
        return [{"op": "drop_column", "column": c}]
    if action == "drop_rows":
        return [{"op": "drop_null_rows", "column": c}]
    if action == "flag_missing_indicator":
        return [{"op": "indicator", "column": c, "new": f"{c}_was_missing"}]
    numeric = X.is_numeric(df.schema[c].dataType)
    if action == "regression_impute" and numeric:
        return [fit_chain(df, c, t)]
    if action in ("median_impute", "mean_impute", "mode_impute", "regression_impute"):
        method = action.split("_")[0]
        if method == "regression" or not numeric and method != "mode":
            card.metadata["fallback_from"], method = action, "mode"
        value = fill_value(df, c, method)
        card.metadata["applied_info"] = {"n_imputed": card.metadata.get("n_missing"), "imputed_value": value}
        return [] if value is None else [{"op": "fill", "column": c, "value": value}]
    raise ValueError(f"unknown action {action!r}")


def apply(df: DataFrame, card: Card, t: Thresholds = Thresholds()) -> DataFrame:
    for one in fit(df, card, t):
        df = steps.run(df, one)
    return df


__all__ = ["classify", "recommend", "detect", "fit", "apply", "fit_chain", "fill_value", "ridge", "top_values"]
