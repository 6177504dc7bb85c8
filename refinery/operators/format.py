"""Format: names, white space, missing tokens, storage types and label spellings, settled without asking."""

from __future__ import annotations

import re
import uuid
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..plans.cards import Card, Kind, Stage, Thresholds
from ..session import checkpoint, shared_folder
from . import steps
from .profile import HIDDEN, ZERO_ONE, Profile, profile, value_counts
from .steps import ROW, Step

#: Date patterns tried in turn on the first value, with what its fields must satisfy.
_TIMES = ["", " HH:mm", " HH:mm:ss", " HH:mm:ss.SSS"]


def snake_case(name: str) -> str:
    parted = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name.strip())
    low = re.sub(r"[\W_]+", "_", parted, flags=re.ASCII).strip("_").lower()
    return "_" + low if not low or low[0].isdigit() else low


def snake_names(names: list[str]) -> list[str]:
    """Snake-cased names; a name that is taken gets _1, _2 and so on."""
    out: list[str] = []
    for n in map(snake_case, names):
        k, new = 0, n
        while new in out:
            k += 1
            new = f"{n}_{k}"
        out.append(new)
    return out


def _card(card_id: str, variable: str | None, issue: str, action: str, done: Step, **metadata: Any) -> Card:
    card = Card(card_id, Stage.FORMAT, variable, issue, action, default_action=action, metadata=metadata | {"step": done})
    return card.auto(action)


def resolve_formats(df: DataFrame, profiles: dict[str, Profile] | None = None, t: Thresholds = Thresholds(), folder: str | None = None) -> tuple[DataFrame, list[Card], list[Step]]:
    """The table in clean formats, the cards that say what was done, and the steps that do it again.

    Each question is asked of all columns in one scan: white space and tokens, dates' first values, what
    coercion makes of cells, spellings of labels. ``folder`` takes maps of labels too large for a plan.
    """
    cards: list[Card] = []
    done: list[Step] = []

    def add(card: Card) -> None:
        nonlocal df
        cards.append(card)
        done.append(card.metadata["step"])
        df = steps.run(df, card.metadata["step"])

    names = [c for c in df.columns if c != ROW]
    new = snake_names(names)
    if new != names:
        renames = dict(zip(names, new, strict=True))
        add(_card("format_column_names", None, "column names are not snake case", "renamed", {"op": "rename", "names": new}, renames=renames))
        profiles = {renames[c]: replace(p, name=renames[c], flags=p.flags) for c, p in profiles.items()} if profiles and set(profiles) == set(names) else None
    texts = [f.name for f in df.schema.fields if X.is_text(f.dataType)]
    if texts:
        token = lambda c: F.coalesce(X.lowered(X.named(c)).isin(X.MISSING_TOKENS), F.lit(False))
        found = []
        for i, c in enumerate(texts):
            found += [F.count_if(X.strip(X.named(c)) != X.named(c)).alias(f"s{i}"), F.count_if(token(c)).alias(f"n{i}"), F.sort_array(F.collect_set(F.when(token(c), X.strip(X.named(c))))).alias(f"t{i}")]
        seen = df.agg(*found).first()
        for i, c in enumerate(texts):
            if seen[f"s{i}"]:
                n = seen[f"s{i}"]
                add(_card(f"format_strip_ws__{c}", c, f"{n} cells have white space at an end", "stripped", {"op": "strip", "column": c}, n_changed=n))
        for i, c in enumerate(texts):
            if seen[f"n{i}"]:
                one = {"op": "missing_tokens", "column": c, "tokens": X.MISSING_TOKENS}
                add(_card(f"format_missing_tokens__{c}", c, f"{seen[f'n{i}']} cells hold a token for missing", "converted", one, tokens=seen[f"t{i}"], n_converted=seen[f"n{i}"]))
        changed = {c for i, c in enumerate(texts) if seen[f"s{i}"] or seen[f"n{i}"]}
        profiles = {c: p for c, p in (profiles or {}).items() if c not in changed} or None
    profiles = profile(df, t, profiles)
    for card in _coercions(df, profiles):
        add(card)
    labels = [c for c, p in profiles.items() if p.is_label() and X.is_text(df.schema[c].dataType)]
    for c, (mapping, path, n) in label_maps(df, labels, folder).items():
        one = {"op": "map_labels", "column": c} | ({"mapping": mapping} if path is None else {"path": path})
        add(_card(f"format_normalize_labels__{c}", c, "labels differ in case only", "normalized", one, label_mapping=mapping, n_values_changed=n))
    return df, cards, done


def _coercions(df: DataFrame, profiles: dict[str, Profile]) -> list[Card]:
    """A card for each column that is stored as something else than what it holds; two scans at most."""
    dates = [c for c, p in profiles.items() if HIDDEN[Kind.DATETIME] in p.flags]
    patterns = {c: date_format(v) for c, v in first_values(df, dates).items()}
    asked: dict[str, list[Column]] = {}
    for c, p in profiles.items():
        x = X.named(c)
        if HIDDEN[Kind.NUMERIC] in p.flags:
            n = X.to_number(x)
            asked[c] = [F.count(n), F.coalesce(F.bool_and(F.when(n.isNotNull(), X.whole(n) & (F.abs(n) < 2**53))), F.lit(False))]
        elif patterns.get(c):
            asked[c] = [F.count(F.try_to_timestamp(X.strip(x), F.lit(patterns[c])))]
        elif HIDDEN[Kind.BOOLEAN] in p.flags or ZERO_ONE in p.flags:
            asked[c] = [F.count(X.to_boolean(x, df.schema[c].dataType))]
    if not asked:
        return []
    row = df.agg(*(e.alias(f"{i}_{k}") for i, found in enumerate(asked.values()) for k, e in enumerate(found))).first()
    cards = []
    for i, c in enumerate(asked):
        p = profiles[c]
        lost = p.n_present - row[f"{i}_0"]
        if HIDDEN[Kind.NUMERIC] in p.flags:
            one = {"op": "to_number", "column": c, "integer": bool(row[f"{i}_1"])}
            cards.append(_card(f"format_coerce_numeric__{c}", c, "numbers are stored as text", "coerced", one, n_unparseable_to_nan=lost))
        elif c in patterns:
            one = {"op": "to_datetime", "column": c, "format": patterns[c]}
            cards.append(_card(f"format_coerce_datetime__{c}", c, "dates are stored as text", "coerced", one, n_unparseable_to_nat=lost, format=patterns[c]))
        else:
            cards.append(_card(f"format_coerce_boolean__{c}", c, "truth values are stored otherwise", "coerced", {"op": "to_boolean", "column": c}, n_unrecognized_to_nan=lost))
    return cards


def first_values(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """The first value of each column that is not missing."""
    if not columns:
        return {}
    if ROW in df.columns:
        row = df.agg(*(F.min_by(X.named(c).cast("string"), F.when(X.named(c).isNotNull(), X.named(ROW))).alias(str(i)) for i, c in enumerate(columns))).first()
    else:
        row = df.agg(*(F.first(X.named(c).cast("string"), ignorenulls=True).alias(str(i)) for i, c in enumerate(columns))).first()
    return {c: row[str(i)] for i, c in enumerate(columns)}


def date_format(value: str | None) -> str | None:
    """The one pattern that the first value sets for a column: month before day unless it cannot be."""
    m = re.fullmatch(r"\s*(\d+)([-/.])(\d+)\2(\d+)(.*?)\s*", value or "")
    if m:
        a, sep, b, c, rest = m.groups()
        if len(a) == 4:
            day = f"yyyy{sep}{'MM' if len(b) == 2 else 'M'}{sep}{'dd' if len(c) == 2 else 'd'}"
        else:
            year = "yyyy" if len(c) == 4 else "yy"
            order = ("d", "M") if int(a) > 12 else ("M", "d")
            day = f"{order[0]}{sep}{order[1]}{sep}{year}"
    elif m := re.fullmatch(r"\s*(\d{8})(.*?)\s*", value or ""):
        day, rest = "yyyyMMdd", m[2]
    else:
        return None
    shape = re.sub(r"\d+", lambda d: "9" * len(d[0]), rest)
    for time in _TIMES:
        if shape == re.sub(r"[HmsS]+", lambda d: "9" * len(d[0]), time):
            return day + time
    return None


#: Spellings of one column that a plan holds itself; more are written beside it as a table.
MOST_SPELLINGS = 10_000


def _spellings(df: DataFrame, columns: list[str]) -> DataFrame:
    """at, _from, _to, n of every spelling that is not the most frequent of its lower-case label, ties to the smallest."""
    counted = value_counts(df, columns).withColumn("low", X.lowered(F.col("value")))
    # the best spelling of each label combines before the shuffle, so a label of very many spellings is no hot key
    best = counted.groupBy("at", "low").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("best"))
    return counted.join(best, ["at", "low"]).filter(F.col("value") != F.col("best")).select("at", F.col("value").alias("_from"), F.col("best").alias("_to"), "n")


def label_maps(df: DataFrame, columns: list[str], folder: str | None = None) -> dict[str, tuple[dict[str, str], str | None, int]]:
    """For each column with spellings to change: the map, the table that holds it if it is too large, and the rows that change."""
    if not columns:
        return {}
    found = checkpoint(_spellings(df, columns))
    size = {r["at"]: (r.k, r.rows) for r in found.groupBy("at").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("rows")).collect()}
    small = [at for at, (k, _) in size.items() if k <= MOST_SPELLINGS]
    maps: dict[int, dict[str, str]] = {at: {} for at in small}
    for r in found.filter(F.col("at").isin(small)).orderBy("at", "_from").collect() if small else []:
        maps[r["at"]][r["_from"]] = r["_to"]
    out = {}
    for at, (_, rows) in sorted(size.items()):
        path = None
        if at not in maps:
            path = f"{folder or shared_folder(df.sparkSession)}/labels-{uuid.uuid4().hex}.parquet"
            found.filter(F.col("at") == at).select("_from", "_to").write.parquet(path)
        out[columns[at]] = maps.get(at, {}), path, rows
    return out


def label_map(df: DataFrame, c: str) -> dict[str, str]:
    """From spellings to the most frequent spelling of the same lower-case label, for a column of few."""
    return label_maps(df, [c]).get(c, ({}, None, 0))[0]
