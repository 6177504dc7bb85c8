"""Duplicates: equal rows, and rows that share an entity key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..plans.cards import Card, Stage, Thresholds
from . import steps
from .profile import IDENTIFIER, Profile
from .steps import ROW, Step

#: Name parts of entity keys.
KEY_WORDS = {"id", "key", "uuid", "guid", "identifier", "idx"}
EXACT = ["remove_all_duplicates", "keep_all_duplicates", "drop_all_duplicate_rows"]
CLUSTER = ["inspect", "merge_keep_first", "merge_keep_last", "keep_all"]


def entity_keys(names: list[str]) -> list[str]:
    return [n for n in names if set(re.split(r"[^a-z0-9]+", n.lower())) & KEY_WORDS or n.lower().endswith("id")]


def exact_counts(df: DataFrame, keys: list[str]) -> tuple[int, int, int]:
    """Rows that have a copy, groups of copies, rows to remove."""
    groups = df.groupBy(*map(X.named, keys)).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    rows, n = groups.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    return rows, n, rows - n


def collisions(df: DataFrame, key: str) -> DataFrame:
    """key, n of every value of the key that comes more than once."""
    return df.filter(X.named(key).isNotNull()).groupBy(X.named(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def differing_columns(df: DataFrame, key: str, others: list[str]) -> DataFrame:
    """key, n and differ (names of the columns in which its rows differ) of every value of the key that comes more than once.

    Missing is a value of its own. Two different values have a smallest and a largest one that differ, so no
    distinct count is needed, and rows combine before the shuffle.
    """
    text = lambda c: F.coalesce(X.named(c).cast("string"), F.lit("\x00missing"))
    some = df.filter(X.named(key).isNotNull()).groupBy(X.named(key).alias("key"))
    rows = some.agg(F.count(F.lit(1)).alias("n"), *((F.min(text(c)) != F.max(text(c))).alias(f"_{i}") for i, c in enumerate(others))).filter("n > 1")
    names = F.array(*(F.when(F.col(f"_{i}"), F.lit(c)) for i, c in enumerate(others))) if others else F.array().cast("array<string>")
    return rows.select("key", "n", F.array_compact(names).alias("differ"))


def detect(df: DataFrame, profiles: dict[str, Profile], t: Thresholds = Thresholds()) -> list[Card]:
    names = [c for c in df.columns if c != ROW]
    excluded = [c for c, p in profiles.items() if IDENTIFIER in p.flags]
    keys = [c for c in names if c not in excluded] or names
    cards: list[Card] = []
    rows, groups, extra = exact_counts(df, keys)
    if groups:
        card = Card("duplicates_exact", Stage.DUPLICATE, None, f"{rows} rows in {groups} groups of equal rows", f"Remove {extra} rows", "Equal in every column that is no identifier", EXACT[0], EXACT[1:])
        card.metadata = {"key_columns": keys, "excluded_columns": excluded, "n_duplicate_rows": rows, "n_groups": groups, "n_to_remove": extra}
        cards.append(card)
    found = entity_keys(names)
    if not found:
        return [*cards, Card("duplicates_near_skipped", Stage.DUPLICATE, None, "no entity key", "Skip", default_action="skip").auto("skip")]
    key = found[0]
    hits = collisions(df, key)
    n = hits.count()
    distinct = profiles[key].n_unique if key in profiles else df.agg(F.count_distinct(X.named(key))).first()[0]
    if not n:
        return [*cards, Card("duplicates_near_clear", Stage.DUPLICATE, key, "every key is used once", "Nothing to do", default_action="continue").auto("continue")]
    rate = n / distinct
    if rate > t.panel_rate:
        card = Card("duplicates_near_panel_key", Stage.DUPLICATE, key, f"{rate:.0%} of keys repeat", "Keep all rows", "The key names entities seen repeatedly", "keep_all", metadata={"collision_rate": rate})
        return [*cards, card.auto("keep_all")]
    some = hits.orderBy("key").limit(t.clusters).collect()
    shown = df.filter(X.named(key).isin([r["key"] for r in some]))
    differ = {r["key"]: r.differ for r in differing_columns(shown, key, [c for c in names if c != key]).collect()}  # one row a card
    for i, r in enumerate(some, 1):
        card = Card(f"duplicates_near_{i:03d}", Stage.DUPLICATE, key, f"{r.n} rows have {key} = {r['key']}", "Look at them", "", CLUSTER[0], CLUSTER[1:])
        card.metadata = {"key": key, "value": r["key"], "size": r.n, "differing_columns": differ[r["key"]]}
        cards.append(card)
    if n > t.clusters:
        cards.append(Card("duplicates_near_overflow", Stage.DUPLICATE, key, f"{n - t.clusters} more keys repeat", "Look at them", "", CLUSTER[0], ["keep_all"], metadata={"n_more": n - t.clusters}))
    return cards


def fit(df: DataFrame, card: Card) -> list[Step]:
    """The steps of a resolved card."""
    action, m = card.action_taken, card.metadata
    if action == "remove_all_duplicates":
        return [{"op": "keep_first", "keys": m["key_columns"], "order": [ROW] if ROW in df.columns else [c for c in df.columns]}]
    if action == "drop_all_duplicate_rows":
        return [{"op": "drop_copies", "keys": m["key_columns"]}]
    if action in ("merge_keep_first", "merge_keep_last"):
        order = [ROW] if ROW in df.columns else [c for c in df.columns]
        return [{"op": "keep_one", "column": m["key"], "value": m["value"], "last": action == "merge_keep_last", "order": order}]
    if action in ("keep_all_duplicates", "keep_all", "inspect", "skip", "continue"):
        return []
    raise ValueError(f"unknown action {action!r}")


def apply(df: DataFrame, card: Card) -> DataFrame:
    for one in fit(df, card):
        df = steps.run(df, one)
    return df
