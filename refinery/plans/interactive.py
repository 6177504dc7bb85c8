"""A session in which stages are found and settled one call at a time."""

from __future__ import annotations

import re
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..operators import features, steps
from ..operators.profile import histogram, profile, top_values
from . import pipeline as P
from .cards import Card, Stage, Status
from .hooks import DESCRIBE_SECONDS, Hooks

SIX_HOURS = 6 * 3600


class Session:
    def __init__(self, spark: SparkSession, source: str | DataFrame, target: str | None = None, hooks: Hooks | None = None, **options: Any):
        self.spark, self.source, self.target, self.options = spark, source, target, options
        self.documents: dict[str, str] = {}
        self.hooks = hooks or Hooks()
        self.reset()

    def reset(self) -> None:
        """Back to the table as it was read."""
        self.state = P.open_state(self.spark, self.source, self.target, **self.options)
        self._open: dict[Stage, list[Card]] = {}

    def run_profiling(self) -> list[Card]:
        P.run_profile(self.state)
        return self.state.log.by_stage(Stage.PROFILE)

    def run_companions(self, action: str | None = None) -> Card:
        P.run_companions(self.state, (lambda c: c.resolve(action)) if action else None)
        return self.state.log.by_stage(Stage.COMPANION)[-1]

    def run_format(self) -> list[Card]:
        P.run_format(self.state)
        return self.state.log.by_stage(Stage.FORMAT)

    def detect(self, stage: Stage) -> list[Card]:
        if not self.state.profiles:
            self.run_profiling()
        self._open[stage] = P.DETECT[stage](self.state)
        return self._open[stage]

    def resolve(self, stage: Stage, answers: dict[str, str] | None = None, notes: dict[str, str] | None = None) -> list[Card]:
        """Settles a stage's cards: an answer by card id, else the default."""
        cards = self._open.pop(stage, None)
        cards = self.detect(stage) if cards is None else cards
        self._open.pop(stage, None)

        def decide(card: Card) -> None:
            if card.card_id in (answers or {}):
                card.resolve(answers[card.card_id], note=(notes or {}).get(card.card_id))

        P.counted(self.state, stage, lambda: P.resolve(self.state, cards, decide))
        self.state.refresh()
        return cards

    def transform(self, column: str, action: str, **options: Any) -> Card:
        """One transform on demand, logged and put into the plan."""
        before = self.state.names()
        self.state.df, card, one = features.on_demand(self.state.df, column, action, **options)
        self.state.changed(steps.changed_by(one, before, self.state.names()), False)
        self.state.log.add(card)
        self.state.plan.add(one, str(card.stage), card.card_id, action)
        return card

    def variable(self, column: str) -> dict[str, Any]:
        """What an inspector shows: profile, and a histogram or the top values."""
        df = self.state.df
        p = self.state.profiles.get(column) or profile(df.select(column))[column]
        out = p.to_dict()
        if p.is_number():
            out["histogram"] = [r.asDict() for r in histogram(df, column).orderBy("bin").collect()]
        else:
            out["top_values"] = top_values(df, column, 15)
        return out | {"description": describe(self.documents, column) or self.hooks.ask("describe", column, out, seconds=DESCRIBE_SECONDS)}

    def descriptions(self) -> dict[str, str | None]:
        """A line about each column: from the documents, else from the hook, all within its budget of time."""
        found = {c: describe(self.documents, c) for c in self.state.names()}
        open_ones = [c for c, text in found.items() if text is None]
        profiles = self.state.profiles
        asked = self.hooks.ask_all("describe", [(c, profiles[c].to_dict() if c in profiles else {}) for c in open_ones])
        return found | dict(zip(open_ones, asked, strict=True))

    def chat(self, question: str) -> str | None:
        """An answer about the run, if a hook gives one."""
        return self.hooks.ask("chat", question, P.context(self.state))

    def status(self) -> dict[str, Any]:
        return self.state.log.counts() | {"pending": sum(len(c) for c in self._open.values()), "rows": self.state.rows[-1].rows_out if self.state.rows else None}

    def finalize(self, folder: str) -> dict[str, Any]:
        for stage in list(self._open):
            self.resolve(stage)
        self.state.refresh()
        return P.write_all(self.state, folder)


def describe(documents: dict[str, str], column: str) -> str | None:
    """The first place in the documents that names a column: that line and the next, 280 characters at most."""
    words = [re.escape(w) for w in column.split("_") if w]
    if not words:
        return None
    name = re.compile(r"\b" + r"[_\s-]".join(words) + r"\b", re.I)
    for text in documents.values():
        lines = text.splitlines()
        for i, line in enumerate(lines):
            if name.search(line):
                return " ".join(x.strip() for x in lines[i : i + 2])[:280].strip()
    return None


class Store:
    """Open sessions by id; those idle for too long go."""

    def __init__(self, seconds: float = SIX_HOURS):
        self.seconds, self._open = seconds, {}

    def add(self, session: Session) -> str:
        key = P.run_id()
        self._open[key] = (time.monotonic(), session)
        return key

    def get(self, key: str) -> Session:
        now = time.monotonic()
        self._open = {k: v for k, v in self._open.items() if now - v[0] < self.seconds}
        _, session = self._open[key]
        self._open[key] = (now, session)
        return session


__all__ = ["Session", "Store", "Status", "describe"]
