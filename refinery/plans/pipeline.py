"""The whole cleaning run: profile, find, decide, fit, apply, stage by stage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions import columns as X
from ..operators import companions, duplicates, features, missing, outliers, steps
from ..operators.format import resolve_formats, snake_case
from ..operators.profile import Profile, profile, summary_card
from ..operators.steps import ROW, Step
from ..session import checkpoint
from ..sources import writers
from ..sources.readers import load
from .cards import Card, Decide, Log, Stage, Status, Thresholds
from .plan import Plan, replay, script, verify

#: Called with an event's name and what it carries.
Event = Callable[[str, dict[str, Any]], None]


@dataclass
class StageRows:
    """Rows and columns into and out of a stage."""

    stage: str
    rows_in: int
    cols_in: int
    rows_out: int
    cols_out: int

    @property
    def rows_removed(self) -> int:
        return max(self.rows_in - self.rows_out, 0)

    @property
    def cols_removed(self) -> int:
        return max(self.cols_in - self.cols_out, 0)


@dataclass
class State:
    df: DataFrame
    target: str | None = None
    source: str | None = None
    template: str | None = None
    companions: DataFrame | None = None
    profiles: dict[str, Profile] = field(default_factory=dict)
    first_profiles: dict[str, Profile] = field(default_factory=dict)
    log: Log = field(default_factory=Log)
    plan: Plan = field(default_factory=Plan)
    rows: list[StageRows] = field(default_factory=list)
    thresholds: Thresholds = field(default_factory=Thresholds)
    artifacts: str | None = None
    #: The table as it was read, and what the intake of several tables has to say.
    raw: DataFrame | None = None
    notes: list[str] = field(default_factory=list)
    #: Rows of the table, if they are known.
    n: int | None = None
    #: Columns whose profiles no longer hold, or None for all.
    stale: set[str] | None = None

    def names(self) -> list[str]:
        return [c for c in self.df.columns if c != ROW]

    def run(self, one: Step) -> None:
        """Applies a step, and notes what it may have changed."""
        before = self.names()
        self.df = steps.run(self.df, one)
        self.changed(steps.changed_by(one, before, self.names()), one["op"] in steps.ROW_STEPS)

    def changed(self, columns: set[str] | None, rows: bool) -> None:
        self.stale = None if columns is None or self.stale is None else self.stale | columns
        if rows:
            self.n = None

    def refresh(self) -> dict[str, Profile]:
        """Profiles of the table as it is; those of columns that have not changed are kept."""
        known = {} if self.stale is None else {c: p for c, p in self.profiles.items() if c not in self.stale}
        self.profiles, self.stale = profile(self.df, self.thresholds, known), set()
        if self.profiles:
            self.n = next(iter(self.profiles.values())).n_total
        return self.profiles

    def count(self) -> int:
        if self.n is None:
            self.n = self.df.count()
        return self.n

    def settle(self) -> None:
        """Cuts the lineage, so that no later scan does again what was done so far."""
        self.df = checkpoint(self.df)


def _fit(state: State, card: Card) -> list[Step]:
    path = f"{state.artifacts}/{card.card_id}.shares" if state.artifacts else None
    return {
        Stage.DUPLICATE: lambda: duplicates.fit(state.df, card),
        Stage.MISSINGNESS: lambda: missing.fit(state.df, card, state.thresholds),
        Stage.OUTLIER: lambda: outliers.fit(state.df, card),
        Stage.BINNING: lambda: features.fit_binning(state.df, card, state.thresholds),
        Stage.SCALING: lambda: features.fit_scaling(state.df, card),
        Stage.ENCODING: lambda: features.fit_encoding(state.df, card, path),
    }[card.stage]()


#: How the cards of a stage are found; a new stage is one more entry here and in ``_fit``.
DETECT: dict[Stage, Callable[[State], list[Card]]] = {
    Stage.DUPLICATE: lambda s: duplicates.detect(s.df, s.profiles, s.thresholds),
    Stage.MISSINGNESS: lambda s: missing.detect(s.df, s.profiles, s.thresholds),
    Stage.OUTLIER: lambda s: outliers.detect(s.df, s.profiles, s.thresholds),
    Stage.BINNING: lambda s: features.assess_binning(s.df, s.profiles, s.thresholds),
    Stage.SCALING: lambda s: features.assess_scaling(s.df, s.profiles, s.thresholds),
    Stage.ENCODING: lambda s: features.assess_encoding(s.df, s.profiles, s.thresholds),
}


def resolve(state: State, cards: list[Card], decide: Decide | None = None) -> None:
    """Settles each card, fits it on the table as it is by then, and applies it."""
    for card in cards:
        if card.status == Status.PENDING and decide is not None:
            decide(card)
        if card.status == Status.PENDING:
            card.resolve()
        state.log.add(card)
        if card.status in (Status.SKIPPED, Status.AGENT_AUTO) or (card.variable and card.variable not in state.df.columns):
            continue
        done = _fit(state, card)
        card.metadata.setdefault("applied_info", {})["n_steps"] = len(done)
        for one in done:
            state.run(one)
            state.plan.add(one, str(card.stage), card.card_id, card.action_taken or "")


def counted(state: State, stage: Stage, work: Callable[[], None]) -> None:
    """Does the work of a stage and notes its rows and columns; rows are counted again only where some may have gone."""
    n, before = state.rows[-1].rows_out if state.rows else state.count(), len(state.names())
    work()
    if state.n is None:
        state.settle()
    state.rows.append(StageRows(str(stage), n, before, state.count(), len(state.names())))


def run_stage(state: State, stage: Stage, decide: Decide | None = None) -> list[Card]:
    cards = DETECT[stage](state)
    counted(state, stage, lambda: resolve(state, cards, decide))
    return cards


def run_profile(state: State) -> None:
    state.refresh()
    state.first_profiles = state.first_profiles or state.profiles
    counted(state, Stage.PROFILE, lambda: state.log.add(summary_card(state.profiles)))


def run_companions(state: State, decide: Decide | None = None) -> None:
    def work() -> None:
        card = companions.detect(state.df, state.template, state.companions)
        if card.status == Status.PENDING:
            if decide is not None:
                decide(card)
            if card.status == Status.PENDING:
                card.resolve()
            before = state.df
            state.df = companions.apply(state.df, card, state.companions)
            if state.df is not before:
                state.changed(None, True)
        state.log.add(card)

    counted(state, Stage.COMPANION, work)


def run_format(state: State) -> None:
    def work() -> None:
        state.df, cards, done = resolve_formats(state.df, state.refresh(), state.thresholds, state.artifacts)
        names = [c for c in state.names()]
        for one in done:
            state.changed(steps.changed_by(one, names, names), False)
        state.log.extend(cards)
        for card, one in zip(cards, done, strict=True):
            state.plan.add(one, "format", card.card_id, card.action_taken or "")
            if one["op"] == "rename" and state.target:
                state.target = card.metadata["renames"].get(state.target, snake_case(state.target))
                state.plan.target = state.target

    counted(state, Stage.FORMAT, work)
    if len(state.log.by_stage(Stage.FORMAT)):
        state.settle()
    state.refresh()


def open_state(spark: SparkSession, source: str | DataFrame, target: str | None = None, **options: Any) -> State:
    df = source if isinstance(source, DataFrame) else load(spark, source)
    path = None if isinstance(source, DataFrame) else source
    # rows get their ids once: a table that is made again by a lost task could come in another order
    state = State(checkpoint(steps.with_row_ids(X.blank_nan(df))), target, path, **options)
    state.plan.source, state.plan.target, state.raw = path, target, state.df
    return state


def run_pipeline(
    spark: SparkSession, source: str | DataFrame, target: str | None = None, decide: Decide | None = None, on_event: Event | None = None, out: str | None = None, **options: Any
) -> State:
    """Profile, companions, format, duplicates, missingness, outliers, binning, scaling, encoding; then artifacts.

    Every stage is fitted on what the one before left. Profiles are taken anew of columns that changed, and of
    all where rows went; the table is checkpointed when it is read, when formats are settled and where rows went.
    """
    tell = on_event or (lambda name, carried: None)
    state = open_state(spark, source, target, artifacts=out, **options)
    tell("pipeline_start", {"source": state.source, "columns": len(state.names())})
    again = {Stage.DUPLICATE, Stage.MISSINGNESS, Stage.OUTLIER, Stage.BINNING, Stage.SCALING}
    work: list[tuple[Stage, Callable[[], Any]]] = [(Stage.PROFILE, lambda: run_profile(state)), (Stage.COMPANION, lambda: run_companions(state, decide)), (Stage.FORMAT, lambda: run_format(state))]
    work += [(s, lambda s=s: run_stage(state, s, decide)) for s in DETECT]
    for stage, go in work:
        go()
        if stage in again:
            state.refresh()
        tell("stage_done", {"stage": str(stage), "cards": len(state.log.by_stage(stage)), "rows": state.rows[-1].rows_out})
    state.refresh()
    written = write_all(state, out) if out else {}
    tell("pipeline_done", {"decisions": len(state.log), "artifacts": written})
    return state


def context(state: State) -> dict[str, Any]:
    """What one needs to know of a run to talk about it: columns, findings and decisions, no rows."""
    columns = [{"name": p.name, "type": str(p.kind), "missing_rate": round(p.missing_rate, 4), "n_unique": p.n_unique, "flags": p.flags} for p in state.profiles.values()]
    decisions = [{"card": c.card_id, "stage": str(c.stage), "variable": c.variable, "issue": c.issue, "action": c.action_taken, "status": str(c.status)} for c in state.log]
    return {"source": state.source, "target": state.target, "rows": state.count(), "columns": columns, "decisions": decisions, "stages": [vars(r) for r in state.rows]}


def run_id() -> str:
    return datetime.now(UTC).strftime("%Y%m%d-%H%M%S-") + uuid.uuid4().hex[:6]


def write_all(state: State, folder: str, skip: tuple[str, ...] = (), check: bool = True) -> dict[str, Any]:
    """All artifacts; a writer that fails is reported and the others go on."""
    from .pdf import pdf
    from .report import flow_svg, markdown

    os.makedirs(folder, exist_ok=True)
    done: dict[str, Any] = {"errors": {}}

    def text(name: str, content: str | bytes) -> str:
        with open(f"{folder}/{name}", "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
        return f"{folder}/{name}"

    plumbing = [c for card in state.log.by_stage(Stage.COMPANION) for c in companions.plumbing(card, state.names())]

    spark = state.df.sparkSession
    work: dict[str, Callable[[], Any]] = {
        "raw": lambda: writers.save_clean(state.raw, None, folder, "raw_intake"),
        "clean": lambda: writers.save_clean(state.df.drop(*plumbing), state.source, folder),
        "decisions": lambda: state.log.write(f"{folder}/decisions.json"),
        "profile": lambda: writers.write_json({k: v.to_dict() for k, v in state.profiles.items()}, f"{folder}/profile.json"),
        "plan": lambda: text("plan.json", state.plan.to_json()),
        "script": lambda: text("clean_script.py", script(state.plan)),
        "requirements": lambda: writers.requirements(folder),
        "flow": lambda: text("flow.svg", flow_svg(state)),
        "report": lambda: text("report.md", markdown(state)),
        "pdf": lambda: text("report.pdf", pdf(markdown(state))),
        "context": lambda: writers.write_json(context(state), f"{folder}/context.json"),
    }
    if check and state.source:
        work["verified"] = lambda: verify(state.df, replay(spark, state.plan, state.source))
    for name, go in work.items():
        if name not in skip:
            try:
                done[name] = go()
            except Exception as e:
                done["errors"][name] = f"{type(e).__name__}: {e}"
    return done
