"""The audit report and the flow of rows, from a finished run."""

from __future__ import annotations

from typing import Any

from ..operators.profile import Profile
from .cards import Stage
from .wording import label


def number(x: float | int | None) -> str:
    if x is None:
        return "—"
    return f"{x:,.0f}" if abs(x) >= 1000 else f"{x:.2f}" if abs(x) >= 1 else f"{x:.4f}"


def flow(state: Any) -> list[dict[str, Any]]:
    """Steps of the flow of rows: the stages that changed something, with what they took out."""
    quiet = {"profile", "format", "binning", "scaling", "encoding"}
    out = []
    for r in state.rows:
        if r.stage in quiet and r.rows_in == r.rows_out and r.cols_in == r.cols_out:
            continue
        cards = [c for c in state.log if c.stage == r.stage and c.action_taken in ("drop_rows", "drop_variable", "remove_all_duplicates", "drop_all_duplicate_rows")]
        rows = [c.variable or "all columns" for c in cards if c.action_taken != "drop_variable"][:5]
        columns = [c.variable for c in cards if c.action_taken == "drop_variable"][:4]
        out.append({"stage": r.stage, "rows_in": r.rows_in, "rows_out": r.rows_out, "cols_in": r.cols_in, "cols_out": r.cols_out, "removed": r.rows_removed, "rows_by": rows, "columns": columns})
    return out


def flow_svg(state: Any) -> str:
    """The flow as a drawing: a box a stage, and beside it what left there."""
    boxes, y = [], 20
    escape = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;")
    for f in flow(state):
        boxes.append(f'<rect x="20" y="{y}" width="260" height="50" fill="none" stroke="black"/><text x="30" y="{y + 20}">{escape(f["stage"])}</text><text x="30" y="{y + 40}">{f["rows_out"]:,} rows, {f["cols_out"]} columns</text>')
        if f["removed"] or f["columns"]:
            why = ", ".join([*f["rows_by"], *(f"-{c}" for c in f["columns"])])
            boxes.append(f'<rect x="320" y="{y}" width="300" height="50" fill="none" stroke="black"/><text x="330" y="{y + 20}">{f["removed"]:,} rows out</text><text x="330" y="{y + 40}">{escape(why)}</text>')
        y += 80
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="640" height="{y}" font-family="sans-serif" font-size="14">{"".join(boxes)}</svg>'


def _table(head: list[str], rows: list[list[Any]]) -> str:
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows])


def _share(card: Any) -> str:
    m = card.metadata
    return f"{m['n_missing']:,} cells ({m['missing_rate']:.1%})" if "n_missing" in m else ""


def narratives(state: Any) -> list[tuple[str, str, list[str]]]:
    """(title, summary, details) of each stage that found something."""
    out = []
    went = {r.stage: r for r in state.rows}
    for stage in Stage:
        cards = [c for c in state.log.by_stage(stage) if c.action_taken not in (None, "continue")]
        if not cards:
            continue
        r = went.get(str(stage))
        bits, details = [], []
        if stage == Stage.FORMAT:
            kinds = {"renamed": "names were put into one style", "stripped": "had white space at the ends of cells", "converted": "held tokens for missing", "coerced": "were stored as something else", "normalized": "spelled labels in several ways"}
            for action, text in kinds.items():
                some = [c for c in cards if c.action_taken == action]
                n = len(some[0].metadata.get("renames", some)) if action == "renamed" and some else len(some)
                if some:
                    bits.append(f"{n} columns {text}")
        elif stage == Stage.COMPANION:
            m = cards[0].metadata
            bits.append(f"{m.get('n_matched', 0):,} rows have a file, {m.get('n_unmatched', 0):,} have none, {m.get('n_orphans', 0):,} files have no row")
        elif r and r.rows_removed:
            bits.append(f"{r.rows_removed:,} rows left")
        if r and r.cols_removed:
            bits.append(f"{r.cols_removed} columns left")
        if r and r.cols_out > r.cols_in:
            bits.append(f"{r.cols_out - r.cols_in} columns were added")
        for c in cards if stage != Stage.FORMAT else cards[:20]:
            extra = _share(c) or c.issue
            chosen = " (chosen by hand)" if str(c.status) == "overridden" else ""
            note = f"; note: {c.user_note}" if c.user_note else ""
            details.append(f"**{c.variable or 'table'}**: {extra} → {label(c.action_taken, stage)}{chosen}{note}")
        out.append((str(stage).capitalize(), ("; ".join(bits) or "No row or column left") + ".", details))
    return out


def variable_lines(p: Profile) -> list[str]:
    """What the final profile says about one column, in lines."""
    out = [f"{p.kind}, stored as {p.stored}; {p.n_unique:,} different values, {p.n_missing:,} missing ({p.missing_rate:.1%})"]
    if p.numbers:
        s = p.numbers
        out.append(f"mean {number(s.mean)}, SD {number(s.std)}; quartiles {number(s.q25)}, {number(s.median)}, {number(s.q75)}; from {number(s.min)} to {number(s.max)}")
    if p.top_values:
        out.append("most frequent: " + ", ".join(f"{v} ({n:,})" for v, n in p.top_values[:5]))
    if p.flags:
        out.append("flags: " + "; ".join(p.flags))
    return out


def methods(state: Any) -> str:
    """A paragraph for a methods section: what was decided, by whom, and how to do it again."""
    counts, rows = state.log.counts(), state.rows
    removed = sum(r.rows_removed for r in rows)
    filled = [c for c in state.log.by_stage(Stage.MISSINGNESS) if c.action_taken and c.action_taken.endswith("_impute")]
    parts = [f"The table was cleaned in {len(rows)} stages with {counts['total']} logged decisions, {counts['automated']} by rule, {counts['judged']} by judgement, {counts['overridden']} of these other than proposed."]
    parts.append(f"{rows[0].rows_in:,} rows were read, {removed:,} left, {rows[-1].rows_out:,} stayed, in {rows[-1].cols_out} columns.")
    if filled:
        ways = {}
        for c in filled:
            ways.setdefault(label(c.action_taken).lower(), []).append(c.variable)
        parts.append("Empty cells: " + "; ".join(f"{way} ({', '.join(v)})" for way, v in ways.items()) + ".")
    parts.append("All fitted numbers are in plan.json; clean_script.py does the same again from the source.")
    return " ".join(parts)


def markdown(state: Any) -> str:
    counts, rows = state.log.counts(), state.rows
    renames = next((c.metadata["renames"] for c in state.log if c.card_id == "format_column_names"), {})
    summary = [
        ["Rows", f"{rows[0].rows_in:,} → {rows[-1].rows_out:,}"],
        ["Columns", f"{rows[0].cols_in} → {rows[-1].cols_out}"],
        ["Decisions", counts["total"]],
        ["settled by the engine", counts["automated"]],
        ["settled by judgement", counts["judged"]],
        ["of these, not the default", counts["overridden"]],
        ["Target", state.target or "—"],
    ]
    parts = ["# Cleaning report", "## Summary", _table(["", ""], summary)]
    if state.notes:
        parts += ["## Intake", "\n".join(f"- {n}" for n in state.notes)]
    parts += ["## Flow", _table(["Stage", "Rows in", "Rows out", "Columns out"], [[f["stage"], f"{f['rows_in']:,}", f"{f['rows_out']:,}", f["cols_out"]] for f in flow(state)]), "## What changed"]
    for title, text, details in narratives(state):
        parts += [f"### {title}", text, "\n".join(f"- {d}" for d in details)]
    lines = []
    for old, p in state.first_profiles.items():
        new = renames.get(old, old)
        last: Profile | None = state.profiles.get(new)
        lines.append([old, new if last else "dropped", p.kind, last.kind if last else "—", f"{p.missing_rate:.1%}", f"{last.missing_rate:.1%}" if last else "—"])
    parts += ["## Variables", _table(["Read", "Name", "Type read", "Type", "Missing before", "Missing after"], lines), "## Final profile"]
    final = [[p.name, p.kind, p.n_unique, *(map(number, (p.numbers.mean, p.numbers.median, p.numbers.std, p.numbers.min, p.numbers.max)) if p.numbers else ["—"] * 5)] for p in state.profiles.values()]
    parts.append(_table(["Column", "Type", "Unique", "Mean", "Median", "SD", "Min", "Max"], final))
    parts.append("## Columns one by one")
    for p in state.profiles.values():
        parts += [f"### {p.name}", "\n".join(f"- {x}" for x in variable_lines(p))]
    return "\n\n".join([*parts, "## Methods", methods(state)]) + "\n"
