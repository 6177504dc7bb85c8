"""Intake of several tables: roles, joins in which missing keys match, and stacking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import StrEnum
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..session import checkpoint
from . import steps


class Role(StrEnum):
    PRIMARY = "primary_data"
    TARGET = "target"
    HOLD_OUT = "hold_out"
    TEMPLATE = "template"
    COMPANION = "companion"


#: Parts of file names that mark a template.
TEMPLATE_NAMES = ("submission", "template", "sample_sub", "readme")


@dataclass
class Proposal:
    roles: dict[str, Role]
    keys: list[str] = field(default_factory=list)
    na_values: list[str] = field(default_factory=list)
    key_map: dict[str, dict[str, str]] = field(default_factory=dict)


@dataclass
class Intake:
    table: DataFrame
    hold_out: DataFrame | None
    notes: list[str]


def join_keys(keys: Sequence[str] | str | None) -> list[str]:
    """Keys from a list, a text with commas, or nothing."""
    parts = keys.split(",") if isinstance(keys, str) else list(keys or [])
    return [k.strip() for k in parts if k and k.strip()]


def propose(tables: dict[str, DataFrame], planner: Callable[[dict[str, DataFrame]], Proposal] | None = None) -> Proposal:
    """Roles by size, names and columns; the planner, if given, may name them instead."""
    if planner is not None:
        said = planner(tables)
        roles = {n: r for n, r in said.roles.items() if n in tables}
        for n in tables:
            roles.setdefault(n, Role.PRIMARY)
        return Proposal(roles, said.keys, said.na_values, said.key_map)
    rows = {n: t.count() for n, t in tables.items()}
    first = max(rows, key=lambda n: (rows[n], -list(rows).index(n)))
    main = set(tables[first].columns)
    roles = {}
    for n, t in tables.items():
        if n == first:
            roles[n] = Role.PRIMARY
        elif any(w in n.lower() for w in TEMPLATE_NAMES):
            roles[n] = Role.TEMPLATE
        elif set(t.columns) == main:
            roles[n] = Role.HOLD_OUT
        elif len(t.columns) <= 3:
            roles[n] = Role.TARGET
        else:
            roles[n] = Role.PRIMARY
    return Proposal(roles)


def left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join in which missing keys match; several matches give several rows."""
    r = right.select(*(X.named(c).alias(f"_r{i}") for i, c in enumerate(right.columns)))
    at = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    on = reduce(lambda a, b: a & b, (X.named(k).eqNullSafe(F.col(at[k])) for k in keys))
    added = [F.col(at[c]).alias(c) for c in right.columns if c not in keys and c not in left.columns]
    return left.join(r, on, "left").select(*map(X.named, left.columns), *added)


def full_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join in which missing keys match, keys merged."""
    r = right.select(*(X.named(c).alias(f"_r{i}") for i, c in enumerate(right.columns)), F.lit(True).alias("_right"))
    at = {c: f"_r{i}" for i, c in enumerate(right.columns)}
    on = reduce(lambda a, b: a & b, (X.named(k).eqNullSafe(F.col(at[k])) for k in keys))
    mine = [F.coalesce(X.named(c), F.col(at[c])).alias(c) if c in keys else X.named(c) for c in left.columns]
    added = [F.col(at[c]).alias(c) for c in right.columns if c not in left.columns]
    return left.join(r, on, "full").select(*mine, *added)


def outer_merge(tables: Sequence[DataFrame], keys: Sequence[str] | str | None = None) -> DataFrame:
    """Full outer join of all tables, in turn, on the keys and all columns that they share."""
    named = join_keys(keys)

    def both(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [*[k for k in named if k in a.columns and k in b.columns], *[c for c in a.columns if c in b.columns and c not in named]]
        return full_join(a, b, shared) if shared else stack([a, b])

    return reduce(both, tables)


def numbered(df: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Adds consecutive positions from 0 without bringing all rows into one task.

    Rows are ranged by their order; each range is counted, and positions are the range's start plus the
    place in it.
    """
    from pyspark.sql import Window

    by = list(map(X.named, order or []))
    if not by:
        df = steps.with_row_ids(df, "_seen")
        df, by = df.withColumn("_range", F.shiftright("_seen", 33)), [F.col("_seen")]
    else:
        df = df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id().cast("long"))
    held = checkpoint(df)  # ranges must not change between counting and numbering
    counts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    place = Window.partitionBy("_range").orderBy(*by)
    out = held.withColumn("_place", F.row_number().over(place) - 1).join(F.broadcast(starts), "_range")  # a row a partition
    return out.withColumn("_pos", F.col("_start") + F.col("_place")).drop("_range", "_start", "_place", "_seen")


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str] | None = None, right_order: Sequence[str] | None = None) -> DataFrame:
    """Puts the columns of a table of as many rows beside another's, by position."""
    a, b = numbered(left, left_order), numbered(right, right_order)
    r = b.select("_pos", *(X.named(c).alias(f"_r{i}") for i, c in enumerate(right.columns)))
    added = [F.col(f"_r{i}").alias(c) for i, c in enumerate(right.columns) if c not in left.columns]
    return a.join(r, "_pos").select(*map(X.named, left.columns), *added)


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def stack_tagged(tables: dict[str, DataFrame], tag: str = "source_file") -> DataFrame:
    return stack([t.withColumn(tag, F.lit(n)) for n, t in tables.items()])


def join_right(left: DataFrame, right: DataFrame, name: str, keys: Sequence[str] | str | None = None, key_map: dict[str, str] | None = None) -> tuple[DataFrame, str]:
    """Adds a table the way that its columns allow, and says how."""
    for own, canonical in (key_map or {}).items():
        if own in right.columns and canonical not in right.columns:
            right = right.withColumnRenamed(own, canonical)
    if set(left.columns) == set(right.columns):
        return left.unionByName(right), f"{name}: stacked"
    shared = [c for c in left.columns if c in right.columns]
    wanted = list(dict.fromkeys([*join_keys(keys), *shared]))
    if wanted and all(k in right.columns and k in left.columns for k in wanted):
        return left_join(left, right, wanted), f"{name}: joined on {', '.join(wanted)}"
    if shared:
        return left_join(left, right, shared), f"{name}: joined on shared columns {', '.join(shared)}"
    if left.count() == right.count():
        return positional_join(left, right), f"{name}: joined by position"
    return left, f"{name}: nothing to join on, left out"


def confirm(tables: dict[str, DataFrame], proposal: Proposal) -> Intake:
    """One table from all, by their roles; hold-outs stay apart."""
    codes = proposal.na_values
    clean = {n: steps.run(t, {"op": "missing_codes", "codes": codes}) if codes else t for n, t in tables.items()}
    of = lambda role: [n for n in clean if proposal.roles.get(n) == role]
    primary = of(Role.PRIMARY)
    if not primary:
        raise ValueError("no table has the role of primary data")
    out, notes = clean[primary[0]], []
    for n in [*primary[1:], *of(Role.TARGET)]:
        out, note = join_right(out, clean[n], n, proposal.keys, proposal.key_map.get(n))
        notes.append(note)
    held = of(Role.HOLD_OUT)
    return Intake(out, stack([clean[n] for n in held]) if held else None, notes)


def ingest(tables: dict[str, DataFrame]) -> Intake:
    return confirm(tables, propose(tables))


@dataclass
class Staged:
    """Tables that were read, with proposed roles; more than one table waits to be confirmed."""

    tables: dict[str, DataFrame]
    proposal: Proposal
    confirmed: Intake | None = None

    @property
    def needs_confirmation(self) -> bool:
        return self.confirmed is None and len(self.tables) > 1

    def confirm(self, roles: dict[str, Role | str] | None = None, **changes: object) -> Intake:
        """Settles roles (and keys, key_map, na_values) as given, the rest as proposed."""
        for name, role in (roles or {}).items():
            if name not in self.tables:
                raise KeyError(name)
            self.proposal.roles[name] = Role(role)
        for what, value in changes.items():
            setattr(self.proposal, what, value)
        self.confirmed = confirm(self.tables, self.proposal)
        return self.confirmed


def staged(tables: dict[str, DataFrame]) -> Staged:
    """Proposes roles; one table by itself is settled at once."""
    out = Staged(tables, propose(tables))
    if len(tables) == 1:
        out.confirm()
    return out
