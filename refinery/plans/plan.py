"""Cleaning plans: the ordered, fitted steps of a run; their JSON form; replay and verification."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import steps
from ..operators.steps import ROW, Step
from ..sources.readers import load


@dataclass
class Plan:
    steps: list[Step] = field(default_factory=list)
    source: str | None = None
    target: str | None = None

    def add(self, one: Step, stage: str = "", card_id: str = "", action: str = "") -> None:
        self.steps.append(one | {"stage": stage, "card_id": card_id, "action": action})

    def to_json(self) -> str:
        return json.dumps({"version": 1, "source": self.source, "target": self.target, "steps": self.steps}, indent=2, default=str, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Plan:
        found = json.loads(text)
        return cls(found["steps"], found.get("source"), found.get("target"))

    def apply(self, df: DataFrame, rows: bool = True) -> DataFrame:
        """The plan on any table of these columns, with the numbers that were fitted.

        Without ``rows``, steps that drop rows for being duplicates are left out: on rows kept apart for
        testing, and on streams, each row stands by itself.
        """
        for one in self.steps:
            if rows or one["op"] not in ("keep_first", "drop_copies", "keep_one"):
                df = steps.run(df, one)
        return df


def replay(spark: SparkSession, plan: Plan, source: DataFrame | str | None = None) -> DataFrame:
    """The clean table again, from the plan and the source alone."""
    df = source if isinstance(source, DataFrame) else load(spark, source or plan.source)
    return plan.apply(steps.with_row_ids(X.blank_nan(df))).drop(ROW)


def script(plan: Plan) -> str:
    """A program that replays the plan."""
    return f'''"""Replays a cleaning plan: python clean_script.py [SOURCE [OUT]]"""

import sys

from refinery.plans.plan import Plan, replay
from refinery.session import build

PLAN = Plan.from_json(r"""
{plan.to_json().replace('"""', "")}
""")

if __name__ == "__main__":
    spark = build("replay")
    out = replay(spark, PLAN, sys.argv[1] if len(sys.argv) > 1 else None)
    out.write.mode("overwrite").parquet(sys.argv[2] if len(sys.argv) > 2 else "clean.parquet")
'''


def verify(a: DataFrame, b: DataFrame, digits: int = 6, ignore: Iterable[str] = ()) -> dict[str, Any]:
    """Whether two tables hold the same rows in any order: shared columns, doubles rounded, counted both ways."""
    shared = [c for c in a.columns if c in b.columns and c not in ignore and c != ROW]

    def plain(df: DataFrame, sign: int) -> DataFrame:
        made = []
        for c in shared:
            kind = df.schema[c].dataType
            made.append((F.bround(X.named(c).cast("double"), digits) if X.is_numeric(kind) else X.named(c).cast("string")).cast("string").alias(c))
        return df.select(*made, F.lit(sign).alias("_sign"))

    both = plain(a, 1).unionByName(plain(b, -1))
    uneven = both.groupBy(*map(X.named, shared)).agg(F.sum("_sign").alias("_n")).filter("_n != 0")  # one shuffle for both directions
    only_a, only_b = uneven.agg(F.coalesce(F.sum(F.when(F.col("_n") > 0, F.col("_n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_n") < 0, -F.col("_n"))), F.lit(0))).first()
    out = {"columns": shared, "only_in_session": sorted(set(a.columns) - set(b.columns) - {ROW}), "only_in_replay": sorted(set(b.columns) - set(a.columns) - {ROW})}
    return out | {"rows_only_in_session": only_a, "rows_only_in_replay": only_b, "equal": only_a == 0 and only_b == 0}


def verify_by_key(a: DataFrame, b: DataFrame, key: str, rtol: float = 0.03, atol: float = 1e-4) -> bool:
    """Whether tables with a unique key agree: numbers within a tolerance, all else equal, missing equal to missing."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    r = b.select(X.named(key).alias("_key"), *(X.named(c).alias(f"_r{i}") for i, c in enumerate(shared)))
    wrong = F.col("_key").isNull() | X.named(key).isNull()
    for i, c in enumerate(shared):
        x, y = X.named(c), F.col(f"_r{i}")
        if X.is_numeric(a.schema[c].dataType) and X.is_numeric(b.schema[c].dataType):
            x, y = x.cast("double"), y.cast("double")
            wrong = wrong | (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > F.lit(atol) + F.lit(rtol) * F.abs(y), F.lit(False))
        else:
            wrong = wrong | ~x.cast("string").eqNullSafe(y.cast("string"))
    return a.join(r, X.named(key).eqNullSafe(F.col("_key")), "full").filter(wrong).limit(1).count() == 0
