"""Fitted steps: every change to a table is one of these, with literal parameters.

A step is ``{"op": ..., **params}``; ``run`` applies it to any table that has
its columns, so fitting, replay on the source and use on other rows are the
same code, and nothing is fitted again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X

#: Order of rows as they were read, where the source has none of its own.
ROW = "_rid"
#: Entries of a value map up to which it is an expression; a larger one is joined.
SMALL_MAP = 500

Step = dict[str, Any]
_RUN: dict[str, Callable[..., DataFrame]] = {}


def step(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    _RUN[f.__name__] = f
    return f


def run(df: DataFrame, one: Step) -> DataFrame:
    """Applies a step; a step on a column that is not there, or by a key that is not there, changes nothing."""
    params = {k: v for k, v in one.items() if k not in ("op", "stage", "card_id", "action", "note")}
    needed = [*([params["column"]] if "column" in params else []), *params.get("keys", [])]
    if "order" in params:
        params["order"] = [c for c in params["order"] if c in df.columns] or [c for c in df.columns]
    if any(c not in df.columns for c in needed):
        return df
    return _RUN[one["op"]](df, **params)


#: Steps that take rows out.
ROW_STEPS = {"keep_first", "drop_copies", "keep_one", "drop_null_rows", "drop_outliers"}


def changed_by(one: Step, before: list[str], after: list[str]) -> set[str] | None:
    """Columns whose cells a step may have changed; None if rows went, or names."""
    if one["op"] in ROW_STEPS or one["op"] in ("rename", "missing_codes"):
        return None
    return ({c for c in (one.get("column"), one.get("new"), *one.get("targets", [])) if c in after} if one["op"] in _RUN else set()) | (set(after) - set(before))


def with_row_ids(df: DataFrame, name: str = ROW) -> DataFrame:
    """Marks the order of reading; ids rise but are not consecutive. A run checkpoints them before it relies on them twice."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def _put(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, value)


@step
def rename(df: DataFrame, names: list[str]) -> DataFrame:
    """All columns get new names by position, which also parts equal or case-equal names."""
    if sum(c != ROW for c in df.columns) != len(names):
        return df
    new = iter(names)
    return df.toDF(*(c if c == ROW else next(new) for c in df.columns))


@step
def strip(df: DataFrame, column: str) -> DataFrame:
    return _put(df, column, X.strip(X.named(column)))


@step
def missing_tokens(df: DataFrame, column: str, tokens: list[str]) -> DataFrame:
    return _put(df, column, X.without_tokens(X.named(column), tokens))


@step
def missing_codes(df: DataFrame, codes: list[str]) -> DataFrame:
    """Documented codes become null in every column, compared as trimmed, lower-cased text."""
    low = [c.strip().lower() for c in codes]
    return df.withColumns({c: X.without_tokens(X.named(c), low) for c in df.columns if c != ROW}) if low else df


@step
def to_number(df: DataFrame, column: str, integer: bool) -> DataFrame:
    x = X.to_number(X.named(column)) if X.is_text(df.schema[column].dataType) else X.named(column).cast("double")
    return _put(df, column, x.try_cast("long") if integer else x)


@step
def to_datetime(df: DataFrame, column: str, format: str) -> DataFrame:
    return _put(df, column, F.try_to_timestamp(X.strip(X.named(column)), F.lit(format)).cast("timestamp_ntz"))


@step
def to_boolean(df: DataFrame, column: str) -> DataFrame:
    return _put(df, column, X.to_boolean(X.named(column), df.schema[column].dataType))


@step
def map_labels(df: DataFrame, column: str, mapping: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """Spellings by a map, or by a table (_from, _to) that is joined."""
    if path is None and len(mapping or {}) <= SMALL_MAP:
        return _put(df, column, X.map_values(X.named(column), mapping or {}))
    spark = df.sparkSession
    table = spark.read.parquet(path) if path else spark.createDataFrame(list(mapping.items()), "_from string, _to string")
    joined = df.join(table, X.named(column) == F.col("_from"), "left")
    return joined.withColumn(column, F.coalesce("_to", X.named(column))).select(*map(X.named, df.columns))


@step
def keep_first(df: DataFrame, keys: list[str], order: Sequence[str] = (ROW,)) -> DataFrame:
    """The first row, by ``order``, of rows that agree in the keys; missing agrees with missing.

    The minimum combines before the shuffle, so a large group of copies is one row a task by then.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    first = F.min_by(F.struct(*map(X.named, rest)), F.struct(*map(X.named, order)))
    kept = df.groupBy(*map(X.named, keys)).agg(first.alias("_first"))
    return kept.select(*(X.named(c) if c in keys else F.col("_first")[c].alias(c) for c in df.columns))


@step
def drop_copies(df: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows that no other row equals in the keys.

    Counting the keys and joining the single ones back keeps a large group of copies from meeting in one task.
    """
    single = df.groupBy(*(X.named(k).alias(f"_k{i}") for i, k in enumerate(keys))).count().filter("count = 1")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & X.named(k).eqNullSafe(F.col(f"_k{i}"))
    return df.join(single, on, "left_semi")


@step
def keep_one(df: DataFrame, column: str, value: Any, last: bool, order: Sequence[str] = (ROW,)) -> DataFrame:
    """Of the rows with one key value only the first or last by ``order``; other rows stay."""
    mine = F.coalesce(X.named(column).cast("string") == str(value), F.lit(False))
    by = [X.named(c).desc() if last else X.named(c).asc() for c in order]
    return df.filter(~mine).unionByName(df.filter(mine).orderBy(*by).limit(1))


@step
def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(column)


@step
def drop_null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(X.named(column).isNotNull())


@step
def fill(df: DataFrame, column: str, value: Any) -> DataFrame:
    kind = df.schema[column].dataType
    if isinstance(value, float) and not value.is_integer() and X.is_numeric(kind):
        return _put(df, column, F.coalesce(X.named(column).cast("double"), F.lit(value)))
    return _put(df, column, F.coalesce(X.named(column), F.lit(value).cast(kind)))


@step
def indicator(df: DataFrame, column: str, new: str) -> DataFrame:
    return _put(df, new, X.named(column).isNull())


@step
def chained_fill(df: DataFrame, targets: list[str], starts: dict[str, float], rounds: list[dict[str, Any]]) -> DataFrame:
    """Replays chained regressions: missing cells start at the mean and take each fitted equation in turn."""
    names = list(starts)
    if any(n not in df.columns for n in names):
        return df
    state = {n: f"_m{i}" for i, n in enumerate(names)}
    out = df.withColumns({state[n]: F.coalesce(X.named(n).cast("double"), F.lit(starts[n])) for n in names})
    for equation in rounds:
        n = equation["column"]
        value = F.lit(equation["offset"])
        for other, weight in equation["weights"].items():
            value = value + F.lit(weight) * F.col(state[other])
        out = out.withColumn(state[n], F.when(X.named(n).isNull(), value).otherwise(F.col(state[n])))
    out = out.withColumns({n: F.when(X.named(n).isNull(), F.col(state[n])).otherwise(X.named(n).cast("double")) for n in targets})
    return out.drop(*state.values())


def flagged(column: str, low: float | None, high: float | None, mean: float, std: float, z: float, negative: bool) -> Column:
    """The outlier predicate from fitted numbers; never null."""
    x = X.named(column).cast("double")
    out = F.lit(False)
    if low is not None and high is not None:
        out = out | (x < low) | (x > high)
    if std and std > 0:
        out = out | (F.abs((x - mean) / std) > z)
    if negative:
        out = out | (x < 0)
    return F.coalesce(out, F.lit(False))


@step
def null_outliers(df: DataFrame, column: str, **fitted: Any) -> DataFrame:
    return _put(df, column, F.when(~flagged(column, **fitted), X.named(column)))


@step
def drop_outliers(df: DataFrame, column: str, **fitted: Any) -> DataFrame:
    return df.filter(~flagged(column, **fitted))


@step
def clip(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return _put(df, column, X.clip(X.named(column).cast("double"), low, high))


@step
def bin(df: DataFrame, column: str, edges: list[float], labels: list[str], new: str) -> DataFrame:
    return df.withColumn(new, X.right_closed_bin(X.named(column), edges, labels).alias(new, metadata={"labels": labels}))


@step
def shift_scale(df: DataFrame, column: str, center: float, scale: float, new: str) -> DataFrame:
    return _put(df, new, (X.named(column).cast("double") - F.lit(float(center))) / F.lit(float(scale)))


@step
def log_scale(df: DataFrame, column: str, new: str) -> DataFrame:
    x = X.named(column).cast("double")
    return _put(df, new, F.log1p(F.when(x < 0, F.lit(0.0)).otherwise(x)))


@step
def frequency(df: DataFrame, column: str, new: str, table: list[list[Any]] | None = None, path: str | None = None) -> DataFrame:
    """Relative frequency of the value where it was fitted; 0 for missing or unseen values."""
    spark = df.sparkSession
    found = spark.read.parquet(path) if path else spark.createDataFrame(table or [], "_value string, _share double")
    return lookup_share(df, column, new, found)


def lookup_share(df: DataFrame, column: str, new: str, found: DataFrame) -> DataFrame:
    """Joins ``_share`` by ``_value``; Spark sends the table to all tasks only if it is small enough."""
    joined = df.join(found, X.named(column).cast("string") == F.col("_value"), "left")
    keep = [X.named(c) for c in df.columns if c != new]
    return joined.select(*keep, F.coalesce("_share", F.lit(0.0)).alias(new))


@step
def datetime_parts(df: DataFrame, column: str, parts: list[str]) -> DataFrame:
    c = X.named(column)
    made = {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "dayofweek": F.weekday(c),
        "hour": F.hour(c),
        "is_weekend": (F.weekday(c) >= 5).cast("tinyint"),
    }
    return df.withColumns({f"{column}_{p}": made[p] for p in parts})
