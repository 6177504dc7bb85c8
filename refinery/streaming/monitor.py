"""Extension: fitted plans and quality counts on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..plans.plan import Plan


def zoned(df: DataFrame, time: str) -> DataFrame:
    """Event time as a moment of the session's zone, which watermarks ask for."""
    return df.withColumn(time, X.named(time).cast("timestamp"))


def clean_stream(stream: DataFrame, plan: Plan, key: list[str] | None = None, time: str | None = None, late: str = "10 minutes") -> DataFrame:
    """A stream cleaned by a fitted plan; copies within the lateness go, if a key is given."""
    out = plan.apply(X.blank_nan(stream), rows=False)
    if key and time:
        out = zoned(out, time).withWatermark(time, late).dropDuplicatesWithinWatermark(key)
    return out


def quality(stream: DataFrame, time: str, columns: list[str], window: str = "1 hour", late: str | None = "10 minutes") -> DataFrame:
    """Rows and missing cells of each column by window of event time; on tables as on streams.

    ``late`` is None for a stream that has its watermark already.
    """
    marked = zoned(stream, time).withWatermark(time, late) if stream.isStreaming and late else stream
    counts = [F.count_if(X.named(c).isNull()).alias(f"missing_{c}") for c in columns]
    found = marked.groupBy(F.window(time, window)).agg(F.count(F.lit(1)).alias("rows"), *counts)
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rows", *(f"missing_{c}" for c in columns))
