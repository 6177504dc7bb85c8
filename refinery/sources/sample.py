"""A small dirty table, made by rule, to try a session on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 400


def sample(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """People with gaps, tokens, blanks, spellings, outliers, copies and dates as text; always the same."""
    i = F.col("id")
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    text = lambda c: c.cast("string")
    base = spark.range(0, rows, 1, 1)
    made = base.select(
        F.format_string("P%04d", i).alias("Person ID"),
        F.when(i % 17 == 0, "?").otherwise(F.concat(F.lit(" "), text(20 + (i * 7) % 60))).alias("Age (years)"),
        F.when(i % 5 == 0, F.upper(pick("north", "south", "east"))).otherwise(pick("north", "south", "east")).alias("Region"),
        F.when(i % 23 == 0, None).when(i == 77, "999999").otherwise(text(1500 + (i * 131) % 2600)).alias("Income"),
        pick("yes", "No", "yes", "YES").alias("Member"),
        F.date_format(F.date_add(F.lit("2021-01-01").cast("date"), ((i * 13) % 900).cast("int")), "yyyy-MM-dd").alias("Joined"),
        F.when((i * 31) % 7 < 3, "high").otherwise("low").alias("Outcome"),
    )
    return made.unionByName(made.filter("`Person ID` in ('P0003', 'P0010')"))
