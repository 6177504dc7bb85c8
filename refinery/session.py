"""The Spark session that the library expects: UTC, adaptive execution, ANSI left on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "refinery", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    sc = spark.sparkContext
    set_to = sc._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get()
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="refinery-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Written once to the shared folder and read from there: the same rows in every later job, whatever executors are lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
