"""Corpus preparation: stages over ``documents``, each written and read again by the next.

A document that language ID cannot place goes, one document of each group of
near-duplicates stays, documents that hold a benchmark item go, the mix takes
documents (and repeats of them) up to its targets, and what it took is dealt
into shards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refinery.llm import decontam, langid, mix, shard, simhash
from refinery.llm.common import held_out, shared_folder, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of unknown language: those without a letter. Mixed languages are no reason to go."""
    return langid.keep_identified(docs, langid.train(docs.filter(~held_out())))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; five-word shingles, similarity 0.8 or more."""
    return simhash.keep_first(docs, shingle=5, least=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those it does not take go."""
    return mix.take(docs)


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row: the list from which shards are written."""
    return shard.shard_by_bytes(docs, shards=24)


STAGES = [
    ("language ID", identify),
    ("near-duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard_documents),
]
#: Fingerprints, models and differencing have no SQL form; tests hold the rows against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's folder goes when the next one is written, the last one's stays."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            files.delete(path(f"{folder}/{k - 1}"), True)
    return docs
