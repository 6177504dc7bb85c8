"""Queries opN_<name> of the training-data operators, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extract, lm_score, token_counts, toxicity
from .common import WORD, checkpoint, held_out, shared_folder, table
from .decontam import contaminated
from .langid import identify, train
from .mix import mix
from .shard import shard_by_bytes
from .simhash import near_duplicates
from .topk import top_k

#: Folder of public vocabularies, and the token pattern of the one used.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: how this vocabulary's texts are split before merging.
BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), least=0.8, radius=11)


def op2_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as of quality, as far as labels may be learnt from; background: all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return lm_score.score(docs, labels.filter((F.col("quality") == 1) & ~held_out()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep=["held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op10_token_rollup(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The life of a ledger: two tokenizer versions come, one count is revised, one version goes.

    Estimates are inserted for all documents and revised to exact counts; an
    older version is inserted and deleted again, document by document; batches
    are committed twice; the ledger is compacted. What stays is exact.
    """
    docs = table(spark, sf_dir, "documents")
    with open(f"{tokenizers}/byte_bpe_50k.tiktoken", "rb") as f:
        counter = token_counts.bpe(f.read(), BPE_PATTERN)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    plain = docs.select(
        "source",
        "lang",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
        F.coalesce(F.ceil(F.length("text") / 4), F.lit(0)).cast("long").alias("guess"),
        size.alias("bytes"),
    )
    plain = checkpoint(plain)
    version = lambda name, tokens: plain.select("source", "lang", F.lit(name).alias("tokenizer"), F.col(tokens).alias("tokens"), "bytes")
    exact = checkpoint(token_counts.count_tokens(docs, counter, "byte_bpe_50k-1"))
    ledger = token_counts.Rollup(spark, f"{shared_folder(spark)}/token-ledger-{uuid.uuid4().hex}")
    ledger.commit("1-insert-words", token_counts.inserted(version("words-1", "words")))
    ledger.commit("2-insert-guess", token_counts.inserted(version("byte_bpe_50k-1", "guess")))
    ledger.commit("3-insert-old", token_counts.inserted(version("byte_bpe_50k-0", "guess")))
    revision = token_counts.revised(version("byte_bpe_50k-1", "guess"), exact)
    ledger.commit("4-revise", revision)
    ledger.compact("5-compacted")
    ledger.commit("4-revise", revision)  # again: no change
    ledger.commit("6-delete-old", token_counts.deleted(version("byte_bpe_50k-0", "guess")))
    out = checkpoint(ledger.totals())
    ledger.drop()
    return out


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_extract_text,
        op3_simhash_dedup,
        op4_lm_score,
        op5_toxicity,
        op6_topk_search,
        op7_shard_documents,
        op8_mix_sources,
        op9_identify_language,
        op10_token_rollup,
    )
}
#: The others have no SQL form (trained models, xxHash64, tree and partition heuristics); tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_topk_search": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT DISTINCT vec_id, q FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT a.vec_id AS query_id, a.q, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, q ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op8_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, 1 + place % 3 AS w, CAST(3 * source_size AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (
  SELECT *, (total - (sum(cap) OVER (ORDER BY cap / w, place ROWS UNBOUNDED PRECEDING) - cap))
    / sum(w) OVER (ORDER BY cap / w, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, place, total, round(least(cap, w * coalesce((SELECT arg_min(level, cap / w) FROM l WHERE cap / w > level), 1e300)), 6) AS target FROM l),
q AS (
  SELECT d.doc_id, size, source_size, target, total, place, CAST(sum(size) OVER (PARTITION BY place ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT doc_id, size, place, upto, total, CAST(e * source_size + upto AS DOUBLE) / target AS finish FROM q, range(3) r(e) WHERE size > 0 AND target > 0),
k AS (SELECT *, sum(size) OVER (ORDER BY finish, place, upto ROWS UNBOUNDED PRECEDING) AS run FROM c),
m AS (SELECT doc_id, place, upto, CAST(sum(size) AS BIGINT) AS taken FROM k WHERE run <= total GROUP BY ALL)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken
FROM q LEFT JOIN m ON q.doc_id = m.doc_id AND q.place = m.place AND q.upto = m.upto""",
}
