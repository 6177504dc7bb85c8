"""Token counts kept by deltas.

A rollup has totals of documents, tokens and bytes by source, language and
tokenizer version. It is never recounted: each change of a document is a
signed delta (insert +new, delete -old, revise -old +new), a batch of changes
is summed per group and written once under the batch's id, and the totals are
the sum of all batches. A batch id that is there already is left alone, so a
batch can be committed again after any failure. Its rows are written to a
folder of that attempt and named by one atomic rename, so readers see whole
batches or none. ``compact`` sums batches into one without changing totals.

The ledger is in a folder that the driver and all executors share.

Defined results: a null text has 0 tokens and 0 bytes; null sources and
languages are groups of their own; groups whose documents, tokens and bytes
are all zero are left out of the totals; repeated rows count as often as they
come; an empty batch commits and changes nothing; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tune

GROUP = ["source", "lang", "tokenizer"]
SUMS = ["docs", "tokens", "bytes"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, bytes long"
#: Texts are encoded in pieces of some such length, cut where no token crosses.
PIECE = 1 << 16


def bpe(ranks: bytes, pattern: str) -> Callable[[], Callable[[str], int]]:
    """Makes counters of a byte-level BPE from a file's lines of base64 token and rank.

    The file is read once, by the driver, and sent along: executors need not have it.
    """

    def make() -> Callable[[str], int]:
        import tiktoken

        table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line.strip())}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        return lambda text: sum(len(encode(p)) for p in pieces(text))

    return make


#: A blank after a letter and before a letter starts a token of every pattern here.
_SEAM = re.compile(r"(?<=[A-Za-z])(?= [A-Za-z])")


def pieces(text: str) -> Iterator[str]:
    """The text cut at blanks between letters, since one very long run is slow to encode whole."""
    at = 0
    while len(text) - at > PIECE:
        seam = _SEAM.search(text, at + PIECE)
        if seam is None:
            break
        yield text[at : seam.start()]
        at = seam.start()
    yield text[at:]


def count_tokens(docs: DataFrame, make: Callable[[], Callable[[str], int]], tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens, bytes of every row of ``docs``."""
    tune(docs.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        for b in batches:
            texts = b.column(3).to_pylist()
            tokens = pa.array([count(t) if t else 0 for t in texts], pa.int64())
            size = pa.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([tokenizer] * b.num_rows, pa.string()), tokens, size], ["doc_id", "source", "lang", "tokenizer", "tokens", "bytes"])

    kinds = dict(docs.dtypes)
    schema = f"doc_id {kinds['doc_id']}, source {kinds['source']}, lang {kinds['lang']}, tokenizer string, tokens long, bytes long"
    return docs.select("doc_id", "source", "lang", "text").mapInArrow(run, schema)


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).cast("long").alias("docs"), "tokens", "bytes")


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"), (-F.col("bytes")).alias("bytes"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts out, new counts in; a document may change its group as well."""
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """The ledger of committed batches in one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.folder}/batches"))

    def _batch(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9-]+", batch_id):
            raise ValueError(f"batch id {batch_id!r}: letters, digits and - only")
        return f"{self.folder}/batches/{batch_id}"

    def _write(self, batch_id: str, rows: DataFrame, covers: list[str]) -> None:
        """Writes a folder of this attempt, names the batches that it replaces, and renames it into place."""
        attempt = f"{self.folder}/attempts/{batch_id}-{uuid.uuid4().hex}"
        rows.write.parquet(attempt)
        if covers:
            out = self._fs.create(self._path(f"{attempt}/_covers"))
            out.write("\n".join(covers).encode())
            out.close()
        if not self._fs.rename(self._path(attempt), self._path(self._batch(batch_id))):
            self._fs.delete(self._path(attempt), True)
        # beside another writer of the same batch, a rename may move this attempt inside the other's folder
        self._fs.delete(self._path(f"{self._batch(batch_id)}/{attempt.rsplit('/', 1)[1]}"), True)

    def _covered(self) -> set[str]:
        """Ids whose rows a compacted batch holds."""
        out: set[str] = set()
        for n in self._listed():
            mark = self._path(f"{self._batch(n)}/_covers")  # Spark's readers skip names that begin so
            if self._fs.exists(mark):
                held = self._fs.open(mark)
                out.update(bytes(held.readAllBytes()).decode().split("\n"))
                held.close()
        return out

    def _listed(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/batches")))

    def batches(self) -> list[str]:
        """Ids whose folders make up the totals."""
        return sorted(set(self._listed()) - self._covered())

    def committed(self, batch_id: str) -> bool:
        """True if the batch counts in the totals, by itself or in a compacted one."""
        return self._fs.exists(self._path(self._batch(batch_id))) or batch_id in self._covered()

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds a batch of signed deltas; False, and nothing read, if it is there already."""
        if self.committed(batch_id):
            return False
        self._write(batch_id, deltas.groupBy(*GROUP).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS)), [])
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens, bytes over all committed batches."""
        paths = [self._batch(n) for n in self.batches()]
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        summed = rows.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in SUMS))
        return summed.filter((F.col("docs") != 0) | (F.col("tokens") != 0) | (F.col("bytes") != 0))

    def compact(self, batch_id: str) -> bool:
        """Sums all batches into one, which replaces them from its rename on; their ids stay known."""
        names = self.batches()
        if not names or self.committed(batch_id):
            return False
        self._write(batch_id, self.totals(), sorted({*names, *self._covered()}))
        covered = self._covered()
        for n in self._listed():  # and what a compaction that was cut off here has left
            if n in covered:
                self._fs.delete(self._path(self._batch(n)), True)
        return True

    def drop(self) -> None:
        self._fs.delete(self._path(self.folder), True)
