"""Shared pieces of the training-data operators.

Texts are handled a batch at a time: the UTF-8 bytes of a whole Arrow batch
are one numpy array, and words, hashes and windows are found by array
arithmetic over it, so no Python runs per word.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = b" \t\n\x0b\x0c\r"
#: Java and RE2 pattern of one word of the size contracts.
WORD = r"[^\x20\x09-\x0D]+"


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds what one Arrow batch holds, since texts vary widely in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder.

    ``spark.checkpoint.dir`` names that folder. Only where it is unset and the
    master is local (as in tests) a temporary folder is used.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    set_to = sc._jsc.sc().getCheckpointDir()
    if set_to.isDefined():
        return set_to.get()
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="refinery-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """True for rows that no model may learn labels from; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def batch_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a batch as one byte array, and the n + 1 offsets into it."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def portions(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many bytes of text, or of one row, so that what is made from a slice stays small."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def prefix_for(columns: list[str]) -> str:
    """A beginning that no column's name has, for columns added on the way."""
    out = "_r"
    while any(c.lower().startswith(out) for c in columns):
        out += "_"
    return out + "_"


def byte_table(is_word) -> np.ndarray:
    return np.fromiter((is_word(b) for b in range(256)), bool, 256)


#: Letters, digits and every byte of a non-ASCII character; ``inside_words`` takes punctuation out again.
WORD_BYTES = byte_table(lambda b: b >= 128 or chr(b).isalnum())

#: Ranges of code points beyond ASCII that are blanks, punctuation or signs.
BETWEEN = [
    (0x0080, 0x00A9),
    (0x00AB, 0x00B4),
    (0x00B6, 0x00B9),
    (0x00BB, 0x00BF),
    (0x00D7, 0x00D7),
    (0x00F7, 0x00F7),
    (0x2000, 0x206F),
    (0x20A0, 0x20CF),
    (0x2190, 0x245F),
    (0x2E00, 0x2E7F),
    (0x3000, 0x3004),
    (0x3008, 0x3020),
    (0x3030, 0x3030),
    (0xFF01, 0xFF0F),
    (0xFF1A, 0xFF20),
    (0xFF3B, 0xFF40),
    (0xFF5B, 0xFF65),
]


def _between_table() -> np.ndarray:
    out = np.zeros(1 << 16, bool)
    for low, high in BETWEEN:
        out[low : high + 1] = True
    return out


_BETWEEN = _between_table()
_LEADS = np.zeros(256, bool)
for _low, _high in BETWEEN:
    _LEADS[chr(_low).encode()[0] : chr(_high).encode()[0] + 1] = True


def inside_words(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each byte of UTF-8 texts is inside a word: by ``table``, but for punctuation beyond ASCII."""
    ok = table[raw]
    lead = np.flatnonzero(_LEADS[raw])
    if len(lead):
        a, b, c = np.pad(raw, (0, 2))[lead[:, None] + np.arange(3)].astype(np.int32).T
        wide = a >= 0xE0
        point = np.where(wide, (a & 15) << 12 | (b & 63) << 6 | c & 63, (a & 31) << 6 | b & 63)
        out = _BETWEEN[point]
        at = lead[out]
        ok[at] = ok[at + 1] = False
        ok[lead[out & wide] + 2] = False
    return ok


def spans(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each maximal run of bytes inside words (table ``inside``); runs end with their text."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    ok = inside_words(raw, inside)
    first = np.zeros(len(raw) + 1, bool)
    first[offs] = True
    first = first[:-1]
    begin = ok.copy()
    begin[1:] &= ~ok[:-1] | first[1:]
    starts = np.flatnonzero(begin)
    stop = ok.copy()
    stop[:-1] &= ~ok[1:] | first[1:]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = max(n + n // 4, 1 << 16)
        out = np.full(size, base, np.uint64)
        out[0] = 1
        if size > 4_000_000:  # not worth keeping for one very long text
            return np.multiply.accumulate(out)[:n]
        have = _POWERS[kind] = np.multiply.accumulate(out)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit (splitmix64's)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span: equal bytes, equal hash, wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, len(raw)), out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(raw) + 1)[starts])


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; n - k + 1 of them, none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + h[i : i + n]
    return mix64(out)


#: Ids that are sent to tasks with their marks (9 bytes each); more are joined.
MOST_SENT = 2_000_000


class Marks:
    """Small whole numbers by doc_id, for rows of documents, -1 where there is none.

    ``rows`` has doc_id, text and mark. Whole-number ids that are few (counted first) go to the tasks as
    they are, so no text is shuffled, and ``fill`` sets their marks there; others are joined.
    """

    def __init__(self, docs: DataFrame, marks: DataFrame):
        """marks: doc_id and mark, an id once only."""
        self.sent: tuple[np.ndarray, np.ndarray] | None = None
        whole = {"tinyint", "smallint", "int", "bigint"}
        marks = marks.select("doc_id", F.col("mark").cast("tinyint").alias("mark")).filter(F.col("doc_id").isNotNull())
        if {dict(docs.dtypes)["doc_id"], dict(marks.dtypes)["doc_id"]} <= whole and marks.limit(MOST_SENT + 1).count() <= MOST_SENT:
            got = marks.toArrow()
            ids = got.column(0).to_numpy().astype(np.int64)
            order = np.argsort(ids)
            self.sent = ids[order], got.column(1).to_numpy()[order]
            self.rows = docs.select("doc_id", "text", F.lit(-1).cast("tinyint").alias("mark"))
        else:
            joined = docs.select("doc_id", "text").join(marks.hint("shuffle_hash"), "doc_id", "left")
            self.rows = joined.select("doc_id", "text", F.coalesce("mark", F.lit(-1).cast("tinyint")).alias("mark"))

    @staticmethod
    def fill(sent: tuple[np.ndarray, np.ndarray] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of ``rows`` (and more columns, if any) with their marks."""
        for b in batches:
            if sent is not None:
                ids, marks = sent
                got = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                out = np.full(len(got), -1, np.int8)
                if len(ids):
                    at = np.minimum(np.searchsorted(ids, got), len(ids) - 1)
                    there = (ids[at] == got) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
                    out[there] = marks[at[there]]
                b = pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out), *b.columns[3:]], b.schema.names)
            yield b


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Collects a table whose size is checked first; a larger one is an error, never cut."""
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{what}: more than {most} rows")
    return df.collect()
