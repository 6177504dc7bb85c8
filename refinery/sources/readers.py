"""Readers by file name, with one notion of missing cells."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..session import shared_folder

SUPPORTED = {".csv", ".tsv", ".xlsx", ".xls", ".sav", ".dta", ".sas7bdat", ".parquet", ".json"}
DOCUMENTS = {".md", ".txt", ".rst", ".pdf", ".docx"}


def suffix(path: str) -> str:
    return PurePosixPath(path.rstrip("/")).suffix.lower()


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """A table from a file or folder of any supported kind; of an archive the file ``wanted``, or the likeliest."""
    kind = suffix(path)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    if kind == ".zip":
        return load(spark, table_in(expand_zip(path, spark=spark), wanted))
    if kind not in SUPPORTED:
        raise ValueError(f"Unsupported file extension: {kind}")
    if kind in (".csv", ".tsv"):
        return read_text(spark, path, "," if kind == ".csv" else "\t")
    if kind == ".parquet":
        return X.blank_nan(spark.read.parquet(path))
    if kind == ".json":
        return X.blank_nan(read_json(spark, path))
    return X.blank_nan(_small(spark, path, kind))


def _head(spark: SparkSession, path: str, n: int) -> bytes:
    """The first bytes of the first file."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).collect()
    if not files:
        return b""
    p = spark._jvm.org.apache.hadoop.fs.Path(files[0].path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


#: Lines that are not UTF-8 and are looked at to tell their encoding.
ODD_LINES = 1000


def guess_encoding(lines: list[bytes]) -> str:
    """The single-byte encoding of lines that are not UTF-8, by an optional detector, else by the bytes that occur."""
    joined = b"\n".join(lines)
    try:
        import chardet

        found = chardet.detect(joined[: 1 << 16]).get("encoding")
        if found and found.lower() not in ("ascii", "utf-8"):
            return found
    except ImportError:
        pass
    used = set(joined)
    # Windows-1252 has letters and marks where Latin-1 has controls, but for five codes
    return "windows-1252" if used & set(range(0x80, 0xA0)) and not used & {0x81, 0x8D, 0x8F, 0x90, 0x9D} else "ISO-8859-1"


def sniff(spark: SparkSession, path: str) -> tuple[str, bool]:
    """The encoding of delimited text, and whether quoted cells hold line breaks; every line is looked at, in one scan.

    A byte order mark decides at once. All lines valid: UTF-8. Else the lines that are not tell.
    """
    head = _head(spark, path, 4)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "UTF-16", True
    lines = spark.read.text(path)
    size = lambda c: F.octet_length(c)
    quotes = size(F.col("value")) - size(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    valid, broken = lines.agg(F.coalesce(F.bool_and(F.is_valid_utf8("value")), F.lit(True)), F.count_if(quotes % 2 == 1)).first()
    if valid:
        return "UTF-8", broken > 0
    odd = lines.filter(~F.is_valid_utf8("value")).select(F.col("value").cast("binary").alias("value")).limit(ODD_LINES).collect()
    return guess_encoding([bytes(r.value) for r in odd]), broken > 0


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON as records, one a line or in an array; or as an object of columns (by row name, or as lists), of desk size."""
    lines = [r.value.strip() for r in spark.read.text(path).limit(2).collect()]
    if len(lines) == 2 and lines[0].startswith("{") and lines[0].endswith("}") and lines[1].startswith("{"):
        return spark.read.json(path)  # a record a line: files can be split
    df = spark.read.json(path, multiLine=True)
    kinds = {f.dataType.typeName() for f in df.schema.fields}
    if lines and lines[0].startswith("{") and kinds and kinds <= {"struct", "array"} and df.limit(2).count() == 1:
        import io

        import pandas as pd

        frame = pd.read_json(io.StringIO(spark.read.text(path, wholetext=True).first()[0]))
        return spark.createDataFrame(frame.astype(object).where(frame.notna(), None))
    return df


def read_text(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited text, every cell a string, with the usual tokens for missing.

    Files can be split unless quoted cells hold line breaks.
    """
    encoding, broken = sniff(spark, path)
    known = encoding.upper() in ENCODINGS
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", broken).option("encoding", encoding if known else "ISO-8859-1")
    raw = reader.option("header", False).option("inferSchema", False).csv(path)
    head = reader.option("header", True).option("inferSchema", False).csv(path)
    if len(set(map(str.lower, head.columns))) == len(head.columns):
        df = head
    else:  # names that differ in case only, or not at all, are parted by position
        first = raw.first()
        names: list[str] = []
        for n in first:
            k, new = 0, n or "_"
            while new in names:
                k += 1
                new = f"{n}.{k}"
            names.append(new)
        df = head.toDF(*names)
    if not known:  # another single-byte encoding: each byte was read as the character of its number
        table = byte_characters(encoding)
        new = "".join(table[c] for c in table)
        df = df.select(*(F.translate(X.named(c), "".join(table), new).alias(c.translate(str.maketrans(table))) for c in df.columns))
    return df.select(*(X.without_tokens(X.named(c), X.NA_TOKENS, exact=True).alias(c) for c in df.columns))


#: Encodings that Spark's reader knows.
ENCODINGS = {"ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32", "UTF-8"}


def byte_characters(encoding: str) -> dict[str, str]:
    """Latin-1's characters of the upper bytes, and those of a single-byte encoding."""
    try:
        found = {chr(b): bytes([b]).decode(encoding, "replace") for b in range(0x80, 0x100)}
    except LookupError:
        raise ValueError(f"encoding {encoding}: unknown") from None
    if sum(c == "\ufffd" for c in found.values()) > 64:
        raise ValueError(f"encoding {encoding}: not of single bytes; save the file as UTF-8")
    return {a: b for a, b in found.items() if a != b}


def _small(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Formats of desk-sized files, read by the driver with optional libraries; a remote file is fetched first."""
    import pandas as pd

    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.getScheme() == "file":
        path = p.toUri().getPath()
    else:
        fetched = f"{tempfile.mkdtemp(prefix='refinery-')}/{p.getName()}"
        files.copyToLocalFile(False, p, spark._jvm.org.apache.hadoop.fs.Path(f"file://{fetched}"))
        path = fetched
    if kind in (".xlsx", ".xls"):
        frame = pd.read_excel(path)
    elif kind == ".dta":
        frame = pd.read_stata(path, convert_categoricals=False)
    else:
        import pyreadstat

        frame = (pyreadstat.read_sav if kind == ".sav" else pyreadstat.read_sas7bdat)(path)[0]
    return spark.createDataFrame(frame.where(frame.notna(), None))


def classify_files(paths: list[str]) -> dict[str, list[str]]:
    """Paths by what they hold: tables, documentation, companion files."""
    out: dict[str, list[str]] = {"tabular": [], "documentation": [], "companion": []}
    for p in paths:
        out["tabular" if suffix(p) in SUPPORTED else "documentation" if suffix(p) in DOCUMENTS else "companion"].append(p)
    return out


#: Parts of file names that show a folder of training data.
TRAINING_NAMES = ("train", "dose", "target", "label")


def expand_zip(path: str, folder: str | None = None, spark: SparkSession | None = None) -> list[str]:
    """Files of an archive; entries that would leave the folder are skipped, a bad archive stays as it is.

    With a session and no folder they go to the folder that executors share.
    """
    local = path.removeprefix("file://")
    if not zipfile.is_zipfile(local):
        return [path]
    target = f"{shared_folder(spark)}/zip-{uuid.uuid4().hex}" if spark is not None and folder is None else None
    folder = folder or tempfile.mkdtemp(prefix="refinery-zip-")
    out = []
    with zipfile.ZipFile(local) as z:
        for name in z.namelist():
            parts = PurePosixPath(name).parts
            if name.endswith("/") or name.startswith(("/", "\\")) or ".." in parts or "\\" in name:
                continue
            got = z.extract(name, folder)
            if target:
                p = spark._jvm.org.apache.hadoop.fs.Path
                p(target).getFileSystem(spark._jsc.hadoopConfiguration()).copyFromLocalFile(True, p(f"file://{got}"), p(f"{target}/{name}"))
                got = f"{target}/{name}"
            out.append(got)
    return sorted(out)


def table_in(paths: list[str], wanted: str | None = None) -> str:
    """The table of an archive: the file of that name, else a CSV, rather one that lies beside files of training data."""
    named = [p for p in paths if wanted and PurePosixPath(p).name == wanted]
    some = named or [p for p in paths if suffix(p) == ".csv"]
    if not some:
        raise FileNotFoundError("no CSV in the archive")

    def beside(p: str) -> bool:
        names = [PurePosixPath(q).name.lower() for q in paths if PurePosixPath(q).parent == PurePosixPath(p).parent]
        return any(w in n for n in names for w in TRAINING_NAMES)

    return min(some, key=lambda p: (not beside(p), p))


def document_text(spark: SparkSession, path: str) -> str:
    """The text of a document; what cannot be read is named in its place."""
    kind = suffix(path)
    try:
        if kind == ".pdf":
            from pypdf import PdfReader

            return "\n".join(page.extract_text() or "" for page in PdfReader(path).pages)
        if kind == ".docx":
            from docx import Document

            return "\n".join(p.text for p in Document(path).paragraphs)
        return spark.read.text(path, wholetext=True).first()[0]
    except Exception as e:  # a document is optional
        return f"[{os.path.basename(path)}: {type(e).__name__}]"
