"""Writers of clean tables and of the artifacts beside them."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators.steps import ROW
from .readers import suffix


#: Fixed value: rows of a sheet below its head.
EXCEL_ROWS = 1_048_575


def save_clean(df: DataFrame, original: str | None, folder: str, name: str = "clean", single: bool = False) -> dict[str, str]:
    """Writes CSV and Parquet, and the original's format if it has a writer; folders of part files.

    ``single`` makes one CSV part: for small results only.
    """
    df = df.drop(ROW)
    out = {}
    text = df.select(*(X.named(f.name).cast("string").alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else X.named(f.name) for f in df.schema.fields))
    kinds = ["csv", "parquet"]
    own = suffix(original or "").lstrip(".")
    if own in ("tsv", "json"):
        kinds.append(own)
    if own in ("xlsx", "xls"):
        if df.limit(EXCEL_ROWS + 1).count() > EXCEL_ROWS:
            raise ValueError(f"a sheet holds {EXCEL_ROWS} rows")
        os.makedirs(folder, exist_ok=True)
        out["xlsx"] = f"{folder}/{name}.xlsx"
        df.toPandas().to_excel(out["xlsx"], index=False)  # a bounded number of rows, and an optional library
    for kind in kinds:
        path = f"{folder}/{name}.{kind}"
        if kind in ("csv", "tsv"):
            (text.coalesce(1) if single else text).write.mode("overwrite").option("header", True).option("sep", "," if kind == "csv" else "\t").option("escape", '"').csv(path)
        else:
            df.write.mode("overwrite").format(kind).save(path)
        out[kind] = path
    return out


def label_codes(df: DataFrame, column: str, new: str = "label") -> DataFrame:
    """Codes of the sorted distinct values, numbered by ranges, -1 for missing."""
    from ..operators.intake import numbered

    kinds = df.select(X.named(column).alias("_value")).filter("_value is not null").distinct()
    codes = numbered(kinds, ["_value"]).select("_value", F.col("_pos").cast("int").alias("_code"))
    return df.join(codes, X.named(column) == F.col("_value"), "left").withColumn(new, F.coalesce("_code", F.lit(-1))).drop("_value", "_code")


def export_dataset(df: DataFrame, path: str, target: str | None = None, image: str | None = None) -> DataFrame:
    """Parquet for training: features, ``label`` codes of the target, the image's path as ``image``; returns what was written.

    Columns that only connect rows with files go; text that is all numbers becomes numbers.
    """
    from ..operators.companions import FILE_KINDS

    df = df.drop(ROW)
    if image and image in df.columns:
        df = df.withColumnRenamed(image, "image")
    df = df.drop("companion_path", "has_companion", *(f"{k}_path" for k in FILE_KINDS), *(f"has_{k}" for k in FILE_KINDS))
    if target and target in df.columns:
        df = label_codes(df, target).drop(target)
    texts = [f.name for f in df.schema.fields if X.is_text(f.dataType) and f.name != "image"]
    if texts:
        lost = df.agg(*(F.count_if(X.named(c).isNotNull() & X.to_number(X.named(c)).isNull()).alias(f"l{i}") for i, c in enumerate(texts)), *(F.count(X.named(c)).alias(f"n{i}") for i, c in enumerate(texts))).first()
        df = df.withColumns({c: X.to_number(X.named(c)) for i, c in enumerate(texts) if lost[f"n{i}"] and not lost[f"l{i}"]})
    df.write.mode("overwrite").parquet(path)
    return df


def zip_folder(folder: str, path: str | None = None) -> str:
    """One archive of all artifacts of a run, for download."""
    import zipfile

    folder, path = folder.rstrip("/"), path or folder.rstrip("/") + ".zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in sorted(os.walk(folder)):
            for n in sorted(names):
                if not n.startswith((".", "_")):
                    z.write(f"{base}/{n}", os.path.relpath(f"{base}/{n}", folder))
    return path


def write_json(value: Any, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, default=str, ensure_ascii=False)
    return path


def requirements(folder: str) -> list[str]:
    """requirements.txt and environment.yml of a replay."""
    import pyspark

    lines = [f"pyspark=={pyspark.__version__}", "pandas", "pyarrow", "numpy"]
    os.makedirs(folder, exist_ok=True)
    paths = [f"{folder}/requirements.txt", f"{folder}/environment.yml"]
    with open(paths[0], "w") as f:
        f.write("\n".join(lines) + "\n")
    with open(paths[1], "w") as f:
        f.write("name: refinery\ndependencies:\n  - python>=3.11\n  - pip\n  - pip:\n" + "".join(f"      - {x}\n" for x in lines))
    return paths
