"""The five columns that say most about the target of a cleaned table: python examples/importances.py clean.parquet target"""

from __future__ import annotations

import sys

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refinery.session import build


def importances(df: DataFrame, target: str, most: int = 5) -> list[tuple[str, float]]:
    numeric = [c for c, kind in df.dtypes if kind in ("bigint", "int", "double", "float", "boolean") and c != target]
    rows = df.select(F.col(target).cast("string").alias("target"), *(F.col(c).cast("double").alias(c) for c in numeric)).dropna()
    steps = [StringIndexer(inputCol="target", outputCol="label"), VectorAssembler(inputCols=numeric, outputCol="features"), RandomForestClassifier(seed=42, numTrees=20)]
    found = Pipeline(stages=steps).fit(rows).stages[-1].featureImportances
    return sorted(((c, float(found[i])) for i, c in enumerate(numeric)), key=lambda p: (-p[1], p[0]))[:most]


if __name__ == "__main__":
    spark = build("importances")
    for name, share in importances(spark.read.parquet(sys.argv[1]), sys.argv[2]):
        print(f"{name:30} {share:.3f}")
