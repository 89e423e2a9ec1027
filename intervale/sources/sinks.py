"""Writers: tables, label tables as CSV, and results that are computed once per set of parameters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """``columns`` of ``df`` (those it has) as CSV with a header."""
    (df.select(*[c for c in columns if c in df.columns]) if columns else df).write.mode("overwrite").option("header", True).csv(path)


def save_json(df: DataFrame, path: str) -> None:
    """Rows of ``df`` as JSON, one a line, with their nested columns and without null fields."""
    df.write.mode("overwrite").json(path)


def save_if_any(df: DataFrame, path: str) -> bool:
    """Write ``df`` as Parquet unless it has no row."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def with_provenance(df: DataFrame, **facts: object) -> DataFrame:
    """``df`` with a JSON column that says how it was made."""
    return df.withColumn("provenance", F.lit(json.dumps(facts, sort_keys=True, default=str)))


def materialised(spark: SparkSession, folder: str, name: str, parameters: dict, make: Callable[[], DataFrame], required: tuple[str, ...] = ()) -> DataFrame:
    """The stored result for exactly these parameters, made and stored if there is none or it lacks a required column."""
    key = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder}/{name}-{key}"
    try:
        found = spark.read.parquet(path)
        if set(required) <= set(found.columns):
            return found
    except AnalysisException:
        pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
