"""Results stored partition by partition, so that a run computes only what no earlier run has finished.

A result has a folder for its name and parameters. In it, ``data`` holds the rows, partitioned by the keys, and ``manifest`` lists the
partitions that are finished, with the number of their rows. A partition counts when it is on the manifest, which is written after its
rows: what a failed run leaves behind is not seen, and the next run writes over it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _same(keys: list[str], one: DataFrame, two: DataFrame) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & one[k].eqNullSafe(two[k])
    return out


@dataclass
class PartitionStore:
    """The stored result ``name`` for exactly these ``parameters`` under ``folder``, with rows of ``schema``, by its columns ``keys``."""

    spark: SparkSession
    folder: str
    name: str
    parameters: dict
    schema: StructType
    keys: list[str]

    @property
    def path(self) -> str:
        told = json.dumps({"parameters": self.parameters, "columns": self.schema.simpleString(), "keys": self.keys}, sort_keys=True, default=str)
        return f"{self.folder.rstrip('/')}/{self.name}-{hashlib.sha256(told.encode()).hexdigest()[:16]}"

    def _key_schema(self) -> StructType:
        return StructType([self.schema[k] for k in self.keys])

    def _read(self, part: str, schema: StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException:  # nothing is stored yet
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """(keys, n): the finished partitions and the rows that each has."""
        listed = self._read("manifest", StructType([*self._key_schema(), *StructType().add("n", "long")]))
        return listed.groupBy(*self.keys).agg(F.max("n").alias("n"))

    def missing(self, wanted: DataFrame) -> DataFrame:
        """The distinct keys of ``wanted`` that are not finished."""
        keys, done = wanted.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys]).distinct(), self.manifest()
        return keys.join(done, _same(self.keys, keys, done), "left_anti")

    def rows(self) -> DataFrame:
        """The rows of all finished partitions."""
        data, done = self._read("data", self.schema), self.manifest().select(*self.keys)
        return data.join(done, _same(self.keys, data, done), "left_semi").select(*self.schema.names)

    def completed(self, wanted: DataFrame, make: Callable[[DataFrame], DataFrame], lots: int = 1) -> DataFrame:
        """The rows of the partitions ``wanted``, where ``make`` gives those of the partitions that are missing.

        ``make`` takes the missing keys and gives rows of the store's schema; it should read no more than these need. They are made in
        ``lots``, by a hash of the keys, and each lot is on the manifest when it is written, so an interrupted run keeps the lots before.
        Rows of other partitions than those asked for are dropped. A partition without rows is finished too.
        """
        keys = wanted.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys]).distinct()
        todo = self.missing(keys).withColumn("_lot", F.pmod(F.xxhash64(*self.keys), F.lit(lots)))
        todo.write.mode("overwrite").parquet(f"{self.path}/todo")  # the manifest changes while the lots are made
        todo = self._read("todo", todo.schema)
        for lot in range(lots):
            some = todo.where(F.col("_lot") == lot).drop("_lot")
            if some.isEmpty():
                continue
            made = make(some).select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.schema.names])
            made = made.join(some, _same(self.keys, made, some), "left_semi")
            made.repartition(*self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.keys).parquet(f"{self.path}/data")
            data = self._read("data", self.schema)
            counts = data.join(some, _same(self.keys, data, some), "left_semi").groupBy(*self.keys).agg(F.count(F.lit(1)).alias("_n"))
            listed = some.join(counts, _same(self.keys, some, counts), "left").select(*[some[k] for k in self.keys], F.coalesce("_n", F.lit(0)).alias("n"))
            listed.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        found = self.rows()
        return found.join(keys, _same(self.keys, found, keys), "left_semi")
