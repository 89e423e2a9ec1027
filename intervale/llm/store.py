"""Tables written between the phases of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set and all work is on one machine."""
    folder = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="intervale-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


#: What bounds the rows that a task reads from Parquet at once, and the bytes that it hands to Python at once.
BATCHES = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxBytesPerBatch")


@contextmanager
def small_batches(spark: SparkSession, rows: int, most: int) -> Iterator[None]:
    """Jobs that run inside read at most ``rows`` rows of Parquet at once and hand about ``most`` bytes at once to Python.

    By default these are 4,096 and 10,000 rows of any size, so that a task with rows of megabytes holds all of them several times over.
    """
    before = {name: spark.conf.get(name, None) for name in BATCHES}
    try:
        for name, value in zip(BATCHES, (rows, most), strict=True):
            spark.conf.set(name, str(value))
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written once as Parquet and read back: its lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/intervale-{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._intervale_path = path
    return out


def numbered(df: DataFrame) -> DataFrame:
    """``df`` written once with _row, a number of its own for each row, null and repeated ids or not."""
    return written(df.withColumn("_row", F.monotonically_increasing_id()), "rows", compression="zstd")


def dropped(df: DataFrame | None) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    path = getattr(df, "_intervale_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
