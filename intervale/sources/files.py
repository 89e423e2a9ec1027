"""Lists of session files by subject and session, and reading of the tables that many of them hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Subject and session in a path: sub-<subject> and, where there is one, ses-<session>.
SUBJECT, SESSION = r"(?:^|/)sub-([^/_]+)[/_]", r"(?:^|[/_])ses-([^/_.]+)"


def session_files(spark: SparkSession, folder: str, pattern: str = "*", subject: str | None = None, session: str | None = None, most: int | None = None) -> DataFrame:
    """(path, length, subject, session) of the files under ``folder`` whose name fits ``pattern``, by path.

    ``subject`` must be met exactly, ``session`` as a part of the path; ``most`` keeps the first so many. Only the files' listing is read.
    A folder without such files gives no rows.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    named = lambda rule: F.nullif(F.regexp_extract("path", rule, 1), F.lit(""))
    found = listed.select("path", "length", named(SUBJECT).alias("subject"), named(SESSION).alias("session"))
    if subject is not None:
        found = found.where(F.col("subject") == subject)
    if session is not None:
        found = found.where(F.contains("path", F.lit(session)))
    ordered = found.orderBy("path")
    return ordered.limit(most) if most is not None else ordered


def session_tables(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet") -> DataFrame:
    """The rows of all files under ``folder`` that fit ``pattern``, with subject and session from their paths; unreadable files are skipped.

    Filters and columns that are asked for later reach the scan.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true")
    path = F.input_file_name()
    return reader.parquet(folder).withColumns({"subject": F.nullif(F.regexp_extract(path, SUBJECT, 1), F.lit("")), "session": F.nullif(F.regexp_extract(path, SESSION, 1), F.lit(""))})
