"""Readers of the input tables and their views as points, units and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of a second, an hour and a day.
SECOND, HOUR, DAY = 1_000_000, 3_600_000_000, 86_400_000_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    days = F.unix_date(ts.cast("date"))
    seconds = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long")
    return days * F.lit(DAY) + seconds * F.lit(SECOND) + (F.extract(F.lit("SECOND"), ts) * SECOND).cast("long")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """The point process of ``events``: point_id, unit, mark, t (microseconds) and value; rows without unit or time drop out."""
    events = table(spark, folder, "events").where("user_id IS NOT NULL AND ts IS NOT NULL")
    return events.select(F.col("event_id").alias("point_id"), F.col("user_id").alias("unit"), F.col("event_type").alias("mark"), micros(F.col("ts")).alias("t"), "value")


def segments(spark: SparkSession, folder: str) -> DataFrame:
    """``embeddings`` as sampled segments: unit, grp and samples (array of double)."""
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("unit"), F.col("label").alias("grp"), F.col("embedding").cast("array<double>").alias("samples"))


def with_missing(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """``df`` with a typed null for each wanted column that it lacks: optional columns are settled when the plan is built."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in df.columns})


def any_flag(df: DataFrame, candidates: list[str]) -> Column:
    """Whether any of the candidate columns that ``df`` has is true (true, 1, yes); a null is not."""
    told = [F.coalesce(F.lower(F.col(c).cast("string")).isin("true", "1", "1.0", "yes", "t", "y"), F.lit(False)) for c in candidates if c in df.columns]
    return F.greatest(*told, F.lit(False)) if told else F.lit(False)


def numbered_columns(names: list[str], prefix: str) -> list[str]:
    """Columns ``prefix`` + number, in the order of their numbers; a gap in the numbers is an error."""
    found = sorted((int(n[len(prefix) :]), n) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())
    numbers = [k for k, _ in found]
    if numbers and numbers != list(range(numbers[0], numbers[0] + len(numbers))):
        raise ValueError(f"columns {prefix}* have gaps: {numbers}")
    return [n for _, n in found]


def wide_to_samples(df: DataFrame, prefix: str) -> DataFrame:
    """A table with one column per sample as one with an array; text that is no number becomes null."""
    names = numbered_columns(df.columns, prefix)
    return df.select(*[c for c in df.columns if c not in names], F.array(*[F.col(n).try_cast("double") for n in names]).alias("samples"))


def chunked_range(chunks: DataFrame, start: int, end: int) -> DataFrame:
    """Samples [start, end) of signals stored in rows (key columns, i0, samples): the chunks that overlap, each cut to the range."""
    n = F.size("samples")
    low, high = F.greatest(F.lit(start) - F.col("i0"), F.lit(0)), F.least(F.lit(end) - F.col("i0"), n)
    return chunks.where((F.col("i0") < end) & (F.col("i0") + n > start)).withColumns({"samples": F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")), "i0": F.col("i0") + low})
