"""Joins whose frequent keys are spread over many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: All rows are thought of as cut into so many parts; a key with more rows than a part is spread. At most PARTS keys can be such.
PARTS = 2000
#: Rows that are never spread.
LEAST = 50


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """(keys, _parts) of the keys whose count ``n`` is above a PARTS-th of all; None if there is none.

    They are PARTS rows at most, so the driver holds them, and they can be broadcast.
    """
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    part = max(LEAST, -(-(total or 0) // PARTS))
    if (most or 0) <= part:
        return None
    hot = counts.where(F.col(n) > part).select(*keys, F.ceil(F.col(n) / F.lit(part)).cast("int").alias("_parts"))
    return counts.sparkSession.createDataFrame(hot.collect(), hot.schema)


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (one row a key), the rows of a ``hot`` key spread by a hash of the columns ``by``.

    Such a key's row of ``table`` is copied for each of its parts; the copies of all hot keys are 2 * PARTS rows at most.
    """
    if hot is None:
        return rows.join(table, keys, how)
    hot = F.broadcast(hot)
    placed = rows.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
    copies = table.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return placed.join(copies, [*keys, "_part"], how).drop("_part")
