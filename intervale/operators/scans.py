"""Ranks, running sums and values of earlier or later rows, by scans in two levels.

Rows are dealt out by ranges of their keys and order, so that a key with most of the rows, or no key at all, is spread over many parts.
A window runs inside each (keys, part); what a part hands on to the next ones is one row, and a second window runs over these few rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What can be scanned for: "rank" counts from 1; "sum", "min" and "max" run up to the row itself, "suffix_min" from it to the end; "last"
#: is the last non-null value up to the row, "before" the last non-null one ahead of it, "lag" the value of the row ahead of it.
KINDS = ("rank", "sum", "min", "max", "suffix_min", "last", "before", "lag")


def dealt(df: DataFrame, keys: list[str], order: list[str], save: Callable[[DataFrame], DataFrame], parts: int | None = None) -> DataFrame:
    """``df`` written with ``_part``: rows of a key whose ``order`` is greater are in the same part or a later one.

    ``order`` should tell the rows of a key apart; rows that it does not are in one part, in any sequence. ``parts`` defaults to the
    session's number of shuffle partitions.
    """
    by = [*keys, *order]
    placed = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    return save(placed.withColumn("_part", F.spark_partition_id()))


def _inside(kind: str, value: Column | None, here: Window) -> Column:
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    if kind == "rank":
        return F.row_number().over(here).cast("long")
    if kind == "lag":
        return F.lag(F.struct(value.alias("v"))).over(here)
    if kind == "last":
        return F.last(value, ignorenulls=True).over(upto)
    if kind == "before":
        return F.last(value, ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1))
    if kind == "suffix_min":
        return F.min(value).over(here.rowsBetween(0, Window.unboundedFollowing))
    return {"sum": F.sum, "min": F.min, "max": F.max}[kind](value).over(upto)


def _handed_on(kind: str, value: Column | None, place: Column) -> Column:
    if kind == "rank":
        return F.count(F.lit(1))
    if kind == "lag":
        return F.max_by(F.struct(value.alias("v")), place)
    if kind in ("last", "before"):
        return F.max_by(value, F.when(value.isNotNull(), place))
    return {"sum": F.sum, "min": F.min, "max": F.max, "suffix_min": F.min}[kind](value)


def _carried(kind: str, total: str, over: Window) -> Column:
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    if kind == "lag":
        return F.lag(total).over(over)
    if kind in ("last", "before"):
        return F.last(total, ignorenulls=True).over(earlier)
    if kind == "suffix_min":
        return F.min(total).over(over.rowsBetween(1, Window.unboundedFollowing))
    return {"rank": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[kind](total).over(earlier)


def _met(kind: str, own: Column, carry: Column) -> Column:
    if kind == "rank":
        return own + F.coalesce(carry, F.lit(0))
    if kind == "sum":
        return F.coalesce(own + carry, own, carry)
    if kind == "lag":
        return F.when(own.isNotNull(), own).otherwise(carry)["v"]
    if kind in ("last", "before"):
        return F.coalesce(own, carry)
    return F.greatest(own, carry) if kind == "max" else F.least(own, carry)


def scanned(placed: DataFrame, keys: list[str], order: list[str], wanted: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """``placed`` (of ``dealt``, for the same keys and order) with a column for each of ``wanted``: its name, kind and value.

    The columns are those that a window over the keys in this order gives. A null key is a key. More scans can follow on the result.
    """
    place = F.struct(*order)
    totals = placed.groupBy(*keys, "_part").agg(*[_handed_on(kind, value, place).alias(name) for name, (kind, value) in wanted.items()])
    over = Window.partitionBy(*keys).orderBy("_part")
    names = {name: f"_carry_{name}" for name in wanted}
    carry = totals.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_part").alias("_of_part"), *[_carried(kind, name, over).alias(names[name]) for name, (kind, _) in wanted.items()])
    same = F.col("_part") == F.col("_of_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    here = Window.partitionBy(*keys, "_part").orderBy(*order)
    joined = placed.join(carry, same)
    found = joined.withColumns({name: _inside(kind, value, here) for name, (kind, value) in wanted.items()})
    return found.select(*[c for c in placed.columns if c not in wanted], *[_met(kind, F.col(name), F.col(names[name])).alias(name) for name, (kind, _) in wanted.items()])
