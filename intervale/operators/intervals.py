"""Joins of points with windows: range, first-match, as-of and interpolating, without pairing a unit's points with each other.

Range joins go by (unit, time bucket): a window meets only the points of the few buckets that it covers, so work grows with the
matches and a unit with most of the points is spread over its buckets. As-of joins sort inside those buckets and carry the last mark from bucket to bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(t: Column, start: Column, end: Column, closed: str) -> Column:
    """Whether ``t`` lies in the window; ``closed`` is both, left, right or neither."""
    low = t >= start if closed in ("both", "left") else t > start
    return low & (t <= end if closed in ("both", "right") else t < end)


def range_join(points: DataFrame, windows: DataFrame, keys: list[str], bucket: int, closed: str = "left") -> DataFrame:
    """Each point (keys, t, more) with each window (keys, start, end, more) that it lies in.

    ``bucket`` should be about the windows' length.
    """
    low, high = F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket)
    spread = windows.where(F.col("end") >= F.col("start")).withColumn("_bucket", F.explode(F.sequence(low, high)))
    placed = points.withColumn("_bucket", F.floor(F.col("t") / bucket))
    return placed.join(spread, [*keys, "_bucket"]).where(within(F.col("t"), F.col("start"), F.col("end"), closed)).drop("_bucket")


def window_counts(points: DataFrame, windows: DataFrame, keys: list[str], window_key: str, bucket: int, closed: str = "both", by: str | None = None, domain: DataFrame | None = None) -> DataFrame:
    """Points in each window, zero for windows without any; with ``by`` and its ``domain`` a row for each of its values."""
    group = [window_key, *([by] if by else [])]
    found = range_join(points, windows, keys, bucket, closed).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    grid = windows.join(domain, how="cross") if domain is not None else windows
    return grid.join(found, group, "left").withColumn("n", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")


def rates(counted: DataFrame, unit_us: int) -> DataFrame:
    """``n`` per time unit of each window; an empty window has none."""
    span = (F.col("end") - F.col("start")) / F.lit(float(unit_us))
    return counted.withColumn("rate", F.when(span > 0, F.col("n") / span))


def carried(rows: DataFrame, key: str, order: list[str], value: Column, bucket: int, name: str) -> DataFrame:
    """``rows`` (key, t, more) with ``name``: the last non-null ``value`` at or before each row in the order (t, *order).

    Rows are sorted inside (key, bucket) only; between buckets, each one's last value is carried on, one row a bucket. A key with most
    of the rows is thus spread over its buckets.
    """
    placed = rows.withColumns({"_v": value, "_b": F.floor(F.col("t") / bucket)})
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(key, "_b").orderBy("t", *order).rowsBetween(Window.unboundedPreceding, 0))
    lasts = placed.groupBy(key, "_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct("t", *order))).alias("_l"))
    earlier = F.last("_l", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    found = placed.withColumn("_inside", inside).join(lasts.select(key, "_b", earlier.alias("_earlier")), [key, "_b"], "left")
    return found.withColumn(name, F.coalesce("_inside", "_earlier")).drop("_v", "_b", "_inside", "_earlier")


def as_of(points: DataFrame, marks: DataFrame, key: str, columns: list[str], bucket: int = 7 * 86_400_000_000) -> DataFrame:
    """Each point with the ``columns`` of the latest of ``marks`` at or before it (null before the first); both have (key, t)."""
    mark = F.struct(F.col("t").alias("_at"), *columns)
    kind = marks.select(mark.alias("x")).schema["x"].dataType
    both = points.withColumns({"_mark": F.lit(None).cast(kind), "_order": F.lit(1)}).unionByName(marks.select(key, "t", mark.alias("_mark"), F.lit(0).alias("_order")), allowMissingColumns=True)
    found = carried(both, key, ["_order"], F.col("_mark"), bucket, "_last").where("_order = 1")
    return found.select(*points.columns, F.col("_last._at").alias("mark_t"), *[F.col(f"_last.{c}").alias(c) for c in columns])


def interpolated(points: DataFrame, samples: DataFrame, key: str, bucket: int = 7 * 86_400_000_000) -> DataFrame:
    """Each point with the linear interpolation of ``samples`` (key, t, value) at its time; null outside their range.

    The sample after a point is the one before it in reversed time.
    """
    at = points.select(key, "point_id", "t")
    before = as_of(at, samples.select(key, "t", "value"), key, ["value"], bucket).select(key, "point_id", "t", F.col("mark_t").alias("t0"), F.col("value").alias("v0"))
    turned = as_of(before.withColumn("t", -F.col("t")), samples.select(key, (-F.col("t")).alias("t"), "value"), key, ["value"], bucket)
    share = (-F.col("t") - F.col("t0")) / (-F.col("mark_t") - F.col("t0")).cast("double")
    value = F.when(F.col("t0") == -F.col("t"), F.col("v0")).otherwise(F.col("v0") + share * (F.col("value") - F.col("v0")))
    return turned.select(key, "point_id", (-F.col("t")).alias("t"), value.alias("value"))


def consecutive(marks: DataFrame, key: str) -> DataFrame:
    """Half-open cycles [start, end) between consecutive marks of a unit, numbered from 0; the last mark opens none."""
    by = Window.partitionBy(key).orderBy("t", "point_id")
    found = marks.select(key, "point_id", F.col("t").alias("start"), F.lead("t").over(by).alias("end"), (F.row_number().over(by) - 1).cast("long").alias("cycle"))
    return found.where("end > start")


def epochs(onsets: DataFrame, lengths: dict[str, tuple[int, int]], closing: str) -> DataFrame:
    """Typed epochs of each onset (unit, point_id, t, next_t): fixed windows around it, and ``closing`` from the last one to the next onset.

    An epoch is valid if it has a length and does not reach over the next onset.
    """
    last = max(end for _, end in lengths.values())
    kinds = [F.struct(F.lit(kind).alias("kind"), (F.col("t") + a).alias("start"), (F.col("t") + b).alias("end")) for kind, (a, b) in lengths.items()]
    kinds.append(F.struct(F.lit(closing).alias("kind"), (F.col("t") + last).alias("start"), F.col("next_t").alias("end")))
    each = onsets.select("unit", "point_id", "next_t", F.inline(F.array(*kinds)))
    return each.where((F.col("end") > F.col("start")) & (F.col("next_t").isNull() | (F.col("end") <= F.col("next_t")))).drop("next_t")


def fixed_windows(onsets: DataFrame, start: int, end: int) -> DataFrame:
    """[t + start, t + end] around each onset (unit, point_id, t)."""
    return onsets.select("unit", "point_id", (F.col("t") + start).alias("start"), (F.col("t") + end).alias("end"))
