"""Statistics of point processes: intervals, correlograms, event-aligned histograms, bursts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.operators import quantiles as Q
from intervale.operators import scans
from intervale.operators.intervals import range_join

Save = Callable[[DataFrame], DataFrame]


def interval_metrics(points: DataFrame, unit_us: int, burst: float, violation: float, save: Save, parts: int | None = None) -> DataFrame:
    """Of each unit: n, rate, and cv, cv2, lv, median and the shares below two bounds of its positive intervals (in ``unit_us``).

    rate is n over the span from first to last point; cv uses the population deviation; cv2 and lv run over neighbouring positive
    intervals. Fewer than three points, or two positive intervals, give nulls. A unit's points are scanned in ``parts``, and its median comes
    from counts, so a unit with most of the points is spread over many tasks.
    """
    keys, order = ["unit"], ["t", "point_id"]
    placed = scans.dealt(points.select(*keys, *order), keys, order, save, parts)
    gap = (F.col("t") - F.col("_t")) / F.lit(float(unit_us))
    positive = scans.scanned(placed, keys, order, {"_t": ("lag", F.col("t"))}).withColumn("gap", F.when(gap > 0, gap))
    earlier = scans.scanned(positive, keys, order, {"before": ("before", F.col("gap"))})
    pairs = save(earlier.select("unit", "t", "gap", F.when(F.col("gap").isNotNull(), F.col("before")).alias("before")))
    ratio = (F.col("gap") - F.col("before")) / (F.col("gap") + F.col("before"))
    n, span = F.count(F.lit(1)), (F.max("t") - F.min("t")) / F.lit(float(unit_us))
    enough = (n >= 3) & (F.count("gap") >= 2)
    of = lambda c: F.when(enough, c)
    middle = Q.medians(pairs, ["unit"], F.col("gap"), "_median", save)
    found = pairs.groupBy("unit").agg(
        n.cast("long").alias("n"),
        F.when(span > 0, n / span).alias("rate"),
        of(F.stddev_pop("gap") / F.avg("gap")).alias("cv"),
        of(F.avg(2 * F.abs(ratio))).alias("cv2"),
        of(F.avg(3 * ratio * ratio)).alias("lv"),
        enough.alias("_enough"),
        of(F.avg((F.col("gap") < burst).cast("double"))).alias("burst_share"),
        of(F.avg((F.col("gap") < violation).cast("double"))).alias("violation_share"),
    )
    return found.join(middle, "unit").select("unit", "n", "rate", "cv", "cv2", "lv", F.when(F.col("_enough"), F.col("_median")).alias("median_gap"), "burst_share", "violation_share")


def correlogram(points: DataFrame, others: DataFrame, width: int, bin_us: int) -> DataFrame:
    """Pairs of a unit's points and ``others`` by lag bin: (unit, bin, n) for lags in [-width, width] other than 0.

    Bins count from -width; the last one is closed. Points meet through windows of ``width``, not all with all.
    """
    windows = points.select("unit", F.col("t").alias("at"), (F.col("t") - width).alias("start"), (F.col("t") + width).alias("end"))
    lag = F.col("t") - F.col("at")
    n_bins = 2 * width // bin_us
    number = F.least(F.floor((lag + width) / bin_us), F.lit(n_bins - 1)).cast("long")
    return range_join(others.select("unit", "t"), windows, ["unit"], 2 * width, "both").where(lag != 0).groupBy("unit", number.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def filled(found: DataFrame, units: DataFrame, n_bins: int) -> DataFrame:
    """``found`` (unit, bin, n) with a zero for each bin of each unit that has none."""
    grid = units.select("unit").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)).cast("array<bigint>")))
    return grid.join(found, ["unit", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def correlogram_density(counts: DataFrame, sizes: DataFrame, bin_us: int, unit_us: int) -> DataFrame:
    """Correlogram counts as density (per point and time unit) and scaled to the unit's maximum."""
    top = F.max("density").over(Window.partitionBy("unit"))
    found = counts.join(sizes, "unit").withColumn("density", F.col("n") / (F.col("n_points") * F.lit(bin_us / unit_us)))
    return found.withColumn("norm", F.when(top > 0, F.col("density") / top)).drop("n_points")


def correlogram_shape(counts: DataFrame, n_bins: int, base: tuple[int, int], share: float, early: int, late: int) -> DataFrame:
    """From filled counts, over bins after lag 0 (k = 1, 2 ...): the first k with at least ``share`` of the mean over ``base``, the peak's k, and the mass up to ``early`` over that of (early, late]."""
    right = counts.where(F.col("bin") >= n_bins // 2).withColumn("k", F.col("bin") - n_bins // 2 + 1)
    mean = F.avg(F.when(F.col("k").between(*base), F.col("n"))).over(Window.partitionBy("unit"))
    found = right.withColumn("base", mean)
    late_mass = F.sum(F.when((F.col("k") > early) & (F.col("k") <= late), F.col("n")).otherwise(0))
    return found.groupBy("unit").agg(
        F.min(F.when((F.col("base") > 0) & (F.col("n") >= share * F.col("base")), F.col("k"))).alias("refractory_bin"),
        F.max_by("k", F.struct(F.col("n"), -F.col("k"))).alias("peak_bin"),
        F.when(late_mass > 0, F.sum(F.when(F.col("k") <= early, F.col("n")).otherwise(0)) / late_mass).alias("burst_ratio"),
    )


def aligned_histogram(points: DataFrame, onsets: DataFrame, start: int, end: int, bin_us: int, keys: list[str]) -> DataFrame:
    """Points around onsets by bin: (keys, bin, n) summed over onsets; the last bin is closed on the right."""
    windows = onsets.select("unit", F.col("t").alias("onset"), (F.col("t") + start).alias("start"), (F.col("t") + end).alias("end"), *[k for k in keys if k != "unit" and k in onsets.columns])
    n_bins = (end - start) // bin_us
    number = F.least(F.floor((F.col("t") - F.col("start")) / bin_us), F.lit(n_bins - 1)).cast("long")
    return range_join(points, windows, ["unit"], end - start, "both").groupBy(*keys, number.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))


def smoothed(binned: DataFrame, keys: list[str], column: str, sigma: float, reach: int) -> DataFrame:
    """Gaussian smoothing of ``column`` along ``bin``; weights are scaled to one over the bins that exist."""
    offsets = list(range(-reach, reach + 1))
    weights = {k: 2.718281828459045 ** (-0.5 * (k / sigma) ** 2) for k in offsets}
    by = Window.partitionBy(*keys).orderBy("bin")
    near = {k: F.lead(column, k).over(by) if k else F.col(column) for k in offsets}
    total = sum((F.coalesce(near[k] * weights[k], F.lit(0.0)) for k in offsets), F.lit(0.0))
    weight = sum((F.when(near[k].isNotNull(), weights[k]).otherwise(0.0) for k in offsets), F.lit(0.0))
    return binned.withColumn("smooth", total / weight)


def bursts(series: DataFrame, above: Column, least: int, save: Save, parts: int | None = None) -> DataFrame:
    """Runs of at least ``least`` consecutive rows (unit, t, point_id, value) for which ``above`` holds; a run that is open at the end is dropped.

    Within a run, the number of a row less that of the rows above the bound so far stays the same. Both come from one scan in ``parts``.
    """
    keys, order = ["unit"], ["t", "point_id"]
    marked = series.select("unit", "t", "point_id", "value", F.coalesce(above, F.lit(False)).alias("_above"))
    numbered = scans.scanned(scans.dealt(marked, keys, order, save, parts), keys, order, {"_i": ("rank", None), "_up": ("sum", F.col("_above").cast("long"))})
    runs = numbered.where("_above").groupBy("unit", (F.col("_i") - F.col("_up")).alias("_run")).agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).cast("long").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"), F.max("_i").alias("_end"))
    sizes = series.groupBy("unit").agg(F.count(F.lit(1)).alias("_last"))
    return runs.where(F.col("n") >= least).join(sizes, "unit").where(F.col("_end") < F.col("_last")).drop("_run", "_end", "_last")
