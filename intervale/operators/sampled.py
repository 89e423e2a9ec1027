"""Regularly sampled signals stored in chunks: segments around onsets, block by block, without building whole signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chunked(series: DataFrame, keys: list[str], size: int) -> DataFrame:
    """A long series (keys, i, value), one row per sample, as rows of ``size`` samples (keys, chunk, i0, samples); gaps are nulls."""
    chunk = F.floor(F.col("i") / size)
    cells = series.groupBy(*keys, chunk.alias("chunk")).agg(F.map_from_entries(F.collect_list(F.struct(F.pmod(F.col("i"), F.lit(size)).cast("int"), F.col("value")))).alias("m"))
    return cells.select(*keys, "chunk", (F.col("chunk") * size).alias("i0"), F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.col("m")[k]).alias("samples"))


def aligned(chunks: DataFrame, onsets: DataFrame, keys: list[str], size: int, start: int, end: int) -> DataFrame:
    """(keys, onset, samples): the samples [at + start, at + end) of each onset (keys, onset, at) in each signal of its keys.

    An onset meets only the chunks that its window touches; windows that reach over a signal's ends drop out.
    """
    first, last = F.floor((F.col("at") + start) / size), F.floor((F.col("at") + end - 1) / size)
    wanted = onsets.withColumn("chunk", F.explode(F.sequence(first, last)))
    met = chunks.join(wanted, [*keys, "chunk"])
    low = F.greatest(F.col("at") + start - F.col("i0"), F.lit(0))
    high = F.least(F.col("at") + end - F.col("i0"), F.lit(size))
    part = F.struct("i0", F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("x"))
    others = [c for c in chunks.columns if c not in (*keys, "chunk", "i0", "samples")]
    whole = met.groupBy(*keys, *others, "onset").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return whole.select(*keys, *others, "onset", F.flatten(F.transform("parts", lambda p: p["x"])).alias("samples")).where(F.size("samples") == end - start)


def referenced(long: DataFrame, bundle: list[str], value: str) -> DataFrame:
    """``value`` less the mean over its bundle, where that has two members or more."""
    means = long.groupBy(*bundle).agg(F.avg(value).alias("_m"), F.count(value).alias("_k"))
    return long.join(means, bundle).withColumn(value, F.when(F.col("_k") >= 2, F.col(value) - F.col("_m")).otherwise(F.col(value))).drop("_m", "_k")


def variance_by(long: DataFrame, condition: str, bin_: str, value: str) -> DataFrame:
    """Sum over bins of the population variance of ``value`` across rows, by condition, and its share of the whole."""
    each = long.groupBy(condition, bin_).agg(F.var_pop(value).alias("_v")).groupBy(condition).agg(F.sum("_v").alias("variance"))
    return each.withColumn("share", F.col("variance") / F.sum("variance").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def detected_bundle(channels: DataFrame, candidates: list[str], fallback: str = "location") -> str | None:
    """The first of ``candidates`` that bundles channels, else ``fallback`` if there is such a column: one aggregate over all of them.

    A column bundles if it has more than one value and a value that more than one channel has; a missing value is a value too.
    """
    have = [c for c in candidates if c in channels.columns]
    values = [F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in have]
    found = channels.agg(F.count(F.lit(1)).alias("_n"), *values).first()
    for c in have:
        if 1 < found[c] < found["_n"]:
            return c
    return fallback if fallback in channels.columns else None


def mean_wave(wave: Column, rank: int, channels: int = 8) -> Column:
    """One waveform from a nested array: itself (rank 1); the channel with the largest range if there are at most ``channels`` rows, else
    the mean of the rows (rank 2); the mean over rows of each channel, then the channel with the largest range (rank 3: rows, channels).

    Of equally large ranges the first counts. An empty or null array gives null.
    """
    mean = lambda rows: F.transform(F.get(rows, 0), lambda _, i: F.aggregate(rows, F.lit(0.0), lambda a, r: a + F.get(r, i)) / F.size(rows))

    def peak(rows: Column) -> Column:
        reach = F.transform(rows, lambda r: F.array_max(r) - F.array_min(r))
        return F.get(rows, (F.array_position(reach, F.array_max(reach)) - 1).cast("int"))

    if rank == 1:
        found = wave
    elif rank == 2:
        found = F.when(F.size(wave) <= channels, peak(wave)).otherwise(mean(wave))
    else:
        numbers = F.sequence(F.lit(0), F.size(F.get(wave, 0)) - 1)
        found = peak(F.transform(numbers, lambda c: mean(F.transform(wave, lambda spike: F.get(spike, c)))))
    return F.when(F.size(wave) > 0, found)


def timecourse(cells: DataFrame, keys: list[str], channel: str, value: str) -> DataFrame:
    """(keys, n, mean, sem): of each channel's mean over its cells, the mean and standard error (population deviation) over channels."""
    own = cells.groupBy(*keys, channel).agg(F.avg(value).alias("_v"))
    n = F.count("_v")
    return own.groupBy(*keys).agg(n.alias("n"), F.avg("_v").alias("mean"), (F.stddev_pop("_v") / F.sqrt(n)).alias("sem"))
