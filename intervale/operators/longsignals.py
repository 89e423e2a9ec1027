"""Phases and couplings of long signals that are stored in chunks (keys, chunk, i0, samples): no signal is gathered.

Signals lie on one grid: sample ``i`` of a signal is ``samples[i - i0]`` of its chunk, and chunk ``c`` begins at ``c`` times the size of a
chunk. A chunk may be missing, which is a gap.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.functions.circular import modulation_index
from intervale.operators import scans
from intervale.operators.chunks import by_row, with_borders

TURN = 2 * np.pi

#: Hemispheres that one of the first name pairs with.
UNKNOWN = "unknown"


def hemisphere_pairs(left: DataFrame, right: DataFrame, session: str, matched: bool = True) -> DataFrame:
    """All pairs of the rows of ``left`` and ``right`` of one session whose hemispheres agree, or are unknown on either side.

    Both have ``session`` and ``hemisphere``, and other columns of different names; the result has them all, with left_hemisphere and
    right_hemisphere. A null hemisphere is unknown. The sides meet by session and hemisphere, with a copy of a left row for each one that
    it pairs with. Without ``matched`` all rows of a session pair.
    """
    told = lambda df, name: df.withColumn(name, F.coalesce("hemisphere", F.lit(UNKNOWN))).drop("hemisphere")
    a, b = told(left, "left_hemisphere"), told(right, "right_hemisphere")
    if not matched:
        return a.join(b, session)
    known = b.select(session, F.col("right_hemisphere").alias("_meets")).distinct()
    fits = (F.col("left_hemisphere") == F.col("_meets")) | (F.col("left_hemisphere") == UNKNOWN) | (F.col("_meets") == UNKNOWN)
    meets = a.select(session, "left_hemisphere").distinct().join(known, session).where(fits)
    return a.join(meets, [session, "left_hemisphere"]).withColumnRenamed("_meets", "right_hemisphere").join(b, [session, "right_hemisphere"])


def unwrapped(chunks: DataFrame, keys: list[str], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``chunks`` of phases without their jumps of whole turns, as if each run of chunks without a gap were one array.

    Each chunk is unwrapped on its own; the whole turns that it makes, and the jump to the next chunk, are one number a chunk, whose sums
    over the chunks before it are added. A chunk with a null is left out, and is a gap.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    names = [*keys, "chunk", "i0"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "own array<double>, first double, last double, turns double"])

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        own = np.unwrap(x, axis=1)
        return {"own": own, "first": x[:, 0], "last": x[:, -1], "turns": np.rint((own[:, -1] - x[:, -1]) / TURN)}

    each = save(by_row(chunks.select(*names, "samples"), ["samples"], kernel, schema, keep=len(names)).where("own IS NOT NULL"))
    ends = each.select(*keys, "i0", F.size("own").alias("n"), "first", "last", F.col("turns").cast("long").alias("turns"))
    placed = scans.dealt(ends, keys, ["i0"], save)
    led = scans.scanned(placed, keys, ["i0"], {"prev": ("lag", F.struct("i0", "n", "last", "turns"))})
    step = F.col("first") - F.col("prev.last")
    down = -F.floor((step + np.pi) / TURN).cast("long")
    tie = ((step + np.pi) / TURN == F.floor((step + np.pi) / TURN)) & (step > 0)
    joins = F.coalesce(F.col("prev.i0") + F.col("prev.n") == F.col("i0"), F.lit(False))
    moved = led.withColumns({"_joins": joins, "_step": F.when(joins, F.col("prev.turns") + down + tie.cast("long")).otherwise(0)})
    summed = scans.scanned(moved, keys, ["i0"], {"_total": ("sum", F.col("_step"))})
    based = scans.scanned(summed, keys, ["i0"], {"_base": ("last", F.when(~F.col("_joins"), F.col("_total")))})
    turns = based.select(*keys, "i0", (F.col("_total") - F.col("_base")).alias("_turns"))
    return each.join(turns, [*keys, "i0"]).select(*names, F.transform("own", lambda v: v + F.col("_turns") * TURN).alias("samples"))


def phase_at(points: DataFrame, phases: DataFrame, keys: list[str], size: int, at: str = "at") -> DataFrame:
    """``points`` (keys, ``at`` in samples, more) with ``phase``: that of ``phases`` (of ``unwrapped``) there, in [-pi, pi).

    Between samples the unwrapped phase is interpolated. Points outside the signal, or beside a gap, drop out. A point meets one chunk.
    """
    bordered = with_borders(phases, keys, size, 1).select(*keys, F.col("i0").alias("_i0"), F.col("chunk").alias("_chunk"), F.col("before").alias("_before"), F.col("samples").alias("_samples"))
    placed = points.withColumn("_chunk", F.floor(F.col(at) / size))
    place = (F.floor(at) - F.col("_i0") + F.col("_before")).cast("int")
    a, b, share = F.get("_samples", place), F.get("_samples", place + 1), F.col(at) - F.floor(at)
    value = F.when(share == 0, a).otherwise(a + (b - a) * share)
    found = placed.join(bordered, [*keys, "_chunk"]).withColumn("phase", F.pmod(value + np.pi, F.lit(TURN)) - np.pi)
    return found.where("phase IS NOT NULL").select(*points.columns, "phase")


def lag_sums(phases: DataFrame, amplitudes: DataFrame, pairs: DataFrame, size: int, lags: list[int], bins: int = 18) -> DataFrame:
    """(phase_key, amplitude_key, lag, bin, n, total): counts and sums of the amplitude by phase bin, at each of ``lags`` in samples.

    A sample's phase meets the amplitude ``lag`` samples before it. ``phases`` and ``amplitudes`` are chunks with a key each
    (phase_key, amplitude_key), and ``pairs`` says which meet. All lags of a chunk come at once, as products of transforms of the bins'
    indicators with those of the amplitude's chunks around it. Where the other signal has no sample, or a null, nothing is counted.
    """
    reach = -(-max((abs(lag) for lag in lags), default=0) // size)
    # each chunk of the amplitude goes to the chunks of the phase that a lag brings it to, so gaps in either need no other care
    copies = amplitudes.withColumn("_step", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    around = copies.select("amplitude_key", (F.col("chunk") + F.col("_step")).alias("chunk"), F.col("i0").alias("_i0"), F.col("samples").alias("_amplitude"))
    met = phases.select("phase_key", "chunk", "i0", F.col("samples").alias("_phase")).join(pairs.select("phase_key", "amplitude_key"), "phase_key").join(around, ["amplitude_key", "chunk"])
    kinds = {c: met.schema[c].dataType.simpleString() for c in ("phase_key", "amplitude_key")}
    steps = np.array(lags, dtype=np.int64)

    def out(sums: dict) -> pa.RecordBatch:
        cells = np.concatenate([s.reshape(2, -1) for s in sums.values()], axis=1)
        each = len(steps) * bins
        names = list(zip(*sums, strict=True))
        grid = lambda x: np.tile(x, len(sums))
        return pa.RecordBatch.from_pydict({"phase_key": pa.array([k for k in names[0] for _ in range(each)]), "amplitude_key": pa.array([k for k in names[1] for _ in range(each)]), "lag": grid(np.repeat(steps, bins)), "bin": grid(np.tile(np.arange(bins), len(steps))), "n": np.rint(cells[0]).astype(np.int64), "total": cells[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                phase, amplitude = (np.array([np.nan if v is None else v for v in r[c] or []], dtype=float) for c in ("_phase", "_amplitude"))
                seen, heard = np.isfinite(phase), np.isfinite(amplitude)
                if not seen.any() or not heard.any():
                    continue
                which = np.minimum(((phase[seen] % TURN) / (TURN / bins)).astype(int), bins - 1)
                marks = np.zeros((bins, len(phase)))
                marks[which, np.flatnonzero(seen)] = 1
                length = len(phase) + len(amplitude)
                one = np.fft.rfft(marks, length, axis=1)
                other = np.fft.rfft(np.stack([heard.astype(float), np.where(heard, amplitude, 0.0)]), length, axis=1)
                found = np.fft.irfft(one * other.conj()[:, None], length, axis=2)
                shift = steps - (r["i0"] - r["_i0"])
                inside = (shift < len(phase)) & (shift > -len(amplitude))
                cells = np.where(inside, found[:, :, shift % length], 0.0).transpose(0, 2, 1)
                cells[1][np.rint(cells[0]) == 0] = 0.0
                key = (r["phase_key"], r["amplitude_key"])
                sums[key] = sums.get(key, 0.0) + np.stack([np.rint(cells[0]), cells[1]])
                if len(sums) * len(steps) * bins > 1 << 18:
                    yield out(sums)
                    sums = {}
        if sums:
            yield out(sums)

    found = met.mapInArrow(run, f"phase_key {kinds['phase_key']}, amplitude_key {kinds['amplitude_key']}, lag long, bin long, n long, total double")
    return found.groupBy("phase_key", "amplitude_key", "lag", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def lag_curve(sums: DataFrame, bins: int = 18, exclude: tuple[int, int] | None = None) -> DataFrame:
    """(phase_key, amplitude_key, lag, n, mi): the modulation index at each lag; null where nothing meets, and in the ``exclude`` range of |lag|."""
    by_bin = F.map_from_entries(F.collect_list(F.struct("bin", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0))))
    each = sums.groupBy("phase_key", "amplitude_key", "lag").agg(F.sum("n").alias("n"), by_bin.alias("_m"))
    means: Column = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>"), lambda k: F.coalesce(F.try_element_at("_m", k), F.lit(0.0)))
    allowed = F.col("n") > 0
    if exclude:
        allowed = allowed & ~F.abs("lag").between(*sorted(exclude))
    return each.withColumn("_means", means).select("phase_key", "amplitude_key", "lag", "n", F.when(allowed, modulation_index(F.col("_means"), bins)).alias("mi"))


LOCKING = "unit long, channel string, n long, mvl double, z double, p double"


def lag_column(lag: int) -> str:
    return f"lag_{'m' if lag < 0 else ''}{abs(lag)}"


def wide_lags(curve: DataFrame, lags: list[int]) -> DataFrame:
    """(phase_key, amplitude_key, a double for each of ``lags``): one row a pair, null where a lag has no value."""
    columns = [F.max(F.when(F.col("lag") == lag, F.col("mi"))).alias(lag_column(lag)) for lag in lags]
    return curve.groupBy("phase_key", "amplitude_key").agg(*columns)


def no_locking(df: DataFrame) -> DataFrame:
    """A result of locking without rows, with all its typed columns."""
    return df.sparkSession.createDataFrame([], LOCKING)


def no_coupling(df: DataFrame, lags: list[int], kind: str = "string") -> DataFrame:
    """A result of ``wide_lags`` without rows, with all its typed columns."""
    return df.sparkSession.createDataFrame([], ", ".join([f"phase_key {kind}, amplitude_key {kind}", *(f"{lag_column(lag)} double" for lag in lags)]))
