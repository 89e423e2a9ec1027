"""Signal queries over segments: filters, envelopes, spectrograms, phase-amplitude coupling and spike-field phases."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.functions import signals as K
from intervale.functions.circular import modulation_index
from intervale.operators.chunks import by_row, matrices_by_length, over_chunks
from intervale.operators.replicates import cycles as cycles_of
from intervale.operators.replicates import lots, row_groups
from intervale.operators.sampled import chunked
from intervale.plans.events import EV, r6
from intervale.plans.registry import query
from intervale.plans.segments import SG
from intervale.sources.tables import HOUR, points, segments

RATE = 64.0
FREQUENCIES = np.geomspace(3, 24, 6)


@query()
def bandpass_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Mean envelope of three sub-bands of each segment, and their mean z-score over the segment's own mean and deviation."""
    edges = np.linspace(6, 24, 4)

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        envelopes = np.stack([np.abs(K.band(x, a, b, RATE, 2)) for a, b in zip(edges, edges[1:])], axis=1)
        z = (envelopes - envelopes.mean(axis=2, keepdims=True)) / np.maximum(envelopes.std(axis=2, ddof=1, keepdims=True), 1e-12)
        return {"envelopes": envelopes.mean(axis=2), "z": z.mean(axis=1)}

    return by_row(segments(spark, d), ["samples"], kernel, "unit long, envelopes array<double>, z array<double>")


@query()
def line_removed(spark: SparkSession, d: str) -> DataFrame:
    """Segments without mean, linear trend and a line frequency with its harmonics."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
        flat = x - x.mean(axis=1, keepdims=True)
        return {"samples": K.without_line(flat - np.outer(flat @ t / (t @ t), t), 12.0, RATE)}

    return by_row(segments(spark, d), ["samples"], kernel, "unit long, samples array<double>")


def _group_power(spark: SparkSession, d: str, kernel: Callable, schema: str, windows: int, n_frequencies: int) -> DataFrame:
    """Power by group, frequency and window as decibels and as z-scores against the first quarter of the windows, pooled over segments."""
    each = by_row(segments(spark, d), ["samples"], kernel, schema).join(segments(spark, d).select("unit", "grp"), "unit")
    cells = each.select("grp", F.posexplode("power").alias("cell", "p")).select("grp", F.floor(F.col("cell") / n_frequencies).alias("window"), F.pmod(F.col("cell"), F.lit(n_frequencies)).alias("frequency"), "p")
    means = cells.groupBy("grp", "frequency", "window").agg(F.count("p").alias("n"), F.avg("p").alias("power"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    first = means.where(F.col("window") < max(1, windows // 4)).groupBy("frequency").agg((F.sum(F.col("power") * F.col("n")) / F.sum("n")).alias("m"), (F.sum("pp") / F.sum("n")).alias("mm"))
    sd = F.sqrt(F.greatest(F.col("mm") - F.col("m") * F.col("m"), F.lit(0.0)))
    found = means.join(F.broadcast(first), "frequency").select("grp", "frequency", "window", "n", F.when(F.col("power") > 0, 10 * F.log10("power")).alias("db"), F.when(sd > 0, (F.col("power") - F.col("m")) / sd).alias("z"))
    return r6(found, "db", "z")


def group_power_sql(power: str, windows: int) -> str:
    """Decibels and z-scores by group from the CTEs in ``power``, the last of which is c: grp, frequency, win, p."""
    return f"""WITH {SG}, {power}, m AS (SELECT grp, frequency, win, count(p) AS n, avg(p) AS power, sum(p * p) AS pp FROM c GROUP BY 1, 2, 3),
f AS (SELECT frequency, sum(power * n) / sum(n) AS mu, sum(pp) / sum(n) AS mm FROM m WHERE win < {max(1, windows // 4)} GROUP BY 1), q AS (SELECT frequency, mu, sqrt(greatest(mm - mu * mu, 0)) AS sd FROM f)
SELECT grp, frequency::BIGINT AS frequency, win::BIGINT AS "window", n::BIGINT AS n, round(CASE WHEN power > 0 THEN 10 * log10(power) END, 6) AS db, round(CASE WHEN sd > 0 THEN (power - mu) / sd END, 6) AS z FROM m JOIN q USING (frequency)"""


# a window's Fourier sum is an inner product with 64 weights: the taper's wave inside the window, less its mean there, and 0 outside
STFT_SQL = """t AS (SELECT win, frequency, i, (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 32)) AS w, 2 * pi() * frequency * i / 32 AS turn FROM range(5) a(win) CROSS JOIN range(17) b(frequency) CROSS JOIN range(32) c(i)),
u AS (SELECT win, frequency, win * 8 + i AS j, w * cos(turn) - avg(w * cos(turn)) OVER o AS re, w * sin(turn) - avg(w * sin(turn)) OVER o AS im FROM t WINDOW o AS (PARTITION BY win, frequency)),
v AS (SELECT g.win, g.frequency, list(coalesce(re, 0) ORDER BY g.j) AS re, list(coalesce(im, 0) ORDER BY g.j) AS im FROM (SELECT * FROM range(5) a(win) CROSS JOIN range(17) b(frequency) CROSS JOIN range(64) c(j)) g LEFT JOIN u ON u.win = g.win AND u.frequency = g.frequency AND u.j = g.j GROUP BY 1, 2),
c AS (SELECT grp, frequency, win, (pow(list_inner_product(x, re), 2) + pow(list_inner_product(x, im), 2)) / 12 AS p FROM s CROSS JOIN v)"""


@query(group_power_sql(STFT_SQL, 5))
def stft_groups(spark: SparkSession, d: str) -> DataFrame:
    """Hann spectrograms (32 samples, steps of 8) by group."""
    return _group_power(spark, d, lambda x: {"power": K.spectrogram(x, 32, 8).reshape(len(x), -1)}, "unit long, power array<double>", 5, 17)


# a real wavelet around each of 64 samples; the squares are averaged over eight samples
CWT_SQL = f"""h AS (SELECT unnest({[float(f) for f in FREQUENCIES]}::DOUBLE[]) AS f, unnest(range({len(FREQUENCIES)})) AS frequency),
v AS (SELECT frequency, pos, list(cos(2 * pi() * f * (pos - i) / {RATE}::DOUBLE) * exp(-0.5::DOUBLE * pow((pos - i) / {RATE}::DOUBLE * 2 * pi() * f / 5, 2)) * sqrt(f / {RATE}::DOUBLE) ORDER BY i) AS k FROM h CROSS JOIN range(64) a(pos) CROSS JOIN range(64) b(i) GROUP BY 1, 2),
c AS (SELECT grp, frequency, pos // 8 AS win, avg(pow(list_inner_product(x, k), 2)) AS p FROM s CROSS JOIN v GROUP BY grp, unit, frequency, pos // 8)"""


@query(group_power_sql(CWT_SQL, 8))
def cwt_groups(spark: SparkSession, d: str) -> DataFrame:
    """Wavelet power on six log-spaced frequencies, in eight windows, by group."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        p = K.wavelet_power(x, FREQUENCIES, RATE)
        return {"power": p.reshape(len(x), len(FREQUENCIES), 8, -1).mean(axis=3).transpose(0, 2, 1).reshape(len(x), -1)}

    return _group_power(spark, d, kernel, "unit long, power array<double>", 8, len(FREQUENCIES))


N = 200
#: Segments that are deranged among each other, and samples that a deflection moves at most.
TRIALS, JITTER = 256, 6


def surrogate_sums(df: DataFrame, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], cells: int) -> DataFrame:
    """(grp, replicate, cells): sums over the segments of each group, replicate 0 from the data and N from surrogates.

    Segments are trials with two channels, their halves. A group's trials are dealt to lots of about TRIALS; ``kernel`` gets the two
    channels and the units of one lot, and gives a matrix (N + 1, cells). Trials with a null or an odd length are left out.
    """
    counts = df.groupBy("grp").agg(F.greatest(F.floor(F.count(F.lit(1)) / TRIALS), F.lit(1)).alias("lots"))
    dealt = df.join(counts, "grp").withColumn("lot", F.pmod(F.xxhash64("unit"), F.col("lots")))
    ordered = dealt.select("grp", "lot", "unit", "samples").repartition("grp", "lot").sortWithinPartitions("grp", "lot", F.xxhash64("unit"), "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (grp, _), table in row_groups(batches, ["grp", "lot"]):
            total = np.zeros((N + 1, cells))
            for rows, (x,) in matrices_by_length([table.column("samples").combine_chunks()]):
                if x.shape[1] % 2 == 0 and x.shape[1] >= 16:
                    half = x.shape[1] // 2
                    total += kernel(x[:, :half], x[:, half:], np.asarray(table.column("unit"))[rows])
            yield pa.RecordBatch.from_pydict({"grp": pa.array([grp] * (N + 1), pa.int64()), "replicate": pa.array(np.arange(N + 1)), "cells": pa.array(total.tolist(), pa.list_(pa.float64()))})

    found = ordered.select(F.col("grp").cast("long").alias("grp"), "lot", "unit", "samples").mapInArrow(run, "grp long, replicate long, cells array<double>")
    return found.groupBy("grp", "replicate").agg(F.array(*[F.sum(F.get("cells", i)) for i in range(cells)]).alias("cells"))


def against_surrogates(stat: DataFrame) -> DataFrame:
    """(grp, observed, z, p, p_two): the statistic of replicate 0 against the others; p_two is the smaller tail's, not doubled."""
    seen = stat.where("replicate = 0").select("grp", F.col("statistic").alias("observed"))
    null = F.col("replicate") > 0
    value = F.when(null, F.col("statistic"))
    n = F.count(value)
    mean, sd = F.avg(value), F.stddev_pop(value)
    tail = lambda hit: (F.count_if(null & hit) + 1) / (n + 1)
    up, down = tail(F.col("statistic") >= F.col("observed")), tail(F.col("statistic") <= F.col("observed"))
    return stat.join(seen, "grp").groupBy("grp", "observed").agg(F.when(sd > 0, (F.col("observed") - mean) / sd).alias("z"), F.when(n > 0, up).alias("p"), F.when(n > 0, F.least(up, down)).alias("p_two"))


def _phase_and_amplitude(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.angle(K.band(x, 4, 8, RATE, 2)), np.abs(K.band(y, 14, 26, RATE, 2))


def coupling_cells(x: np.ndarray, y: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Amplitude sums and counts by phase bin (N + 1, 36); in a replicate each trial's phase meets the amplitude of the next one in a random cycle.

    No trial meets its own, and cycles differ between replicates. A single trial has no surrogate.
    """
    phase, amplitude = _phase_and_amplitude(x, y)
    bin_ = np.minimum(((phase % (2 * np.pi)) / (2 * np.pi / 18)).astype(int), 17)
    out, m = np.full((N + 1, 36), np.nan if len(units) < 2 else 0.0), len(units)
    partner = np.vstack([np.arange(m), cycles_of(lots(units.tolist(), 1, N))]) if m > 1 else np.zeros((1, 1), int)
    for r, own in enumerate(partner):
        moved = amplitude[own]
        out[r] = np.concatenate([np.bincount(bin_.ravel(), weights=moved.ravel(), minlength=18), np.bincount(bin_.ravel(), minlength=18)])
    return out


def locking_cells(x: np.ndarray, y: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Sums of cosine and sine of the phase at large deflections, and their number (N + 1, 3).

    In a surrogate each deflection moves by up to JITTER samples inside its trial; draws depend on the unit alone.
    """
    phase = np.angle(K.band(x, 4, 8, RATE, 2))
    trial, at = np.nonzero(y > y.mean(axis=1, keepdims=True) + y.std(axis=1, keepdims=True))
    out = np.zeros((N + 1, 3))
    moves = [np.random.default_rng([17, int(u) & 0xFFFFFFFF]).integers(-JITTER, JITTER + 1, (N, y.shape[1])) for u in units]
    for r in range(N + 1):
        place = at if r == 0 else np.clip(at + np.array([moves[i][r - 1, k] for i, k in zip(trial, at, strict=True)], dtype=int), 0, y.shape[1] - 1)
        angle = phase[trial, place]
        out[r] = np.cos(angle).sum(), np.sin(angle).sum(), len(at)
    return out


@query()
def irpac(spark: SparkSession, d: str) -> DataFrame:
    """Coupling of one channel's fast amplitude to the other's slow phase over a group's trials, against deranged trials."""
    sums = surrogate_sums(segments(spark, d), coupling_cells, 36)
    means = F.transform(F.sequence(F.lit(0), F.lit(17)), lambda i: F.when(F.get("cells", i + 18) > 0, F.get("cells", i) / F.get("cells", i + 18)).otherwise(0.0))
    return against_surrogates(sums.select("grp", "replicate", modulation_index(means, 18).alias("statistic")).where("NOT isnan(statistic)"))


@query()
def sfc(spark: SparkSession, d: str) -> DataFrame:
    """Phase locking of one channel's large deflections to the other's slow phase over a group's trials, against jittered deflections."""
    sums = surrogate_sums(segments(spark, d), locking_cells, 3)
    c, s, n = (F.get("cells", i) for i in range(3))
    return against_surrogates(sums.select("grp", "replicate", (F.sqrt(c * c + s * s) / F.when(n > 0, n)).alias("statistic")).where("statistic IS NOT NULL"))


def cycles(phase: np.ndarray, amplitude: np.ndarray, least: float = 2.0, slack: float = 0.1) -> list[tuple[int, int, float, bool]]:
    """(start, end, signal to noise, good) of each whole cycle between the phase's wraps.

    The ratio is the cycle's mean amplitude over the deviation of all amplitudes (0 where that is 0); a good cycle reaches ``least``
    and its phase never steps back by more than ``slack``.
    """
    cuts = np.flatnonzero(np.diff(phase) < -np.pi) + 1
    spread = amplitude.std()
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        snr = float(amplitude[a:b].mean() / spread) if spread > 0 else 0.0
        out.append((int(a), int(b), snr, bool(snr >= least and (np.diff(np.unwrap(phase[a:b])) >= -slack).all())))
    return out


@query()
def cycle_quality(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of each segment's slow rhythm, those of good quality, and their mean ratio of signal to noise."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        z = K.band(x, 4, 8, RATE, 2)
        found = [cycles(p, a) for p, a in zip(np.angle(z), np.abs(z), strict=True)]
        return {"cycles": np.array([float(len(c)) for c in found]), "good": np.array([float(sum(g for *_, g in c)) for c in found]), "snr": np.array([np.mean([s for _, _, s, _ in c]) if c else 0.0 for c in found])}

    return by_row(segments(spark, d), ["samples"], kernel, "unit long, cycles double, good double, snr double")


SIZE, BORDER = 48, 240


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Each mark's sums by hour as one long signal in chunks; hours without a point are 0."""
    p = points(spark, d).where("mark IS NOT NULL")
    series = p.groupBy("mark", F.floor(F.col("t") / HOUR).alias("i")).agg(F.sum("value").alias("value"))
    chunks = chunked(series, ["mark"], SIZE)
    return chunks.select("mark", "chunk", "i0", F.transform("samples", lambda v: F.coalesce(v, F.lit(0.0))).alias("samples"))


@query()
def chunked_envelope(spark: SparkSession, d: str) -> DataFrame:
    """The daily rhythm's envelope in each mark's hourly sums: band-pass and analytic signal over chunks with borders, means by chunk."""
    found = over_chunks(hourly(spark, d), ["mark"], SIZE, BORDER, lambda x: np.abs(K.band(x, 1 / 36, 1 / 16, 1.0, 2)))
    return found.select("mark", "chunk", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v) / F.size("samples"), 6).alias("envelope"))


@query(f"""WITH {EV}, a AS (SELECT mark, t // {HOUR} AS i, sum(value) AS v FROM e WHERE mark IS NOT NULL GROUP BY 1, 2), k AS (SELECT DISTINCT mark, i // {SIZE} AS c FROM a),
b AS (SELECT k.mark, k.c, CASE WHEN p.c IS NULL THEN 0 ELSE 24 END AS before, CASE WHEN q.c IS NULL THEN 0 ELSE 24 END AS after FROM k LEFT JOIN k p ON p.mark = k.mark AND p.c = k.c - 1 LEFT JOIN k q ON q.mark = k.mark AND q.c = k.c + 1),
d AS (SELECT mark, 2 * c + h AS day, least(greatest((2 * c + h) * 24 - 12, {SIZE} * c - before), {SIZE} * c + after) AS low FROM b CROSS JOIN range(2) r(h)),
x AS (SELECT d.mark, d.day, n.n, 0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * n.n / 48) AS w, coalesce(a.v, 0) AS v FROM d CROSS JOIN range(48) n(n) LEFT JOIN a ON a.mark = d.mark AND a.i = d.low + n.n),
z AS (SELECT mark, day, n, w * (v - avg(v) OVER (PARTITION BY mark, day)) AS v FROM x)
SELECT mark, day::BIGINT AS day, f::BIGINT AS frequency, round((pow(sum(v * cos(2 * pi() * f * n / 48)), 2) + pow(sum(v * sin(2 * pi() * f * n / 48)), 2)) / 18, 4) AS power FROM z CROSS JOIN range(1, 25) r(f) GROUP BY 1, 2, 3""")
def chunked_spectrogram(spark: SparkSession, d: str) -> DataFrame:
    """Power of each mark's hourly sums by day and frequency (Hann windows of two days around each day), over chunks with borders."""

    def kernel(x: np.ndarray) -> np.ndarray:
        # one row of samples in, one value for each of them out: day by day, the power at its 24 frequencies
        days = x.shape[1] // 24
        out = np.full(x.shape, np.nan)
        for day in range(days):
            low = min(max(day * 24 - 12, 0), max(x.shape[1] - 48, 0))
            part = x[:, low : low + 48]
            w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(part.shape[1]) / part.shape[1])
            power = np.abs(np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * w, axis=1)) ** 2 / (w**2).sum()
            out[:, day * 24 : day * 24 + 24] = power[:, 1:25]
        return out

    found = over_chunks(hourly(spark, d), ["mark"], SIZE, 24, kernel)
    each = found.select("mark", "i0", F.posexplode("samples").alias("k", "power")).where("NOT isnan(power)")
    return each.select("mark", F.floor((F.col("i0") + F.col("k")) / 24).alias("day"), (F.col("k") % 24 + 1).cast("long").alias("frequency"), F.round("power", 4).alias("power"))
