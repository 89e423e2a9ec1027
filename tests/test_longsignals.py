"""Phases and couplings of signals in chunks against the whole signals, with gaps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale.functions import signals as K
from intervale.operators import longsignals as L
from intervale.operators import scans
from intervale.plans import longsignals as P
from intervale.sources.scratch import saved
from intervale.sources.tables import HOUR, points

SF = "/root/testdata/sf0.001"
SIZE = 8


def chunks_of(spark, signals, name="key"):
    """Signals by key and first chunk as rows of SIZE samples."""
    rows = []
    for (key, first), x in signals.items():
        rows += [(key, first + i, (first + i) * SIZE, [float(v) for v in x[i * SIZE : (i + 1) * SIZE]]) for i in range(len(x) // SIZE)]
    return spark.createDataFrame(rows, f"{name} string, chunk long, i0 long, samples array<double>").repartition(5)


@pytest.fixture
def many_parts(monkeypatch):
    """Scans over many small parts."""
    dealt = scans.dealt
    monkeypatch.setattr(scans, "dealt", lambda df, keys, order, save, parts=None: dealt(df, keys, order, save, 9))


@pytest.fixture(scope="module")
def phases():
    """Two runs of one channel with a gap, one run of another; one with steps of exactly half a turn."""
    dice = np.random.default_rng(1)
    wrap = lambda x: (x + np.pi) % (2 * np.pi) - np.pi
    walk = lambda n: wrap(np.cumsum(dice.normal(0.8, 1.2, n)))
    return {("a", 0): walk(80), ("a", 14): walk(64), ("b", 3): walk(160), ("c", 0): np.tile([np.pi / 2, -np.pi / 2], 16)}


def test_unwrapping_equals_that_of_whole_runs(spark, phases, many_parts):
    found = {(r["key"], r["chunk"]): r["samples"] for r in L.unwrapped(chunks_of(spark, phases), ["key"], saved).collect()}
    assert len(found) == sum(len(x) // SIZE for x in phases.values())
    for (key, first), x in phases.items():
        want = np.unwrap(x)
        got = np.concatenate([found[key, first + i] for i in range(len(x) // SIZE)])
        assert np.abs(got - want).max() < 1e-9


def test_phases_at_points_equal_interpolation(spark, phases, many_parts):
    dice = np.random.default_rng(2)
    rows = [(key, float(at), i) for i, (key, at) in enumerate([(k, v) for k in "abcx" for v in [*dice.uniform(-20, 240, 150), 0.0, 79.0, 79.5, 112.0, 8.0, 7.25, 175.0, 175.01]])]
    df = spark.createDataFrame(rows, "key string, at double, id long").repartition(4)
    found = {r["id"]: r["phase"] for r in L.phase_at(df, L.unwrapped(chunks_of(spark, phases), ["key"], saved), ["key"], SIZE).collect()}
    want = {}
    for key, at, i in rows:
        for (k, first), x in phases.items():
            low = first * SIZE
            if k == key and low <= at <= low + len(x) - 1:
                v = np.interp(at, low + np.arange(len(x)), np.unwrap(x))
                want[i] = (v + np.pi) % (2 * np.pi) - np.pi
    assert found.keys() == want.keys() and len(want) > 200
    assert all(abs(np.exp(1j * found[i]) - np.exp(1j * want[i])) < 1e-9 for i in want)


def test_chunks_with_nulls_are_gaps(spark, phases):
    cut = chunks_of(spark, phases).withColumn("samples", F.when((F.col("key") == "b") & (F.col("chunk") == 6), F.array(*[F.lit(None).cast("double")] * SIZE)).otherwise(F.col("samples")))
    found = {(r["key"], r["chunk"]): r["samples"] for r in L.unwrapped(cut, ["key"], saved).collect()}
    assert ("b", 6) not in found and np.abs(np.array(found["b", 7]) - np.unwrap(phases["b", 3][4 * SIZE :])[:SIZE]).max() < 1e-9


def direct(phase, amplitude, lag, bins=18):
    n, total = np.zeros(bins, int), np.zeros(bins)
    for i, p in phase.items():
        a = amplitude.get(i - lag)
        if a is not None:
            k = min(int((p % (2 * np.pi)) / (2 * np.pi / bins)), bins - 1)
            n[k] += 1
            total[k] += a
    return n, total


def at_samples(signals, key):
    return {first * SIZE + i: v for (k, first), x in signals.items() if k == key for i, v in enumerate(x)}


def test_lag_curves_equal_direct_shifts(spark, phases):
    dice = np.random.default_rng(3)
    loud = {("p", 0): dice.random(88), ("q", 2): dice.random(48), ("q", 9): dice.random(160)}
    pairs = spark.createDataFrame([(a, b) for a in "abx" for b in "pqx"], "phase_key string, amplitude_key string")
    lags = [-19, -8, -3, 0, 1, 2, 8, 24]
    sums = saved(L.lag_sums(chunks_of(spark, phases, "phase_key"), chunks_of(spark, loud, "amplitude_key"), pairs, SIZE, lags))
    found = {(r["phase_key"], r["amplitude_key"], r["lag"], r["bin"]): (r["n"], r["total"]) for r in sums.collect()}
    curve = {(r["phase_key"], r["amplitude_key"], r["lag"]): r for r in L.lag_curve(sums, exclude=(2, 3)).collect()}
    for a in "ab":
        for b in "pq":
            for lag in lags:
                n, total = direct(at_samples(phases, a), at_samples(loud, b), lag)
                for k in range(18):
                    got = found.get((a, b, lag, k), (0, 0.0))
                    assert got[0] == n[k] and got[1] == pytest.approx(total[k], abs=1e-9), (a, b, lag, k)
                r = curve[a, b, lag]
                share = np.where(n > 0, total / np.maximum(n, 1), 0)
                share = share / share.sum()
                mi = (share * np.log((share + 1e-10) / (1 / 18 + 1e-10))).sum() / np.log(18)
                assert r["n"] == n.sum() and (r["mi"] is None if 2 <= abs(lag) <= 3 else r["mi"] == pytest.approx(mi))
    assert not {k for k in found if "x" in k[:2]}


def test_short_signals_as_trimmed_arrays(spark):
    """One signal of a few chunks: the shifted arrays lose their ends."""
    dice = np.random.default_rng(4)
    phase, loud = dice.uniform(-np.pi, np.pi, 24), dice.random(24)
    one = spark.createDataFrame([("a", "p")], "phase_key string, amplitude_key string")
    sums = L.lag_sums(chunks_of(spark, {("a", 5): phase}, "phase_key"), chunks_of(spark, {("p", 5): loud}, "amplitude_key"), one, SIZE, [-30, -5, 0, 5, 23, 24])
    found = {r["lag"]: (r["n"], r["mi"]) for r in L.lag_curve(sums).collect()}
    for lag in (-5, 0, 5, 23):
        p, a = (phase[lag:], loud[: len(loud) - lag]) if lag >= 0 else (phase[:lag], loud[-lag:])
        assert found[lag] == (len(p), pytest.approx(K.coupling(p[None], a[None])[0], abs=1e-12))
    assert found[24] == (0, None) and found[-30] == (0, None)


def test_pairs(spark):
    units = spark.createDataFrame([(1, 10, "left"), (1, 11, "right"), (1, 12, None), (2, 20, "left")], "session long, unit long, hemisphere string")
    channels = spark.createDataFrame([(1, "l", "left"), (1, "u", "unknown"), (1, "r", "right"), (3, "x", "left")], "session long, channel string, hemisphere string")
    found = {(r["unit"], r["channel"]) for r in L.hemisphere_pairs(units, channels, "session").collect()}
    assert found == {(10, "l"), (10, "u"), (11, "r"), (11, "u"), (12, "l"), (12, "u"), (12, "r")}
    assert L.hemisphere_pairs(units, channels, "session", matched=False).count() == 9
    assert L.hemisphere_pairs(units.limit(0), channels, "session").count() == 0


def test_queries_against_whole_signals(spark):
    """From the filtered chunks on, the queries against arrays on the driver."""
    chunks = {}
    for r in P.slow_phase(spark, SF).where("samples IS NOT NULL").collect():
        chunks.setdefault(r["mark"], {})[r["chunk"]] = r["samples"]
    value = {m: {c * P.SIZE + i: v for c, x in parts.items() for i, v in enumerate(x)} for m, parts in chunks.items()}
    pairs = {(r["unit"], r["channel"]) for r in P.pair_rule(spark, SF).collect()}
    sums = {}
    for r in points(spark, SF).collect():
        for mark, v in value.items():
            x = r["t"] / HOUR
            i, share = math.floor(x), x - math.floor(x)
            if (r["unit"], mark) in pairs and i in v and (share == 0 or i + 1 in v):
                step = (v.get(i + 1, v[i]) - v[i] + np.pi) % (2 * np.pi) - np.pi
                n, z = sums.get((r["unit"], mark), (0, 0))
                sums[r["unit"], mark] = n + 1, z + np.exp(1j * (v[i] + share * step))
    found = {(r["unit"], r["channel"]): r for r in P.pair_locking(spark, SF).collect()}
    assert found.keys() == sums.keys() and len(found) > 20
    for k, (n, z) in sums.items():
        assert found[k]["n"] == n and found[k]["mvl"] == pytest.approx(abs(z) / n, abs=2e-6) and found[k]["z"] == pytest.approx(0 if n < 2 else abs(z) ** 2 / n, abs=1e-4)
    curve = P.coupling_lags(spark, SF).collect()
    assert {r["lag"] for r in curve} == set(P.LAGS) and all(r["mi"] is None for r in curve if abs(r["lag"]) == 2) and all(0 <= r["mi"] < 1 for r in curve if r["mi"] is not None)
