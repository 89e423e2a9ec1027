"""Operators on hand-made cases, kernels against closed forms, and sources and sinks."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intervale.functions import circular, signals
from intervale.operators import graph, intervals, models, pointprocess, relational, resampling
from intervale.sources.scratch import saved
from intervale.sources import sinks, tables


def points(spark, rows):
    return spark.createDataFrame([(u, i, t, 1.0 * i) for i, (u, t) in enumerate(rows)], "unit long, point_id long, t long, value double")


@pytest.mark.parametrize(("closed", "n"), [("both", 3), ("left", 2), ("right", 2), ("neither", 1)])
def test_window_closure(spark, closed, n):
    p = points(spark, [(1, 0), (1, 5), (1, 10), (1, 11), (2, 5)])
    w = spark.createDataFrame([(1, 7, 0, 10), (3, 8, 0, 10)], "unit long, window long, start long, end long")
    found = {r.window: r.n for r in intervals.window_counts(p.select("unit", "t"), w, ["unit"], "window", 4, closed).collect()}
    assert found == {7: n, 8: 0}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 2), st.integers(-50, 50)), max_size=25), st.lists(st.tuples(st.integers(1, 2), st.integers(-50, 50), st.integers(0, 40)), max_size=8), st.integers(1, 60))
def test_range_join_equals_nested_loops(spark, rows, windows, bucket):
    p = points(spark, rows)
    w = spark.createDataFrame([(u, i, a, a + n) for i, (u, a, n) in enumerate(windows)], "unit long, window long, start long, end long")
    found = sorted((r.window, r.t) for r in intervals.range_join(p.select("unit", "t"), w, ["unit"], bucket, "left").collect())
    assert found == sorted((i, t) for i, (u, a, n) in enumerate(windows) for v, t in rows if u == v and a <= t < a + n)


def test_as_of_and_interpolation(spark):
    p = points(spark, [(1, -1), (1, 0), (1, 5), (1, 10), (1, 12)])
    marks = spark.createDataFrame([(1, 0, 0.0), (1, 10, 1.0)], "unit long, t long, value double")
    found = {r.t: r.k for r in intervals.as_of(p.select("unit", "point_id", "t"), marks.select("unit", "t", F.col("value").alias("k")), "unit", ["k"]).collect()}
    assert found == {-1: None, 0: 0.0, 5: 0.0, 10: 1.0, 12: 1.0}
    blend = {r.t: r.value for r in intervals.interpolated(p, marks, "unit").collect()}
    assert blend == {-1: None, 0: 0.0, 5: 0.5, 10: 1.0, 12: None}


def test_interval_metrics_of_few_points(spark):
    found = {r.unit: r for r in pointprocess.interval_metrics(points(spark, [(1, 0), (2, 0), (2, 10), (3, 0), (3, 10), (3, 30), (4, 5), (4, 5), (4, 5)]), 1, 15.0, 5.0, saved).collect()}
    assert found[1].cv is None and found[2].cv is None and found[4].cv is None and found[4].rate is None
    assert found[3].cv == pytest.approx(5 / 15) and found[3].cv2 == pytest.approx(2 / 3) and found[3].lv == pytest.approx(1 / 3) and found[3].burst_share == 0.5


def test_correlogram_drops_coincident_points(spark):
    p = points(spark, [(1, 0), (1, 0), (1, 10), (1, 23)])
    found = {r.bin: r.n for r in pointprocess.correlogram(p, p, 20, 5).collect()}
    assert found == {1: 1, 2: 2, 6: 3}


def test_bursts_drop_an_open_run(spark):
    p = points(spark, [(1, t) for t in range(7)]).withColumn("value", F.element_at(F.array(*map(F.lit, [0.0, 1.0, 1.0, 0.0, 1.0, 1.0, 1.0])), (F.col("t") + 1).cast("int")))
    assert [(r.start, r.n) for r in pointprocess.bursts(p, F.col("value") > 0.5, 2, saved).collect()] == [(1, 2)]


def test_midranks_auc_and_chi_square(spark):
    df = spark.createDataFrame([(1, 1.0, True), (2, 2.0, True), (3, 2.0, False), (4, 3.0, False)], "id long, v double, g boolean").withColumn("s", F.lit(1))
    assert sorted(r["rank"] for r in relational.midranks(df, "v", ["s"]).collect()) == [1.0, 2.5, 2.5, 4.0]
    assert relational.mann_whitney(df, "v", F.col("g"), ["s"]).first().auc == pytest.approx(0.125)
    one = relational.chi_square(relational.crosstab(df, "g", "s"), "g", "s").first()
    assert one.chi2 is None and one.dof == 0
    assert relational.adjusted_rand(df, "g", "g").first().ari == 1.0


def test_benjamini_hochberg_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "id long, p double")
    assert {r.id: r.q and round(r.q, 6) for r in relational.benjamini_hochberg(df, "p", "id", saved).collect()} == {1: 0.03, 2: 0.04, 3: None, 4: 0.04}


def test_shuffles_keep_strata(spark):
    df = spark.createDataFrame([(u, i, "ab"[i % 2], float(i)) for u in (1, 2) for i in range(6)], "unit long, point_id long, mark string, value double")
    found = resampling.permuted(df, ["unit"], "mark", "point_id", range(1, 4))
    counts = {(r.unit, r.replicate, r.mark): r["count"] for r in found.groupBy("unit", "replicate", "mark").count().collect()}
    assert len(counts) == 2 * 4 * 2 and set(counts.values()) == {3}


def test_rayleigh_of_uniform_and_locked_phases(spark):
    even = spark.range(100).select((F.col("id") / 100 * 2 * math.pi).alias("phase"))
    r = even.agg(circular.resultant(F.col("phase"))).first()[0]
    assert r == pytest.approx(0, abs=1e-9)
    z, p = circular.rayleigh(F.lit(100), F.lit(1.0))
    assert spark.range(1).select(z, p).first()[:] == (100.0, pytest.approx(0, abs=1e-6))


def test_filters_pass_their_band_and_stop_the_rest():
    t = np.arange(4000) / 400.0
    inside, outside = np.sin(2 * np.pi * 6 * t)[None], np.sin(2 * np.pi * 60 * t)[None]
    b, a = signals.butterworth(4, 4, 8, 400)
    assert np.abs(signals.zero_phase(b, a, inside) - inside)[0, 800:-800].max() < 0.05
    assert np.abs(signals.zero_phase(b, a, outside))[0, 800:-800].max() < 0.01
    assert np.abs(signals.without_line(outside, 60, 400))[0, 1500:-1500].max() < 0.05
    assert np.allclose(np.abs(signals.analytic(inside))[0, 400:-400], 1, atol=0.02)
    with pytest.raises(ValueError):
        signals.butterworth(4, 8, 4, 400)


def test_synthetic_recording_peaks_at_its_rhythm():
    dice = np.random.default_rng(0)
    t = np.arange(60 * 400) / 400.0
    x = (np.sin(2 * np.pi * 6 * t) + 0.5 * dice.normal(size=len(t)))[None]
    power = signals.spectrogram(x, 800, 400).mean(axis=(0, 1))
    assert np.fft.rfftfreq(800, 1 / 400)[power.argmax()] == 6
    freqs = np.array([3.0, 6.0, 12.0, 24.0])
    assert freqs[signals.wavelet_power(x[:, :4000], freqs, 400, real=False).mean(axis=(0, 2)).argmax()] == 6


def test_coupling_of_locked_and_flat_amplitudes():
    phase = np.linspace(-np.pi, np.pi, 3600, endpoint=False)[None]
    assert signals.coupling(phase, np.ones_like(phase))[0] == pytest.approx(0, abs=1e-6)
    assert signals.coupling(phase, 1 + np.cos(phase))[0] > 0.05


def test_moments_give_the_same_models_as_the_rows(spark):
    dice = np.random.default_rng(1)
    x = dice.normal(size=(400, 3))
    y = x @ dice.normal(size=(3, 2)) + 0.1 * dice.normal(size=(400, 2))
    rows = [(i, i % 5, np.hstack([a, b]).tolist()) for i, (a, b) in enumerate(zip(x, y))]
    folds = models.matrices(models.moments(spark.createDataFrame(rows, "unit long, fold long, samples array<double>").repartition(3), "fold"))
    whole = sum(folds.values())
    xc, yc = x - x.mean(axis=0), y - y.mean(axis=0)
    assert np.allclose(models.ridge(whole, 3, 2.0), np.linalg.solve(xc.T @ xc + 2 * np.eye(3), xc.T @ yc))
    test = np.arange(400) % 5 == 0
    w = models.ridge(whole - folds[0], 3, 1.0)
    predicted = (x[test] - x[~test].mean(axis=0)) @ w + y[~test].mean(axis=0)
    assert models.r_squared(folds[0], whole - folds[0], 3, w) == pytest.approx(1 - ((y[test] - predicted) ** 2).sum() / ((y[test] - y[test].mean(axis=0)) ** 2).sum())
    assert models.cross_validated(folds, lambda a, b: models.r_squared(b, a, 3, models.reduced_rank(a, 3, 0.1, 2)))[0] > 0.95
    mean, parts, values = models.principal(whole, 2)
    assert np.allclose(np.abs(parts @ parts.T), np.eye(2), atol=1e-9) and values[0] == pytest.approx(np.linalg.eigvalsh(np.cov(np.hstack([x, y]).T, ddof=0))[-1])


def test_factor_model_finds_its_dimension():
    dice = np.random.default_rng(2)
    load = dice.normal(size=(8, 2)) * 2
    x = dice.normal(size=(3000, 2)) @ load.T + dice.normal(size=(3000, 8)) * 0.5
    of = lambda a: np.hstack([np.ones((len(a), 1)), a]).T @ np.hstack([np.ones((len(a), 1)), a])
    train, test = of(x[:2000]), of(x[2000:])
    fits = [models.gaussian_fit(*models.factor_analysis(models.covariance(train)[1], q), train, test) for q in range(4)]
    assert fits[2] > fits[1] + 0.1 > fits[0] and abs(fits[3] - fits[2]) < 0.05


def test_poisson_phase_and_mixture_and_shape():
    phase = 2 * np.pi * (np.arange(24) + 0.5) / 24
    b, deviance, null = models.poisson_phase(np.exp(1 + 0.8 * np.cos(phase - 1.2))[None] * 100)
    assert np.arctan2(b[0, 1], b[0, 2]) == pytest.approx(1.2, abs=1e-3) and deviance[0] == pytest.approx(0, abs=1e-6) and null[0] > 10
    x = np.linspace(-5, 10, 300)
    weight, mean, sd = models.two_gaussians(x, 1000 * (np.exp(-0.5 * x**2) + np.exp(-0.5 * (x - 5) ** 2)))
    assert mean == pytest.approx([0, 5], abs=0.1) and models.antimode(weight, mean, sd) == pytest.approx(2.5, abs=0.1)
    t = np.arange(50) + 0.5
    p, r2 = models.fitted_shape(t, models.rise_and_decay(t, np.array([20, 2, 10, 1, 0.5, 3, 1, 2.0])))
    assert r2 > 0.98 and math.isnan(models.fitted_shape(t, np.zeros(50))[1])


def test_random_intercepts(spark):
    dice = np.random.default_rng(3)
    rows = []
    for u in range(60):
        own = dice.normal() * 2
        x = dice.integers(0, 2, 20).astype(float)
        y = 1 + 0.7 * x + own + dice.normal(size=20)
        rows.append((u, 20.0, x.sum(), y.sum(), (x * x).sum(), (x * y).sum(), (y * y).sum()))
    found = models.random_intercept(spark.createDataFrame([tuple(map(float, r)) for r in rows], "unit double, n double, x double, y double, xx double, xy double, yy double"), [0.0, 1.0, 4.0, 16.0])
    best = max(found, key=lambda r: r["likelihood"])
    assert best["ratio"] == 4.0 and best["beta"] == pytest.approx(0.7, abs=0.2) and best["se"] < found[0]["se"]


def test_communities_of_two_cliques(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 5) for b in range(a + 1, base + 5)] + [(4, 10, 0.1)]
    df = spark.createDataFrame(edges, "src long, dst long, w double")
    labels = {r.unit: r.label for r in graph.communities(df, saved).collect()}
    assert len({labels[i] for i in range(5)}) == 1 and len(set(labels.values())) == 2
    sides = {r.unit: r.side for r in graph.bisected(df, saved).collect()}
    assert len({sides[i] for i in range(5)}) == 1 and len({sides[i] for i in range(10, 15)}) == 1 and sides[0] != sides[12]


def test_levels_join_communities_and_spectrum_equals_numpy(spark):
    # a ring of eight cliques: greedy moves find the cliques, and their modularity is that of the formula
    n, edges = 8, []
    for c in range(n):
        edges += [(10 * c + a, 10 * c + b, 1.0) for a in range(4) for b in range(a + 1, 4)] + [(10 * c + 3, 10 * ((c + 1) % n), 0.5)]
    edges = [(min(a, b), max(a, b), w) for a, b, w in edges]
    df = saved(spark.createDataFrame(edges, "src long, dst long, w double"))
    found = graph.communities(df, saved, [1.0])
    labels = {r.unit: r.label for r in found.collect()}
    assert len(labels) == 4 * n and all(len({labels[10 * c + a] for a in range(4)}) == 1 for c in range(n))
    ids = sorted(labels)
    w = np.zeros((len(ids), len(ids)))
    for a, b, x in edges:
        w[ids.index(a), ids.index(b)] = w[ids.index(b), ids.index(a)] = x
    k = w.sum(axis=1)
    same = np.array([[labels[a] == labels[b] for b in ids] for a in ids])
    want = ((w - np.outer(k, k) / k.sum()) * same).sum() / k.sum()
    assert graph.modularity(df, found.select("unit", "label")).first().modularity == pytest.approx(want)
    embedding, values = graph.spectral_embedding(df, 5, saved)
    norm = w / np.sqrt(np.outer(k, k))
    exact = np.sort(np.linalg.eigvalsh(norm))[::-1]
    assert values[:3] == pytest.approx(exact[:3], abs=2e-3)
    x = np.array([r.x[:3] for r in sorted(embedding.collect(), key=lambda r: r.unit)])
    assert np.abs(norm @ x - x * values[:3]).max() < 0.05


def test_sources_and_sinks(spark, tmp_path):
    wide = spark.createDataFrame([(1, "1.5", "x", "3")], "id long, w0 string, w1 string, w2 string")
    assert tables.wide_to_samples(wide, "w").first().samples == [1.5, None, 3.0]
    with pytest.raises(ValueError):
        tables.numbered_columns(["w0", "w2"], "w")
    assert tables.with_missing(wide, {"flag": "boolean"}).first().flag is None
    chunks = spark.createDataFrame([(0, [0.0, 1.0, 2.0]), (3, [3.0, 4.0])], "i0 long, samples array<double>")
    assert [(r.i0, r.samples) for r in tables.chunked_range(chunks, 1, 4).orderBy("i0").collect()] == [(1, [1.0, 2.0]), (3, [3.0])]
    calls = []
    make = lambda: calls.append(1) or wide
    for parameters in ({"a": 1}, {"a": 1}, {"a": 2}):
        assert sinks.materialised(spark, str(tmp_path), "t", parameters, make, ("id",)).count() == 1
    assert len(calls) == 2
    sinks.save_csv(sinks.with_provenance(wide, made="test"), str(tmp_path / "csv"), ["id", "provenance", "none"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["id", "provenance"]
    assert not sinks.save_if_any(wide.limit(0), str(tmp_path / "empty"))
