"""Queries without SQL against plain numpy on the rows of their tables, and models of groups on tables of uneven rows."""

import math

import numpy as np
import pandas as pd
import pytest

from intervale.operators import models as M
from intervale.plans import models, signals, subspaces

SF = "/root/testdata/sf0.001"
HALF, FOLDS = 32, 5
SCHEMA = "unit long, grp long, samples array<double>"


@pytest.fixture(scope="module")
def rows():
    t = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    return t.vec_id.to_numpy(), t.label.to_numpy(), np.stack(t.embedding.to_numpy()).astype(float)


def centred(x):
    return x - x.mean(axis=0)


def ridge(x, y, penalty):
    return np.linalg.solve(centred(x).T @ centred(x) + penalty * np.eye(x.shape[1]), centred(x).T @ centred(y))


def reduced(x, y, penalty, rank):
    w = ridge(x, y, penalty)
    v = np.linalg.svd(centred(x) @ w, full_matrices=False)[2][:rank].T
    return w @ v @ v.T


def fit_of(w, train, test, z):
    x, y = z[:, :HALF], z[:, HALF:]
    rest = y[test] - y[train].mean(axis=0) - (x[test] - x[train].mean(axis=0)) @ w
    return 1 - (rest**2).sum() / (centred(y[test]) ** 2).sum()


def by_fold(unit, z, make):
    """Fits of the held-out fold, each by the map that ``make(x, y)`` learns from the others."""
    found = []
    for f in range(FOLDS):
        train, test = unit % FOLDS != f, unit % FOLDS == f
        found.append(fit_of(make(z[train, :HALF], z[train, HALF:]), train, test, z))
    return np.array(found)


def test_ridge_and_reduced_rank_queries(spark, rows):
    unit, _, z = rows
    for r in models.ridge_map_cv(spark, SF).collect():
        direct = by_fold(unit, z, lambda x, y: ridge(x, y, r.penalty))
        assert (r.r2, r.se) == pytest.approx((direct.mean(), direct.std() / FOLDS), abs=1e-8)
    found = sorted(models.rrr_cs_dim(spark, SF).collect())
    direct = {r.rank: by_fold(unit, z, lambda x, y: reduced(x, y, 10.0, r.rank)) for r in found}
    for r in found:
        assert (r.r2, r.se) == pytest.approx((direct[r.rank].mean(), direct[r.rank].std() / FOLDS), abs=1e-8)
    means, errors = [direct[r.rank].mean() for r in found], [direct[r.rank].std() / FOLDS for r in found]
    best = int(np.argmax(means))
    assert [r.rank for r in found if r.chosen] == [min(r.rank for r in found if means[r.rank - 1] >= means[best] - errors[best])]


def test_rank_grid_and_nested_errors(spark, rows):
    unit, _, z = rows
    grid = subspaces.rrr_grid(spark, SF).collect()
    for r in [g for g in grid if g.penalty in (0.01, 100.0) and g.rank in (1, 4, 10)]:
        assert r.r2 == pytest.approx(by_fold(unit, z, lambda x, y: reduced(x, y, r.penalty, r.rank)).mean(), abs=1e-8)
    assert sum(g.chosen for g in grid) == 1
    errors = np.empty((FOLDS, 2))
    for f in range(FOLDS):
        train, test, others = unit % FOLDS != f, unit % FOLDS == f, [k for k in range(FOLDS) if k != f]
        inner = []
        for p in subspaces.PENALTIES:
            each = []
            for k in others:
                learn, held = train & (unit % FOLDS != k), unit % FOLDS == k
                each.append(fit_of(ridge(z[learn, :HALF], z[learn, HALF:], p), learn, held, z))
            inner.append(np.mean(each))
        best = subspaces.PENALTIES[int(np.argmax(inner))]
        errors[f] = [1 - fit_of(reduced(z[train, :HALF], z[train, HALF:], best, k), train, test, z) for k in (1, 5)]
    nse = {r.rank: r.nse for r in subspaces.rrr_nse(spark, SF).collect()}
    assert (nse[1], nse[5]) == pytest.approx(tuple(errors.mean(axis=0)), abs=1e-8)


def test_principal_components_and_their_dimensions(spark, rows):
    unit, grp, z = rows
    found = {r.unit: (r.pc1, r.pc2, r.pc3) for r in models.pca_scores(spark, SF).collect()}
    _, value, axes = np.linalg.svd(centred(z), full_matrices=False)
    direct = centred(z) @ axes[:3].T
    got = np.array([found[u] for u in unit])
    assert np.abs(got) == pytest.approx(np.abs(direct), abs=1e-7)
    for r in models.pca_dimensions(spark, SF).collect():
        own = z[grp == r.grp]
        e = np.linalg.svd(centred(own) if r.centred else own, compute_uv=False) ** 2
        assert r.n == len(own) and r.width == z.shape[1]
        assert r.participation == pytest.approx(e.sum() ** 2 / (e**2).sum())
        assert r.dimensions == np.searchsorted(np.cumsum(e) / e.sum(), 0.9 - 1e-12) + 1


def spaces(z):
    """Directions of the rank-3 map, and the principal axes of the first halves outside them."""
    x, y = z[:, :HALF], z[:, HALF:]
    left = np.linalg.svd(reduced(x, y, 10.0, 3))[0]
    potent, outside = left[:, :3], np.eye(HALF) - left[:, :3] @ left[:, :3].T
    value, vector = np.linalg.eigh(outside @ np.cov(x.T, bias=True) @ outside)
    return potent, outside, vector[:, np.argsort(value)[::-1][:3]]


def test_null_space_queries(spark, rows):
    _, grp, z = rows
    potent, outside, axes = spaces(z)
    split = {r.grp: r for r in models.null_space_split(spark, SF).collect()}
    permuted = {r.grp: r for r in subspaces.null_space_permutation(spark, SF).collect()}
    assert set(split) == set(permuted) == set(grp)
    for g in split:
        cov = np.cov(z[grp == g, :HALF].T, bias=True)
        energy = (np.trace(potent.T @ cov @ potent), np.trace(outside @ cov @ outside))
        assert (split[g].potent, split[g].outside) == pytest.approx(energy, rel=1e-6)
        assert split[g].ratio == pytest.approx(energy[1] / energy[0] / (29 / 3), rel=1e-6)
        assert (permuted[g].potent, permuted[g].outside) == pytest.approx(energy, rel=1e-6)
        # three of 32 directions at random hold three 32nds of the energy on average
        assert permuted[g].permuted_mean == pytest.approx(sum(energy) * 3 / 32, rel=0.1)
    for r in subspaces.null_space_centroids(spark, SF).collect():
        mean = z[grp == r.grp].mean(axis=0)
        part = mean[:HALF] if r.epoch == "first" else mean[HALF:]
        if r.space == "potent":
            assert abs(r.value) <= np.linalg.norm(potent.T @ part) + 1e-8
        else:
            assert abs(r.value) == pytest.approx(abs(axes[:, r.direction] @ part), abs=1e-6)


def test_populations_split_by_a_flag(spark, rows):
    _, grp, z = rows
    spread = z.var(axis=0)
    source, target = np.flatnonzero(spread > np.median(spread)), np.flatnonzero(spread <= np.median(spread))
    left, value, _ = np.linalg.svd(ridge(z[:, source], z[:, target], 10.0))
    rank = min(int((np.cumsum(value**2) / (value**2).sum() <= 0.9).sum()) + 1, len(source) - 1)
    tuned = centred(np.stack([z[grp == g][:, source].mean(axis=0) for g in np.unique(grp)]))
    energy = [((tuned @ left[:, :rank]) ** 2).sum(), ((tuned @ left[:, rank:]) ** 2).sum()]
    found = {r.sample: r for r in subspaces.null_space_by_flag(spark, SF).collect()}
    assert found[None].rank == rank and (found[None].potent, found[None].outside) == pytest.approx(energy, rel=1e-6)
    assert set(found) == {None, *source.tolist()}
    for k, s in enumerate(source):
        assert found[s].potent == pytest.approx(((tuned[:, k : k + 1] @ left[k : k + 1, :rank]) ** 2).sum(), rel=1e-6)


def test_groups_of_uneven_rows_are_all_accounted_for(spark):
    dice = np.random.default_rng(4)
    data = [(i, i % 40, dice.normal(size=6).tolist()) for i in range(400)] + [(400 + i, i % 3, dice.normal(size=4).tolist()) for i in range(9)]
    data += [(500, 1, None), (501, 1, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (502, None, [1.0] * 6), (503, 2, [])]
    s = spark.createDataFrame(data, SCHEMA).repartition(5)
    fit = lambda grp, width, own: [(grp, width, int(own[0][0, 0]), (own[0][0, 1:] / own[0][0, 0]).tolist())]
    found = {(r.grp, r.width): r for r in M.solved(M.moments(s, "grp"), fit, "grp long, width long, n long, mean array<double>").collect()}
    want = {}
    for _, g, x in data:
        if g is not None and x and None not in x:
            want.setdefault((g, len(x)), []).append(x)
    assert set(found) == set(want) and len(want) == 43
    for k, x in want.items():
        assert found[k].n == len(x) and found[k].mean == pytest.approx(np.mean(x, axis=0).tolist())
    six = np.array([[1.0, *x] for _, g, x in data if g is not None and x and len(x) == 6 and None not in x])
    assert M.whole(M.moments(s, "grp")) == pytest.approx(six.T @ six)


def test_folds_meet_in_their_group_and_empty_tables_give_nothing(spark):
    dice = np.random.default_rng(5)
    data = [(i, i % 3, dice.normal(size=3).tolist()) for i in range(60)]
    s = spark.createDataFrame(data, SCHEMA).selectExpr("unit", "grp * 5 + unit % 5 AS key", "samples")
    fit = lambda grp, width, own: [(grp, sorted(own), [m[0, 0] for m in own.values()])]
    found = M.solved(M.moments(s, "key"), fit, "grp long, folds array<double>, n array<double>", 5).collect()
    assert sorted((r.grp, r.folds, r.n) for r in found) == [(g, [0.0, 1, 2, 3, 4], [4.0] * 5) for g in range(3)]
    empty = M.moments(s.limit(0), "key")
    assert M.whole(empty) is None and M.solved(empty, fit, "grp long, folds array<double>, n array<double>", 5).count() == 0


def test_null_space_axes_do_not_depend_on_rounding():
    dice = np.random.default_rng(6)
    x = dice.normal(size=(300, 8)) * np.arange(1, 9)
    w = dice.normal(size=(8, 2)) @ dice.normal(size=(2, 5))
    scatter = np.cov(x.T)
    _, one = M.split_spaces(w, scatter=scatter)
    _, two = M.split_spaces(w + 1e-13 * dice.normal(size=w.shape), scatter=scatter)
    assert one == pytest.approx(two, abs=1e-8) and np.abs(one.T @ w).max() < 1e-10
    assert (np.diff(np.diag(one.T @ scatter @ one)) <= 0).all()


def test_phase_queries_solve_their_equations(spark):
    p = subspaces._phases(spark, SF).select("unit", "phase").toPandas()
    angle = 2 * np.pi * (np.arange(24) + 0.5) / 24
    found = {r.unit: r for r in models.poisson_glm_phase(spark, SF).collect()}
    concentrated = {r.unit: r for r in subspaces.phase_concentration(spark, SF).collect()}
    for unit, own in p.groupby("unit"):
        counts = np.bincount(np.minimum((own.phase / (2 * np.pi / 24)).astype(int), 23), minlength=24).astype(float)
        r = found[unit]
        shape = np.exp(r.strength * np.cos(angle - r.preferred))
        rate = shape * counts.sum() / shape.sum()
        # at the maximum the residuals have no harmonic left
        assert [((counts - rate) * f(angle)).sum() for f in (np.sin, np.cos)] == pytest.approx([0, 0], abs=1e-5 * max(counts.sum(), 1))
        deviance = 2 * (np.where(counts > 0, counts * np.log(np.maximum(counts, 1e-12) / rate), 0) - counts + rate).sum()
        assert r.deviance == pytest.approx(deviance, abs=1e-6) and r.delta_aic == pytest.approx(r.lr - 4) and r.p == pytest.approx(math.exp(-r.lr / 2))
        z = np.exp(1j * own.phase).mean()
        c = concentrated[unit]
        assert c.n == len(own) and c.direction == pytest.approx(np.angle(z) % (2 * np.pi), abs=1e-9)
        grid = (np.arange(20_000) + 0.5) * np.pi / 20_000
        weight = np.exp(c.kappa * (np.cos(grid) - 1))
        assert (weight * np.cos(grid)).sum() / weight.sum() == pytest.approx(abs(z), abs=1e-6)


def test_line_and_trend_are_taken_out(spark, rows):
    unit, _, z = rows
    found = {r.unit: np.array(r.samples) for r in signals.line_removed(spark, SF).collect()}
    assert set(found) == set(unit)
    t = np.arange(64)
    wave = np.stack([np.sin(2 * np.pi * 12 * t / 64), np.cos(2 * np.pi * 12 * t / 64)])
    flat = np.stack([v - np.polyval(np.polyfit(t, v, 1), t) for v in z])
    got = np.stack([found[u] for u in unit])
    assert ((got @ wave.T) ** 2).sum() < 0.5 * ((flat @ wave.T) ** 2).sum()
    low = np.stack([np.cos(2 * np.pi * 3 * t / 64), np.sin(2 * np.pi * 3 * t / 64)])
    assert ((got @ low.T) ** 2).sum() == pytest.approx(((flat @ low.T) ** 2).sum(), rel=0.25)


def test_decoder_counts_every_segment_once(spark, rows):
    unit, _, _ = rows
    found = subspaces.decode_logistic(spark, SF).collect()
    assert sum(r.n for r in found) == len(unit) and sorted(r.fold for r in found) == [0, 1, 2]
