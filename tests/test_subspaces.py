"""Models from moments against the same models on raw rows, and small solvers against closed forms."""

import itertools
import math

import numpy as np
import pytest

from intervale.operators import models as M
from intervale.plans import signals, subspaces

DICE = np.random.default_rng(12)


def folds_of(z, n=4):
    parts = np.array_split(np.arange(len(z)), n)
    one = np.hstack([np.ones((len(z), 1)), z])
    return {k: one[i].T @ one[i] for k, i in enumerate(parts)}, parts


def direct_r2(z, p, train, test, penalty, rank):
    x, y = z[:, :p], z[:, p:]
    mx, my = x[train].mean(axis=0), y[train].mean(axis=0)
    w = np.linalg.solve((x[train] - mx).T @ (x[train] - mx) + penalty * np.eye(p), (x[train] - mx).T @ (y[train] - my))
    v = np.linalg.svd((x[train] - mx) @ w, full_matrices=False)[2].T[:, :rank]
    rest = y[test] - ((x[test] - mx) @ w @ v @ v.T + my)
    return 1 - (rest**2).sum() / ((y[test] - y[test].mean(axis=0)) ** 2).sum()


@pytest.fixture(scope="module")
def linked():
    x = DICE.normal(size=(240, 6))
    y = x[:, :2] @ DICE.normal(size=(2, 5)) + 0.3 * DICE.normal(size=(240, 5))
    return np.hstack([x, y])


def test_rank_scores_equal_those_on_rows(linked):
    folds, parts = folds_of(linked)
    found = M.rank_scores(folds, 6, [0.1, 10.0], [1, 2, 3])
    for f, test in enumerate(parts):
        train = np.setdiff1d(np.arange(240), test)
        for a, penalty in enumerate([0.1, 10.0]):
            for r, rank in enumerate([1, 2, 3]):
                assert found[a, r, f] == pytest.approx(direct_r2(linked, 6, train, test, penalty, rank))
    assert M.within_one_error(found[0].mean(axis=1).tolist(), (found[0].std(axis=1) / 4).tolist()) == 1


def test_nested_errors_choose_penalties_inside(linked):
    folds, parts = folds_of(linked)
    found = M.nested_errors(folds, 6, [0.1, 1e4], [1, 2])
    for f, test in enumerate(parts):
        train = np.setdiff1d(np.arange(240), test)
        assert found[f].tolist() == pytest.approx([1 - direct_r2(linked, 6, train, test, 0.1, r) for r in (1, 2)])
    assert M.smallest_within_error(found) == 1


def test_sub_moments_are_moments_of_chosen_channels(linked):
    left, right = np.array([0, 0, 3]), np.array([4, 1])
    one = np.hstack([np.ones((240, 1)), linked])
    z = np.hstack([np.ones((240, 1)), linked[:, left], linked[:, 6 + right]])
    assert M.sub_moments(one.T @ one, 6, left, right) == pytest.approx(z.T @ z)


def test_factor_dimension_and_curve():
    x = DICE.normal(size=(600, 2)) @ DICE.normal(size=(2, 8)) + 0.4 * DICE.normal(size=(600, 8))
    best, dims, values = M.factor_dimension(folds_of(x)[0], 4)
    assert best == 2 and dims <= 2 and (values[2:] < 1e-6).all()
    assert M.padded_curve(np.array([3.0, 1.0]), 4).tolist() == [0.75, 1.0, 1.0, 1.0] and len(M.padded_curve(np.ones(9), 4)) == 4


def test_nested_intercepts_against_dense_matrices(spark):
    rows, dense = [], {}
    for g in (0, 1):
        for u in range(14):
            own = DICE.normal() * 0.8
            blocks = []
            for b in range(3):
                mine = own + DICE.normal() * 0.5
                x = DICE.integers(0, 2, 5).astype(float)
                y = 1 + g + (0.5 + g) * x + mine + 0.6 * DICE.normal(size=5)
                blocks.append({"n": 5.0, "x": float(x.sum()), "y": float(y.sum()), "xx": float((x * x).sum()), "xy": float((x * y).sum()), "yy": float((y * y).sum())})
                dense.setdefault((g, u), []).append((x, y))
            rows.append((g, blocks))
    units = spark.createDataFrame(rows, "grp long, blocks array<struct<n:double,x:double,y:double,xx:double,xy:double,yy:double>>").repartition(3)
    fit = M.interaction_fit(units, "grp")

    def exact(r2, r1):
        residual, logdet, total, slopes, errors = 0.0, 0.0, 0, [], []
        for g in (0, 1):
            a, c, yy = np.zeros((2, 2)), np.zeros(2), 0.0
            for (gg, _), blocks in dense.items():
                if gg == g:
                    n = [len(x) for x, _ in blocks]
                    v = np.eye(sum(n)) + r2 * np.ones((sum(n), sum(n))) + r1 * np.kron(np.eye(len(n)), np.ones((5, 5)))
                    x = np.stack([np.ones(sum(n)), np.concatenate([b[0] for b in blocks])], axis=1)
                    y = np.concatenate([b[1] for b in blocks])
                    w = np.linalg.inv(v)
                    a, c, yy, total = a + x.T @ w @ x, c + x.T @ w @ y, yy + y @ w @ y, total + len(y)
                    logdet += np.linalg.slogdet(v)[1]
            b = np.linalg.solve(a, c)
            residual += yy - b @ c
            logdet += np.log(np.linalg.det(a))
            slopes.append(b[1])
            errors.append(np.linalg.inv(a)[1, 1])
        free = total - 4
        return -0.5 * (free * np.log(residual / free) + logdet), slopes, np.sqrt(np.array(errors) * residual / free)

    likelihood, slopes, errors = exact(*fit["ratios"])
    assert fit["likelihood"] == pytest.approx(likelihood) and fit["beta"].tolist() == pytest.approx(slopes) and fit["se"].tolist() == pytest.approx(errors.tolist())
    assert all(exact(r2, r1)[0] <= likelihood + 0.01 for r2 in np.geomspace(0.05, 20, 14) for r1 in np.geomspace(0.02, 10, 14))
    assert M.chi_square_tail(fit["wald"], 1) < 0.001


def test_tails_concentrations_and_assignments():
    assert M.chi_square_tail(3.0, 2) == pytest.approx(math.exp(-1.5)) and M.chi_square_tail(3.84, 1) == pytest.approx(math.erfc(math.sqrt(3.84 / 2)))
    k = np.array([0.0, 0.3, 2.0, 30.0])
    angle = np.linspace(-np.pi, np.pi, 20001)
    r = [np.trapezoid(np.cos(angle) * np.exp(c * np.cos(angle) - c), angle) / np.trapezoid(np.exp(c * np.cos(angle) - c), angle) for c in k]
    assert M.von_mises_concentration(np.array(r)) == pytest.approx(k, rel=1e-4, abs=1e-4)
    for rows, columns in ((4, 4), (3, 5), (5, 3)):
        table = DICE.integers(0, 30, (rows, columns))
        small, large = min(rows, columns), max(rows, columns)
        t = table if rows <= columns else table.T
        assert M.best_assignment(table) == max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))


def test_poisson_glm_solves_its_equations():
    x = np.hstack([np.ones((48, 1)), DICE.normal(size=(48, 2))])
    y = DICE.poisson(np.exp(1 + 0.5 * x[:, 1]))
    b, error, deviance = M.poisson_glm(x, y, np.ones(48))
    assert np.abs(x.T @ (y - np.exp(x @ b))).max() < 1e-6 and abs(b[1] - 0.5) < 5 * error[1] and deviance > 0


def test_cycles_need_a_steady_phase_and_enough_signal():
    t = np.arange(128) / 64.0
    phase = np.angle(np.exp(2j * np.pi * 4 * t))
    good = signals.cycles(phase, np.where(t < 1, 1.0, 1.2), least=2.0)
    assert len(good) >= 6 and all(g for *_, g in good) and all(13 <= b - a <= 17 for a, b, _, _ in good)
    bent = phase.copy()
    a, b, *_ = good[2]
    bent[a + 5] -= 1.0
    assert not [g for s, _, _, g in signals.cycles(bent, np.where(t < 1, 1.0, 1.2)) if s == a][0]
    assert not any(g for *_, g in signals.cycles(phase, np.ones(128)))


def test_lasso_meets_its_conditions(linked):
    m = sum(folds_of(linked)[0].values())
    w = M.lasso(m, 6, 0.05)
    x, y = linked[:, :6] - linked[:, :6].mean(axis=0), linked[:, 6:] - linked[:, 6:].mean(axis=0)
    slope = x.T @ (y - x @ w) / len(x)
    assert (np.abs(slope) <= 0.05 + 1e-6).all() and slope[w != 0] == pytest.approx(0.05 * np.sign(w[w != 0]), abs=1e-6) and (w == 0).any()
    assert M.lasso(m, 6, 0.0) == pytest.approx(np.linalg.lstsq(x, y, rcond=None)[0], abs=1e-6)


def test_equalised_draws_keep_the_smaller_mark_whole(spark):
    sf = "/root/testdata/sf0.001"
    p = subspaces._phases(spark, sf).where("mark IN ('click', 'view')").toPandas()
    found = {(r.unit, r.mark): (r.n, r.mvl) for r in subspaces.equalised_mvl_mean(spark, sf).collect()}
    checked = 0
    for (unit, mark), own in p.groupby(["unit", "mark"]):
        if (unit, mark) in found and found[unit, mark][0] == len(own):
            assert found[unit, mark][1] == pytest.approx(abs(np.exp(1j * own.phase).mean()), abs=2e-6)
            checked += 1
    assert checked > 3 and len(found) == 2 * len({u for u, _ in found})


def test_queries_have_sound_values(spark):
    sf = "/root/testdata/sf0.001"
    p = subspaces.null_space_permutation(spark, sf).toPandas()
    assert p.p.between(0, 1).all() and len(p) and (p.potent + p.outside > 0).all()
    assert subspaces.decode_logistic(spark, sf).where("accuracy < 0 OR accuracy > 1").count() == 0
    assert set(subspaces.rrr_bootstrap(spark, sf).groupBy("sampling").count().collect()[0].asDict()) == {"sampling", "count"}
    assert subspaces.phase_concentration(spark, sf).where("kappa < 0").count() == 0
