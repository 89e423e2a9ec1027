"""Discriminants and kernel machines against numpy on whole arrays."""

import numpy as np
import pytest

from intervale.operators import discriminants as D
from intervale.sources.scratch import saved


@pytest.fixture(scope="module")
def data(spark):
    dice = np.random.default_rng(1)
    label = dice.integers(0, 3, 240)
    x = dice.standard_normal((240, 5)) @ dice.standard_normal((5, 5)) + np.eye(3, 5)[label] * 3
    rows = [(i, v.tolist(), f"c{k}") for i, (v, k) in enumerate(zip(x, label))] + [(900, None, "c1"), (901, [0.0] * 5, None), (902, [0.0, None, 0.0, 0.0, 0.0], "c0")]
    return D.stratified(spark.createDataFrame(rows, "unit long, samples array<double>, label string").repartition(4), 4, saved)


def arrays(table):
    rows = table.collect()
    return np.array([r["samples"] for r in rows]), np.array([int(r["label"][1:]) for r in rows]), np.array([r["fold"] for r in rows])


def test_discriminant_equals_numpy(data):
    x, y, fold = arrays(data)
    assert len(x) == 240 and all(np.ptp(np.bincount(fold[y == k])) <= 1 for k in range(3))
    hits = {}
    for m in range(4):
        tx, ty = x[fold != m], y[fold != m]
        mean = np.array([tx[ty == k].mean(axis=0) for k in range(3)])
        within = sum((tx[ty == k] - mean[k]).T @ (tx[ty == k] - mean[k]) for k in range(3)) / (len(tx) - 3)
        inverse = np.linalg.inv(within)
        score = np.array([[v @ inverse @ mean[k] - 0.5 * mean[k] @ inverse @ mean[k] + np.log((ty == k).mean()) for k in range(3)] for v in x[fold == m]])
        hits[m] = ((fold == m).sum(), (score.argmax(axis=1) == y[fold == m]).sum())
    assert {r["fold"]: (r["n"], r["hit"]) for r in D.decode_discriminant(data, 4).collect()} == hits


def test_axes_are_generalised_eigenvectors(data):
    x, y, _ = arrays(data)
    moments = D.class_moments(data, ["c0", "c1", "c2"], 4).sum(axis=1)
    _, _, axes = D.discriminant(moments, 0.0)
    mean = np.array([x[y == k].mean(axis=0) for k in range(3)])
    within = sum((x[y == k] - mean[k]).T @ (x[y == k] - mean[k]) for k in range(3)) / (len(x) - 3)
    n = np.bincount(y)
    between = sum(n[k] * np.outer(mean[k] - x.mean(axis=0), mean[k] - x.mean(axis=0)) for k in range(3)) / len(x)
    assert axes.shape == (5, 2) and axes.T @ within @ axes == pytest.approx(np.eye(2), abs=1e-8)
    for a in axes.T:
        ratio = (a @ between @ a) / (a @ within @ a)
        assert between @ a == pytest.approx(ratio * within @ a, abs=1e-8)


def ring(spark):
    dice = np.random.default_rng(2)
    x = dice.standard_normal((300, 2))
    far = np.linalg.norm(x, axis=1)
    rows = [(i, v.tolist(), f"c{int(r > 1.2)}") for i, (v, r) in enumerate(zip(x, far))]
    return D.stratified(spark.createDataFrame(rows, "unit long, samples array<double>, label string").repartition(4), 4, saved)


def exact_machine(x, y, scale, cost):
    """Newton steps on the squared hinge loss in the exact kernel, with a one added to it."""
    k = np.exp(-scale * ((x[:, None] - x) ** 2).sum(axis=2)) + 1
    beta = np.zeros(len(x))
    for _ in range(30):
        act = 1 - y * (k @ beta) > 0
        new = np.zeros(len(x))
        new[act] = np.linalg.solve(k[np.ix_(act, act)] + np.eye(act.sum()) / (2 * cost), y[act])
        if np.abs(new - beta).max() < 1e-9:
            break
        beta = new
    return beta


def test_kernel_machine_is_near_the_exact_one(spark):
    """Within three hundredths of the exact kernel's accuracy, far above what a linear rule reaches on a ring."""
    data = ring(spark)
    x, y, fold = arrays(data)
    scale, hit = 1 / (2 * x.var()), 0
    for m in range(4):
        tx, ty = x[fold != m], np.where(y[fold != m] == 1, 1.0, -1.0)
        beta = exact_machine(tx, ty, scale, 1.0)
        k = np.exp(-scale * ((x[fold == m][:, None] - tx) ** 2).sum(axis=2)) + 1
        hit += ((k @ beta > 0) == (y[fold == m] == 1)).sum()
    found = D.decode_kernel(data, 4, size=200).collect()
    share = sum(r["hit"] for r in found) / sum(r["n"] for r in found)
    assert abs(share - hit / len(x)) < 0.03 and share > 0.9
    linear = D.decode_discriminant(data, 4).collect()
    assert share - sum(r["hit"] for r in linear) / len(x) > 0.2


def test_random_features_come_near_the_kernel():
    x = np.random.default_rng(4).standard_normal((40, 3))
    z = D.random_features(3, 4000, 0.3, 1)(x)
    assert np.abs(z @ z.T - 1 - np.exp(-0.3 * ((x[:, None] - x) ** 2).sum(axis=2))).max() < 0.08


def test_weights_stand_still_at_the_minimum(spark):
    data = ring(spark)
    weights, features, _ = D.kernel_machines(data, 4, size=30)
    x, y, fold = arrays(data)
    z = features(x[fold != 0])
    t = np.where(y[fold != 0] == 1, 1.0, -1.0)
    short = np.maximum(1 - t * (z @ weights[0, 1]), 0)
    assert np.abs(weights[0, 1] - 2 * (t * short) @ z).max() < 1e-4
