"""Boosted trees against a plain version, and attributions against Shapley's formula over all sets of features."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from intervale.operators import trees as T
from intervale.sources.scratch import saved


@pytest.fixture(scope="module")
def table(spark):
    dice = np.random.default_rng(5)
    x = dice.standard_normal((240, 6))
    label = np.where(x[:, 1] + 0.5 * x[:, 4] > 0.4, 2, np.where(x[:, 2] > 0.3, 1, 0))
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))] + [(900, None, 1), (901, [0.0] * 6, None), (902, [0.0] * 5, 1)]
    return T.binned(spark.createDataFrame(rows, "unit long, samples array<double>, label long").repartition(4), 5, 8, saved)


@pytest.fixture(scope="module")
def forests(table):
    return T.boosted(table, 5, 3, depth=3, n_bins=8)


def plain(bins, y, classes, rounds, depth, n_bins):
    """Boosting row by row: margins of the rows it is grown on."""
    margins = np.zeros((len(bins), classes))
    for _ in range(rounds):
        p = T.softmax(margins)
        new = margins.copy()
        for k in range(classes):
            g, h = p[:, k] - (y == k), 2 * p[:, k] * (1 - p[:, k])

            def grow(rows, level, k=k, g=g, h=h):
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1)
                best = (0, None)
                for f in range(bins.shape[1]) if level < depth else []:
                    for c in range(n_bins - 1):
                        a, b = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                        if h[a].sum() >= 1 and h[b].sum() >= 1 and round(gain := score(a) + score(b) - score(rows), 9) > round(best[0], 9):
                            best = (gain, (a, b))
                if best[1] is None:
                    new[rows, k] -= 0.3 * g[rows].sum() / (h[rows].sum() + 1)
                else:
                    for part in best[1]:
                        grow(part, level + 1)

            grow(np.arange(len(bins)), 0)
        margins = new
    return margins


def test_folds_hold_each_label_alike(table):
    found = {}
    for r in table.collect():
        found.setdefault(r["label"], []).append(r["fold"])
    assert sum(map(len, found.values())) == 240
    assert all(max(np.bincount(f, minlength=5)) - min(np.bincount(f, minlength=5)) <= 1 for f in found.values())


def test_trees_equal_those_grown_row_by_row(table, forests):
    rows = table.collect()
    bins, y, fold = np.array([r["bins"] for r in rows]), np.array([r["label"] for r in rows]), np.array([r["fold"] for r in rows])
    for m in (0, 5):
        own = fold != m
        assert np.abs(forests[m].margins(bins[own]) - plain(bins[own], y[own], 3, 3, 3, 8)).max() < 1e-6
    share = np.mean([forests[f].margins(b[None])[0].argmax() == k for b, k, f in zip(bins, y, fold)])
    assert T.accuracy(table, forests) == pytest.approx(share) and share > 0.8


def expected(tree, bins, known, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    left, right = 2 * node + 1, 2 * node + 2
    if tree.feature[node] in known:
        return expected(tree, bins, known, right if bins[tree.feature[node]] > tree.cut[node] else left)
    a, b = tree.cover[left], tree.cover[right]
    return (a * expected(tree, bins, known, left) + b * expected(tree, bins, known, right)) / (a + b)


def test_attributions_equal_shapley_values(table, forests):
    forest, d = forests[-1], 6
    rows = {r["unit"]: r["bins"] for r in table.collect()}
    found = T.attributed(table, forest).collect()
    assert len(found) == 240
    for r in found:
        values = np.array(r["values"]).reshape(3, d)
        assert np.array(r["base"]) + values.sum(axis=1) == pytest.approx(np.array(r["margins"]), abs=1e-9)
    for r in found[:12]:
        values, bins = np.array(r["values"]).reshape(3, d), rows[r["unit"]]
        for k in range(3):
            worth = {s: sum(expected(trees[k], bins, s) for trees in forest.rounds) for n in range(d + 1) for s in combinations(range(d), n)}
            for j in range(d):
                want = sum(factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d) * (worth[tuple(sorted((*s, j)))] - v) for s, v in worth.items() if j not in s)
                assert values[k, j] == pytest.approx(want, abs=1e-9)


def test_importance_names_the_samples_that_tell(spark):
    dice = np.random.default_rng(6)
    x = dice.standard_normal((200, 5))
    rows = spark.createDataFrame([(i, v.tolist(), "up" if v[3] > 0 else "down") for i, v in enumerate(x)], "unit long, samples array<double>, label string")
    found = {r["sample"]: r for r in T.importance(rows, saved, rounds=2, n_bins=8).collect()}
    assert max(found, key=lambda j: found[j]["mean_abs"]) == 3 and found[3]["mean_abs"] > 5 * found[0]["mean_abs"] and found[0]["accuracy"] > 0.85
    assert T.importance(rows.limit(0), saved).count() == 0
