"""Silhouettes, profiles and shares against brute force, and a grid over planted clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale.operators import tuning as T
from intervale.sources.scratch import saved


def brute(x, labels):
    out = []
    for i, v in enumerate(x):
        far = ((x - v) ** 2).sum(axis=1)
        mean = {k: far[[j for j in range(len(x)) if labels[j] == k and j != i]] for k in set(labels)}
        own, others = mean[labels[i]], [m.mean() for k, m in mean.items() if k != labels[i]]
        out.append(0.0 if not len(own) or not others else (min(others) - own.mean()) / max(min(others), own.mean()))
    return out


@pytest.mark.parametrize("sent", [T.SENT, 8])
def test_silhouettes_equal_brute_force(spark, monkeypatch, sent):
    """With all clusters at once, and one or two a block."""
    monkeypatch.setattr(T, "SENT", sent)
    dice = np.random.default_rng(1)
    labels = [*dice.integers(0, 5, 119).tolist(), 9]  # 9 has one row
    x = dice.standard_normal((120, 4)) + np.array(labels)[:, None]
    rows = [(i, v.tolist(), k) for i, (v, k) in enumerate(zip(x, labels))] + [(500, [1.0] * 4, None), (501, None, 1), (502, [1.0] * 3, 1)]
    found = {r["unit"]: r["silhouette"] for r in T.silhouettes(spark.createDataFrame(rows, "unit long, samples array<double>, label long").repartition(3), saved).collect()}
    assert found.keys() == set(range(120)) and [found[i] for i in range(120)] == pytest.approx(brute(x, labels), abs=1e-9)


def test_silhouettes_of_one_cluster_and_of_none(spark):
    rows = spark.createDataFrame([(i, [float(i)], "a") for i in range(4)], "unit long, samples array<double>, label string")
    assert {r["silhouette"] for r in T.silhouettes(rows, saved).collect()} == {0.0}
    assert T.silhouettes(rows.limit(0), saved).count() == 0


def test_profiles_and_shares(spark):
    rows = [(1, 1.0, 5.0, 3.0, "a"), (1, 3.0, 5.0, 3.0, "a"), (1, 9.0, 5.0, 3.0, "b"), (2, 4.0, 1.0, 3.0, "a"), (2, 4.0, 1.0, 3.0, "b"), (3, 4.5, 0.0, 3.0, "b"), (None, 0.0, 0.0, 0.0, "c")]
    df = spark.createDataFrame(rows, "label long, x double, y double, flat double, source string")
    medians = np.array([[3.0, 5.0, 3.0], [4.0, 1.0, 3.0], [4.5, 0.0, 3.0]])
    z = (medians - medians.mean(axis=0)) / np.where(medians.std(axis=0) > 0, medians.std(axis=0), 1)
    want = min(np.linalg.norm(z[a] - z[b]) for a in range(3) for b in range(a))
    assert T.least_profile_distance(df, ["x", "y", "flat"], saved) == pytest.approx(want)
    assert T.least_profile_distance(df.where("label = 1"), ["x"], saved) is None
    assert T.largest_share(df, "source") == 1.0 and T.largest_share(df.where("label < 3"), "source") == pytest.approx(2 / 3)


def test_grid_finds_planted_clusters(spark):
    dice = np.random.default_rng(3)
    kind = np.arange(90) % 3
    x = dice.standard_normal((90, 5)) * 0.3 + np.eye(5)[kind] * 8
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "unit long, samples array<double>")
    features = rows.select("unit", F.get("samples", 0).alias("f"), F.get("samples", 1).alias("g"), (F.col("unit") % 2).alias("source"))
    found = T.grid(rows, features, ["f", "g"], "source", [10], [0.5], [1, 2], saved).collect()
    assert [(r["neighbours"], r["clusters"]) for r in found] == [(10, 3)]
    for r in found:
        assert r["stability"] == 1.0 and r["modularity"] == pytest.approx(2 / 3, abs=0.02) and r["silhouette"] > 0.9 and r["largest_share"] == pytest.approx(0.5, abs=0.02) and r["least_profile"] > 1
