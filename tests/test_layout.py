"""Layouts keep neighbours together, and do not depend on partitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from intervale.operators import graph as G
from intervale.operators import layout as L
from intervale.operators import neighbours as N
from intervale.sources.scratch import saved


@pytest.fixture(scope="module")
def ring(spark):
    """Vectors along a closed curve in ten dimensions, and four far clusters."""
    dice = np.random.default_rng(1)
    t = np.linspace(0, 2 * np.pi, 160, endpoint=False)
    curve = np.stack([np.cos(t), np.sin(t), np.cos(2 * t), np.sin(2 * t)] + [0.05 * dice.standard_normal(160)] * 6, axis=1) * 5
    clusters = np.eye(10)[np.arange(160) % 4 + 5] * 30 + dice.standard_normal((160, 10)) * 0.5
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([curve, clusters]))]
    return spark.createDataFrame(rows, "unit long, samples array<double>")


def drawn(data, epochs, parts):
    near = saved(N.nearest_of_all(data.repartition(parts), 10, saved))
    edges = saved(G.symmetric(G.fuzzy_weights(near, 10)).repartition(parts))
    return saved(L.laid_out(edges, L.started(data.repartition(parts), saved), saved, epochs)), near


def test_neighbours_stay_neighbours(ring):
    layout, near = drawn(ring, 40, 4)
    found = L.kept_neighbours(layout, near, 6, saved).first()
    before = L.kept_neighbours(L.started(ring, saved), near, 6, saved).first()
    # by chance the share would be 0.03; principal components keep 0.22 of the neighbours, forty epochs 0.50
    assert found["n"] == 6 * 320 and found["share"] > 0.45 and found["share"] > 2 * before["share"]
    at = {r["unit"]: (r["x"], r["y"]) for r in layout.collect()}
    assert len(at) == 320 and all(np.isfinite(v).all() for v in at.values())


def test_partitions_do_not_matter(ring):
    one, two = (sorted(map(tuple, drawn(ring.where("unit < 60"), 5, parts)[0].collect())) for parts in (1, 7))
    assert one == two


def test_odd_inputs(spark, ring):
    empty = ring.limit(0)
    assert L.started(empty, saved).count() == 0
    alone = ring.where("unit = 3")
    edges = spark.createDataFrame([], "src long, dst long, w double")
    assert L.laid_out(edges, L.started(alone, saved), saved, 3).count() == 1
    same = spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(12)] + [(20, None)], "unit long, samples array<double>")
    layout, _ = drawn(same, 3, 2)
    assert len({(r["x"], r["y"]) for r in layout.collect()}) == 12
