"""Neighbour descent against brute force, exact search, and vectors that cannot be compared."""

import math

import numpy as np
import pytest

from intervale.operators import neighbours as N
from intervale.sources.scratch import saved

SCHEMA = "unit long, samples array<double>, distance string"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), "x") for i, v in enumerate(x)], SCHEMA).repartition(4)


def brute(rows, k):
    """(src, dst, place) of all vectors by distance to nine decimals, then unit."""
    ids, x = np.array([u for u, _ in rows]), np.array([v for _, v in rows])
    out = set()
    for u, v in rows:
        far = np.round(np.sqrt(((x - v) ** 2).sum(axis=1)), 9)
        order = [i for i in np.lexsort((ids, far)) if ids[i] != u][:k]
        out |= {(u, int(ids[i]), place + 1) for place, i in enumerate(order)}
    return out


def points(kind, n, d, seed=1):
    dice = np.random.default_rng(seed)
    if kind == "uniform":
        return dice.random((n, d))
    return (dice.standard_normal((30, d)) * 3)[dice.integers(30, size=n)] + dice.standard_normal((n, d))


@pytest.mark.parametrize(("kind", "d"), [("uniform", 24), ("clustered", 48)])
def test_recall(spark, kind, d):
    x = points(kind, 2500, d)
    found = N.nearest_of_all(frame(spark, x), 8, saved, size=128).collect()
    want = brute(list(enumerate(x)), 8)
    pairs = {(a, b) for a, b, _ in want}
    assert len(found) == len(want)
    assert sum((r["src"], r["dst"]) in pairs for r in found) / len(want) > 0.93
    for r in found[:500]:
        assert r["distance"] == pytest.approx(np.linalg.norm(x[r["src"]] - x[r["dst"]]))


def test_recall_on_the_test_table(spark):
    from pyspark.sql import functions as F

    x = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("unit"), F.col("embedding").cast("array<double>").alias("samples"))
    found = {(r.src, r.dst) for r in N.nearest_of_all(x, 8, saved, size=256).select("src", "dst").collect()}
    exact = {(r.src, r.dst) for r in N.nearest(x, x.where("unit % 10 = 0"), 8).select("src", "dst").collect()}
    assert len({s for s, _ in found}) == x.count() and len(exact & found) / len(exact) > 0.93


def test_one_run_is_exact(spark):
    x = np.random.default_rng(3).integers(0, 3, (400, 5)).astype(float)  # many ties
    rows = frame(spark, x)
    want = brute(list(enumerate(x)), 6)
    assert {(r.src, r.dst, r.place) for r in N.nearest_of_all(rows, 6, saved).collect()} == want
    assert {(r.src, r.dst, r.place) for r in N.nearest(rows, rows, 6).collect()} == want


def test_exact_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_CELLS", 60)
    monkeypatch.setattr(N, "AT_ONCE", 4)
    x = points("clustered", 500, 10)
    rows = frame(spark, x)
    found = N.nearest(rows, rows.where("unit % 10 = 0"), 5)
    assert {(r.src, r.dst, r.place) for r in found.collect()} == {t for t in brute(list(enumerate(x)), 5) if t[0] % 10 == 0}
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_many_equal_vectors(spark):
    x = np.vstack([points("uniform", 600, 6), np.full((600, 6), 0.5)])
    found = N.nearest_of_all(frame(spark, x), 4, saved, size=128).collect()
    equal = [r for r in found if r["src"] >= 600]
    assert len(found) == 4 * len(x) and all(r["dst"] >= 600 and r["distance"] == 0 for r in equal)


def test_vectors_that_cannot_be_compared(spark):
    x = points("uniform", 60, 4)
    odd = [(100, None, "x"), (101, [], "x"), (102, [0.1, None, 0.2, 0.3], "x"), (103, [0.1, math.nan, 0.2, 0.3], "x"), (104, [0.1, math.inf, 0.2, 0.3], "x"), (105, [0.1] * 3, "x"), (106, [0.1] * 5, "x"), (None, [0.1] * 4, "x")]
    rows = frame(spark, x).unionByName(spark.createDataFrame(odd, SCHEMA)).unionByName(frame(spark, x[:5]))
    want = brute(list(enumerate(x)), 3)
    assert {(r.src, r.dst, r.place) for r in N.nearest_of_all(rows, 3, saved).collect()} == want
    assert {(r.src, r.dst, r.place) for r in N.nearest(rows, rows, 3).collect()} == want


def test_few_and_no_vectors(spark):
    for n in (0, 1, 2):
        rows = frame(spark, points("uniform", n, 3)) if n else spark.createDataFrame([], SCHEMA)
        assert N.nearest_of_all(rows, 3, saved).count() == N.nearest(rows, rows, 3).count() == n * (n - 1)
