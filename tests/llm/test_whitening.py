"""Whitening against a dense eigendecomposition, contour integration on hard spectra, and edge cases."""

import math

import numpy as np
import pytest

from intervale.llm import whitening

SF = "/root/testdata/sf0.001"


def frame(spark, rows):
    """(vec_id, embedding) with columns that clash with results."""
    return spark.createDataFrame([(*r, 1, "n", 2.0) for r in rows], "vec_id long, embedding array<float>, component int, n string, x double").repartition(3)


def brute(rows, components=4):
    rows = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(len(x) for _, x in rows)
    rows = [(i, np.pad(x, (0, width - len(x)))) for i, x in rows]
    fit = np.array(sorted({tuple(x) for _, x in rows}))
    n, sums = len(fit), fit.sum(axis=0)
    v = np.cov(fit.T, bias=True).reshape(width, width)
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:components], vector[:, ::-1][:, :components]
    return {(i, k + 1): (n, int(((n * x - sums).astype(object) ** 2).sum()), (x - sums / n) @ vector[:, k] / np.sqrt(value[k]), value[k] / np.trace(v)) for i, x in rows for k in range(len(value)) if value[k] > 1e-9}


def same(found, want):
    assert len(found) == len(want)
    for k in {r["component"] for r in found}:
        own = [r for r in found if r["component"] == k]
        a, b = np.array([r["whitened"] for r in own]), np.array([want[r["vec_id"], k][2] for r in own])
        assert np.abs(a - b * np.sign(a @ b)).max() < 1e-8
        for r in own:
            n, deviation, _, explained = want[r["vec_id"], k]
            assert (r["n"], r["deviation"]) == (n, deviation) and abs(r["explained"] - explained) < 1e-10 and r["identity_error"] < 1e-9


def test_query_equals_brute_force(spark):
    from intervale.llm.queries import QUERIES

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same(QUERIES["op13_whitening"](spark, SF).collect(), brute(rows))


def test_copies_nulls_and_ragged_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(10) * np.arange(1, 11)).astype(np.float32).tolist()) for i in range(80)]
    rows += [(100 + i, rows[3][1]) for i in range(60)] + [(200, [1.0, 2.0]), (201, [1.0, 2.0, 0.0]), (202, []), (203, [-0.0] * 10)]
    bad = [(300, None), (301, [None] * 10), (302, [math.nan] * 10), (303, [1.0] * 9 + [-math.inf])]
    found = whitening.whitened(frame(spark, rows + bad), "vec_id", "embedding").collect()
    same(found, brute(rows))
    assert len(whitening.whitened(frame(spark, [*rows, (None, rows[0][1]), rows[0]]), "vec_id", "embedding").collect()) == 4 * (len(rows) + 2)


def test_few_directions(spark):
    """Two directions only, one vector, equal vectors, an empty table."""
    rows = [(i, [float(i % 7), float(i % 5), 3.0]) for i in range(50)]
    found = whitening.whitened(frame(spark, rows), "vec_id", "embedding").collect()
    assert {r["component"] for r in found} == {1, 2}
    same(found, brute(rows))
    for few in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, None)], [(1, [])]):
        assert whitening.whitened(frame(spark, few), "vec_id", "embedding").count() == 0


def test_deviations_of_any_size(spark):
    rows = [(i, [float(i) * 1e6, 5e8 if i % 2 else -5e8]) for i in range(40)]
    same(whitening.whitened(frame(spark, rows), "vec_id", "embedding").where("deviation IS NOT NULL").collect(), {})
    small = [(i, [float(i) * 1e3, 7.0 * (i % 3)]) for i in range(40)]
    same(whitening.whitened(frame(spark, small), "vec_id", "embedding").collect(), brute(small))


SPECTRA = {
    "near": [5, 5 - 1e-6, 5 - 2e-6, 5 - 3e-6, 5 - 4e-6, 1, 0.5, 0],
    "equal": [3.0] * 12,
    "wide": [1e8, 1e4, 1, 1e-2, 1e-6, 0, 0],
    "fourth and fifth equal": [9, 8, 7, 2, 2, 2, 1, 0.1],
    "geometric": [0.9**k for k in range(60)],
    "two": [2.0, 1.0],
    "one": [1.0],
    "flat": list(1 + np.random.default_rng(0).random(50) * 1e-3),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_contour_integration_finds_all(name):
    rng = np.random.default_rng(1)
    values = np.array(SPECTRA[name], dtype=float)
    q, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    value, vector = whitening.leading(v, 4)
    scale = values.max()
    assert np.abs(value - np.sort(values)[::-1][:4]).max() < 1e-12 * scale
    assert np.abs(v @ vector - vector * value).max() < 1e-12 * scale
    assert np.abs(vector.T @ vector - np.eye(len(value))).max() < 1e-12


def test_inertia_counts():
    rng = np.random.default_rng(3)
    a = rng.standard_normal((30, 30))
    v = a + a.T
    d, e = whitening.tridiagonal(v)
    for shift in np.linspace(-15, 15, 41):
        assert whitening.above(d, e, shift) == (np.linalg.eigvalsh(v) > shift).sum()
