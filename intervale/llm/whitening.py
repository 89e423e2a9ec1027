"""Whitening of vectors: principal components by contour integration.

Spark lists the distinct vectors and sums their centred products, one pass each. What reaches the driver is one matrix of
(dimensions) squared cells, whatever the rows. Its leading eigenvectors come from an interval of eigenvalues: shifted systems
(z I - V)^-1 Y, solved at quadrature points z of a circle in the complex plane around the interval, add up to the projection of Y on the
interval's eigenvectors; Rayleigh-Ritz takes the components from it, and counts of inertia tell how many the interval holds, so that none
is missed.

Edge cases: rows with a null vector, or a null or non-finite entry in it, are dropped; rows with a null id, repeated ids and repeated rows
come through, each with its own result. Entries are bounded by the range of a long. A shorter vector counts as filled up with zeros.
Components without variance (less than ``FLAT`` of the greatest eigenvalue) cannot be whitened and are left out, so one vector, or equal
ones, give no row. A deviation that leaves the range of a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.negatives import filled
from intervale.llm.store import written

#: Points of the upper half circle, and rounds of the iteration at most.
POINTS, ROUNDS = 8, 30
#: Residuals and flat directions, as a share of the greatest eigenvalue.
EXACT, FLAT = 1e-14, 1e-12
_LONG = 2**63


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix with the eigenvalues of the symmetric ``v``, by reflections."""
    v, n = v.copy(), len(v)
    for k in range(n - 2):
        x = v[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = np.linalg.norm(x)
        if size > 0:
            u = x / size
            part = v[k + 1 :, k + 1 :]
            p = part @ u
            w = 2 * (p - (u @ p) * u)
            part -= np.outer(u, w) + np.outer(w, u)
            v[k + 1 :, k] -= 2 * u * (u @ v[k + 1 :, k])
    return np.diag(v).copy(), np.diag(v, -1).copy()


def above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie above ``shift``: the positive pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = 0, 1.0
    for i, d in enumerate(diagonal):
        pivot = d - shift - (off[i - 1] ** 2 / pivot if i else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot > 0
    return count


def interval(v: np.ndarray, wanted: int) -> tuple[float, float, int]:
    """(low, high, m): an interval with exactly the ``m`` >= ``wanted`` greatest eigenvalues, and its lower end in a gap.

    Halving by inertia finds the wanted-th eigenvalue; the lower end moves below it until no other is near.
    """
    n = len(v)
    d, e = tridiagonal(v)
    scale = float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9) + np.finfo(float).tiny

    def around(k: int) -> tuple[float, float]:
        """The k-th greatest eigenvalue from below and from above."""
        a, b = -scale, scale
        while b - a > scale * 1e-13:
            middle = (a + b) / 2
            a, b = (middle, b) if above(d, e, middle) >= k else (a, middle)
        return a, b

    a, high = -2 * scale, around(1)[1]
    if wanted < n:
        a = around(wanted)[0]
        m = above(d, e, a)
        # the next eigenvalue below: a gap of a thousandth of the scale is sought, less where there is none
        for gap in (1e-2, 1e-3, 1e-5, 1e-7, 1e-9):
            at = a
            for _ in range(n):
                if above(d, e, at - gap * scale) == above(d, e, at):
                    break
                at -= gap * scale
            if above(d, e, at - gap * scale) == above(d, e, at) and above(d, e, at) <= max(2 * wanted, m):
                a = at - gap * scale / 2
                break
    return a, high + (high - a) / 20, above(d, e, a)


def leading(v: np.ndarray, wanted: int, points: int = POINTS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors as columns) of the ``wanted`` greatest eigenvalues of the symmetric ``v``.

    Raises ArithmeticError if the eigenvalues found in the interval are not as many as inertia counts there.
    """
    n = len(v)
    wanted = min(wanted, n)
    low, high, m = interval(v, wanted)
    size = min(n, max(m + 2, m + m // 2))
    centre, radius = (low + high) / 2, (high - low) / 2
    nodes, weights = np.polynomial.legendre.leggauss(points)
    angle = np.pi / 2 * (nodes + 1)
    around = np.exp(1j * angle)
    shifted = (centre + radius * around)[:, None, None] * np.eye(n) - v
    y = np.random.default_rng(seed).standard_normal((n, size))
    scale = np.abs(v).sum(axis=1).max()
    value, vector, before = np.zeros(0), np.zeros((n, 0)), np.inf
    for _ in range(ROUNDS):
        # half of the circle: the other half gives the conjugates
        solved = np.linalg.solve(shifted, np.broadcast_to(y, (points, n, y.shape[1])).astype(complex))
        q = (solved * (weights * around * radius / 2)[:, None, None]).real.sum(axis=0)
        base, strength, _ = np.linalg.svd(q, full_matrices=False)
        base = base[:, strength > strength[0] * 1e-13]
        inner = base.T @ v @ base
        ritz, turn = np.linalg.eigh((inner + inner.T) / 2)
        value, vector = ritz[::-1], base @ turn[:, ::-1]
        inside = (value > low) & (value < high)
        residual = np.linalg.norm(v @ vector[:, inside] - vector[:, inside] * value[inside], axis=0).max(initial=0)
        if inside.sum() == m and (residual <= EXACT * scale or residual > before / 2):
            break
        before, y = residual if inside.sum() == m else np.inf, vector
    found = int(((value > low) & (value < high)).sum())
    if found != m:
        raise ArithmeticError(f"{found} eigenvalues found in an interval that holds {m}")
    return value[:wanted], vector[:, :wanted]


def whole_numbers(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Rows of ``df`` whose vector has finite entries only, with x = floor(scale * entry) as long."""
    entry = F.col(vector).cast("array<double>")
    fine = F.col(vector).isNotNull() & ~F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    bound = float(_LONG // 2)
    return df.where(fine).select("*", F.transform(entry, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(bound)), F.lit(-bound))).cast("long")).alias("x"))


def _sums(fit: DataFrame) -> tuple[int, list[int], int]:
    """(n, sums per dimension, the greatest magnitude of an entry), exact whatever the rows: halves of the entries are added apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, bottom, most = 0, np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for batch in batches:
            x = filled(batch.column("x"))
            wide = max(len(x), len(top))
            grow = lambda s: np.pad(s, (0, wide - len(s)))
            top, bottom = grow(top) + grow((x >> 32).sum(axis=1)), grow(bottom) + grow((x & 0xFFFFFFFF).sum(axis=1))
            most, n = max(most, int(np.abs(x).max(initial=0))), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "most": [most], "top": pa.array([top.tolist()], pa.list_(pa.int64())), "bottom": pa.array([bottom.tolist()], pa.list_(pa.int64()))})

    parts = written(fit.mapInArrow(run, "n long, most long, top array<long>, bottom array<long>"), "counts")
    n, most = parts.agg(F.sum("n"), F.max("most")).first()
    halves = parts.select(F.posexplode(F.arrays_zip("top", "bottom")).alias("at", "s")).groupBy("at").agg(F.sum(F.col("s.top").cast("decimal(38,0)")).alias("top"), F.sum(F.col("s.bottom").cast("decimal(38,0)")).alias("bottom"))
    return n or 0, [int(r["top"]) * 2**32 + int(r["bottom"]) for r in halves.orderBy("at").collect()], most or 0


def _centred_products(fit: DataFrame, mean: np.ndarray, basis: np.ndarray | None = None) -> np.ndarray:
    """Sum over the fit list of (1, y)(1, y)^T, where y is x less the mean, on the ``basis`` if there is one.

    A task sends one matrix; Spark adds them cell by cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = filled(batch.column("x"), len(mean)).T - mean
            y = np.hstack([np.ones((len(y), 1)), y if basis is None else y @ basis])
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_pydict({"cells": pa.array([total.ravel().tolist()], pa.list_(pa.float64()))})

    cells = fit.mapInArrow(run, "cells array<double>").select(F.posexplode("cells").alias("at", "c")).groupBy("at").agg(F.sum("c").alias("c"))
    size = 1 + (len(mean) if basis is None else basis.shape[1])
    out = np.zeros(size * size)
    for r in cells.toLocalIterator():
        out[r["at"]] = r["c"]
    return out.reshape(size, size)


def _covariance(products: np.ndarray, n: int) -> np.ndarray:
    left = products[0, 1:] / n  # what rounding left of the mean
    return products[1:, 1:] / n - np.outer(left, left)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(df: DataFrame, id_column: str, vector: str, scale: int = 256, components: int = 4) -> DataFrame:
    """Each row's vector on the leading principal components of the distinct vectors, with unit variance there.

    Columns: vec_id, component (from 1), n (distinct vectors), deviation (the squared distance of n * x from the sum of the distinct
    vectors), whitened, explained (the component's share of the variance) and identity_error (the largest entry of whitened's covariance
    less the identity, measured over the distinct vectors).
    """
    spark = df.sparkSession
    rows = whole_numbers(df.select(F.col(id_column).alias("vec_id"), F.col(vector).alias("_v")), "_v", scale).select("vec_id", "x")
    # trailing zeros go, so that a vector and the same one filled up are one
    last = F.coalesce(F.array_max(F.transform("x", lambda c, i: F.when(c != 0, i + 1))), F.lit(0))
    fit = written(rows.select(F.slice("x", F.lit(1), last).alias("x")).distinct(), "distinct")
    n, sums, most = _sums(fit)
    if not n or not sums:
        return spark.createDataFrame([], SCHEMA)
    mean = np.array([s / n for s in sums])
    v = _covariance(_centred_products(fit, mean), n)
    v = (v + v.T) / 2
    if not np.trace(v) > 0:
        return spark.createDataFrame([], SCHEMA)
    value, vectors = leading(v, components)
    real = value > value[0] * FLAT
    value, basis = value[real], vectors[:, real] / np.sqrt(value[real])
    error = float(np.abs(_covariance(_centred_products(fit, mean, basis), n) - np.eye(len(value))).max())
    share = value / np.trace(v)
    # deviations in 64 bits where they cannot overflow, in whole numbers of any size otherwise
    small = (n * most + max(map(abs, sums))) ** 2 * len(sums) < _LONG

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(value)
        for batch in batches:
            x = filled(batch.column("x"), len(mean))
            if small:
                far = pa.array(((n * x - np.array(sums, dtype=np.int64)[:, None]) ** 2).sum(axis=0))
            else:
                exact = ((x.astype(object) * n - np.array(sums, dtype=object)[:, None]) ** 2).sum(axis=0)
                far = pa.array([d if d < _LONG else None for d in exact], pa.int64())
            out = (x.T - mean) @ basis
            each = pa.array(np.repeat(np.arange(batch.num_rows), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)), pa.array(np.full(len(each), n)), far.take(each), pa.array(out.ravel()), pa.array(np.tile(share, batch.num_rows)), pa.array(np.full(len(each), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, SCHEMA.replace("vec_id long", f"vec_id {kind}"))
