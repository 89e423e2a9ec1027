"""Linear models from second moments.

One pass sums each task's products of samples; Spark adds the sums. What reaches the driver is one small matrix per fold, whose size is
the number of samples squared and does not depend on the rows. Models of groups are solved in the tasks, a group at a time.
Cross-validation subtracts a fold's sums from the total.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.operators.chunks import by_row, matrices_by_length


def moments(segments: DataFrame, key: str) -> DataFrame:
    """(key, width, cell, total): sums over rows of the products of (1, samples), cell by cell, for each key and length of row.

    Rows with a null key or a null in them are left out.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for rows, (x,) in matrices_by_length([batch.column(1)]):
                z = np.hstack([np.ones((len(rows), 1)), x])
                for k in np.unique(keys[rows]):
                    own = z[keys[rows] == k]
                    at = (int(k), x.shape[1])
                    sums[at] = sums.get(at, 0) + own.T @ own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.int64()), pa.array([w for _, w in sums], pa.int64()), pa.array([m.ravel().tolist() for m in sums.values()], pa.list_(pa.float64()))], names=["key", "width", "sums"])

    found = segments.select(F.col(key).cast("long").alias("key"), "samples").where("key IS NOT NULL").mapInArrow(products, "key long, width long, sums array<double>")
    return found.select("key", "width", F.posexplode("sums").alias("cell", "total")).groupBy("key", "width", "cell").agg(F.sum("total").alias("total"))


def matrices(found: DataFrame) -> dict[int, np.ndarray]:
    """The moment matrices by key, on the driver, of the length that most rows have."""
    out: dict[tuple[int, int], dict[int, float]] = {}
    for r in found.toLocalIterator():
        out.setdefault((r["key"], r["width"]), {})[r["cell"]] = r["total"]
    rows: dict[int, float] = {}
    for (_, width), cells in out.items():
        rows[width] = rows.get(width, 0) + cells[0]
    usual = max(rows, key=lambda w: (rows[w], w)) if rows else 0
    return {k: np.array([v[i] for i in range(len(v))]).reshape(usual + 1, usual + 1) for (k, width), v in sorted(out.items()) if width == usual}


def whole(found: DataFrame) -> np.ndarray | None:
    """The moment matrix of all keys' rows of the length that most rows have, None without rows. The keys are summed before it is fetched."""
    usual = found.where("cell = 0").groupBy("width").agg(F.sum("total").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if usual is None:
        return None
    size = usual["width"] + 1
    out = np.zeros(size * size)
    for r in found.where(F.col("width") == usual["width"]).groupBy("cell").agg(F.sum("total").alias("total")).toLocalIterator():
        out[r["cell"]] = r["total"]
    return out.reshape(size, size)


KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}


def solved(found: DataFrame, fit: Callable[[int, int, dict[int, np.ndarray]], list[tuple]], schema: str, folds: int = 1) -> DataFrame:
    """The rows that ``fit(group, width, matrices by fold)`` gives for each group and length of row, solved in the tasks.

    Keys are group * ``folds`` + fold. A task holds one group's matrices at a time, ``folds`` of them at most; none reaches the driver.
    """
    names, kinds = [c.split()[0] for c in schema.split(", ")], [KINDS[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for grp, width, cells in zip(*(batch.column(i) for i in range(3)), strict=True):
                size = width.as_py() + 1
                keys, at, total = (cells.values.field(i).to_numpy() for i in range(3))
                by_fold = {int(k) % folds: np.zeros(size * size) for k in np.unique(keys)}
                for k in np.unique(keys):
                    by_fold[int(k) % folds][at[keys == k]] = total[keys == k]
                rows = fit(grp.as_py(), size - 1, {k: m.reshape(size, size) for k, m in sorted(by_fold.items())})
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    one = found.groupBy(F.floor(F.col("key") / folds).alias("grp"), "width").agg(F.collect_list(F.struct("key", "cell", "total")).alias("cells"))
    return one.mapInArrow(run, schema)


def covariance(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, population covariance, n) of a moment matrix."""
    n = m[0, 0]
    mean = m[0, 1:] / n
    return mean, m[1:, 1:] / n - np.outer(mean, mean), n


def principal(m: np.ndarray, k: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components as rows, all eigenvalues); each component's largest loading is positive. Without centring the mean is 0."""
    mean, cov, n = covariance(m)
    if not centred:
        mean, cov = np.zeros_like(mean), m[1:, 1:] / n
    value, vector = np.linalg.eigh(cov)
    order = np.argsort(value)[::-1]
    parts = vector[:, order[:k]].T
    parts = parts * np.sign(parts[np.arange(k), np.abs(parts).argmax(axis=1)])[:, None]
    return mean, parts, value[order]


def participation_ratio(values: np.ndarray) -> float:
    return float(values.sum() ** 2 / (values**2).sum()) if (values**2).sum() > 0 else float("nan")


def dimension(values: np.ndarray, share: float) -> int:
    """Smallest number of leading eigenvalues that make up ``share`` of the sum."""
    return int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12) + 1)


def split_moments(m: np.ndarray, p: int) -> tuple[np.ndarray, ...]:
    """Centred sums xx, xy and yy of the first ``p`` samples against the others."""
    mean, cov, n = covariance(m)
    c = cov * n
    return c[:p, :p], c[:p, p:], c[p:, p:]


def ridge(m: np.ndarray, p: int, penalty: float) -> np.ndarray:
    """W of y = x W: (xx + penalty I)^-1 xy on centred data."""
    xx, xy, _ = split_moments(m, p)
    return np.linalg.solve(xx + penalty * np.eye(p), xy)


def r_squared(test: np.ndarray, train: np.ndarray, p: int, w: np.ndarray) -> float:
    """Share of the test fold's variance around its own mean that the map explains; intercepts come from the training means."""
    n = test[0, 0]
    mean = train[0, 1:] / train[0, 0]
    shift = np.eye(len(test))
    shift[0, 1:] = -mean
    s = shift.T @ test @ shift  # moments of the test rows less the training means
    xx, xy, yy = s[1 : p + 1, 1 : p + 1], s[1 : p + 1, p + 1 :], s[p + 1 :, p + 1 :]
    residual = np.trace(yy) - 2 * np.trace(w.T @ xy) + np.trace(w.T @ xx @ w)
    own = s[0, p + 1 :] / n
    return float(1 - residual / (np.trace(yy) - n * own @ own))


def reduced_rank(m: np.ndarray, p: int, penalty: float, rank: int) -> np.ndarray:
    """The ridge map, projected on the ``rank`` leading directions of what it predicts."""
    w = ridge(m, p, penalty)
    xx, _, _ = split_moments(m, p)
    value, vector = np.linalg.eigh(w.T @ xx @ w)
    lead = vector[:, np.argsort(value)[::-1][:rank]]
    return w @ lead @ lead.T


def cross_validated(folds: dict[int, np.ndarray], score) -> tuple[float, float]:
    """Mean of ``score(train, test)`` over folds and its standard error (population deviation over the number of folds)."""
    whole = sum(folds.values())
    found = np.array([score(whole - m, m) for m in folds.values()])
    return float(found.mean()), float(found.std() / len(found))


def within_one_error(means: list[float], errors: list[float]) -> int:
    """Place of the first entry within one standard error of the best."""
    best = int(np.argmax(means))
    return int(np.flatnonzero(np.array(means) >= means[best] - errors[best])[0])


def factor_analysis(cov: np.ndarray, q: int, rounds: int = 60, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Loadings and unique variances by expectation maximisation on a covariance matrix."""
    p = len(cov)
    unique = np.maximum(np.diag(cov).copy(), 1e-9)
    if q == 0:
        return np.zeros((p, 0)), unique
    load = np.random.default_rng(seed).normal(size=(p, q)) * np.sqrt(unique / q)[:, None]
    for _ in range(rounds):
        beta = np.linalg.solve(np.eye(q) + (load.T / unique) @ load, load.T / unique)
        cross = cov @ beta.T
        load = cross @ np.linalg.inv(np.eye(q) - beta @ load + beta @ cross)
        unique = np.maximum(np.diag(cov - load @ (beta @ cov)), 1e-6 * np.diag(cov) + 1e-12)
    return load, unique


def gaussian_fit(load: np.ndarray, unique: np.ndarray, train: np.ndarray, test: np.ndarray) -> float:
    """Mean log-likelihood of the test fold under a factor model around the training mean."""
    mean, _, _ = covariance(train)
    n = test[0, 0]
    own = test[0, 1:] / n
    second = test[1:, 1:] / n - np.outer(own, mean) - np.outer(mean, own) + np.outer(mean, mean)
    model = load @ load.T + np.diag(unique)
    sign, logdet = np.linalg.slogdet(model)
    return float(-0.5 * (len(mean) * np.log(2 * np.pi) + logdet + np.trace(np.linalg.solve(model, second))))


def projected(segments: DataFrame, mean: np.ndarray, parts: np.ndarray, prefix: str) -> DataFrame:
    """unit and its scores on ``parts`` (rows), as columns prefix1, prefix2 ...; nulls for rows of another length or with a null."""
    names = [f"{prefix}{i + 1}" for i in range(len(parts))]

    def score(x: np.ndarray) -> dict[str, np.ndarray]:
        found = (x - mean) @ parts.T if x.shape[1] == len(mean) else np.full((len(x), len(parts)), np.nan)
        return {n: np.where(np.isnan(found[:, i]), None, found[:, i]) for i, n in enumerate(names)}

    return by_row(segments.select("unit", "samples"), ["samples"], score, "unit long, " + ", ".join(f"{n} double" for n in names))


def poisson_phase(counts: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coefficients, deviance, null deviance) of log rate = b0 + b1 sin + b2 cos for each row of counts over equal phase bins."""
    bins = counts.shape[1]
    phase = 2 * np.pi * (np.arange(bins) + 0.5) / bins
    x = np.stack([np.ones(bins), np.sin(phase), np.cos(phase)], axis=1)
    mean = np.maximum(counts.mean(axis=1), 1e-9)
    b = np.stack([np.log(mean), 0 * mean, 0 * mean], axis=1)
    for _ in range(rounds):
        rate = np.exp(np.clip(b @ x.T, -30, 30))
        curve = np.einsum("ui,ip,iq->upq", rate, x, x) + 1e-9 * np.eye(3)
        b = b + np.clip(np.linalg.solve(curve, ((counts - rate) @ x)[:, :, None])[:, :, 0], -2, 2)
    rate = np.exp(np.clip(b @ x.T, -30, 30))
    log_ratio = lambda r: np.where(counts > 0, counts * np.log(np.maximum(counts, 1e-12) / r), 0)
    deviance = 2 * (log_ratio(rate) - (counts - rate)).sum(axis=1)
    null = 2 * (log_ratio(mean[:, None]) - (counts - mean[:, None])).sum(axis=1)
    return b, deviance, null


def two_gaussians(centre: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of two normal parts fitted to a histogram by expectation maximisation, smaller mean first."""
    total = count.sum()
    mean = np.interp([0.25 * total, 0.75 * total], np.cumsum(count), centre)
    sd = np.full(2, np.sqrt(max(np.average((centre - np.average(centre, weights=count)) ** 2, weights=count), 1e-18)) / 2)
    weight = np.full(2, 0.5)
    for _ in range(rounds):
        p = weight * np.exp(-0.5 * ((centre[:, None] - mean) / sd) ** 2) / sd + 1e-300
        own = count[:, None] * p / p.sum(axis=1, keepdims=True)
        n = np.maximum(own.sum(axis=0), 1e-9)
        weight, mean = n / n.sum(), (own * centre[:, None]).sum(axis=0) / n
        sd = np.sqrt(np.maximum((own * (centre[:, None] - mean) ** 2).sum(axis=0) / n, 1e-12))
    order = np.argsort(mean)
    return weight[order], mean[order], sd[order]


def antimode(weight: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> float:
    """Where the mixture's density is least between its means; their midpoint if that is at an end."""
    grid = np.linspace(mean[0], mean[1], 501)
    density = (weight * np.exp(-0.5 * ((grid[:, None] - mean) / sd) ** 2) / sd).sum(axis=1)
    at = int(density.argmin())
    return float(grid[at] if 0 < at < len(grid) - 1 else mean.mean())


def random_intercept(sums: DataFrame, ratios: list[float]) -> list[dict]:
    """Restricted likelihood of y = b0 + b1 x + unit intercept for each variance ratio, from per-unit sums (n, x, y, xx, xy, yy).

    One aggregate over the units serves all ratios.
    """
    cells = []
    for i, ratio in enumerate(ratios):
        w = F.lit(ratio) / (1 + F.lit(ratio) * F.col("n"))
        parts = {"nn": F.col("n") - w * F.col("n") * F.col("n"), "nx": F.col("x") - w * F.col("n") * F.col("x"), "ny": F.col("y") - w * F.col("n") * F.col("y"), "xx": F.col("xx") - w * F.col("x") * F.col("x"), "xy": F.col("xy") - w * F.col("x") * F.col("y"), "yy": F.col("yy") - w * F.col("y") * F.col("y"), "ld": F.log(1 + F.lit(ratio) * F.col("n"))}
        cells += [F.sum(v).alias(f"{k}_{i}") for k, v in parts.items()]
    row = sums.agg(F.sum("n").alias("total"), *cells).first()
    out = []
    for i, ratio in enumerate(ratios):
        nn, nx, ny, xx, xy, yy, ld = (row[f"{k}_{i}"] for k in ("nn", "nx", "ny", "xx", "xy", "yy", "ld"))
        a = np.array([[nn, nx], [nx, xx]])
        b = np.linalg.solve(a, [ny, xy])
        residual, free = yy - b @ [ny, xy], row["total"] - 2
        scale = residual / free
        likelihood = -0.5 * (free * np.log(scale) + ld + np.log(np.linalg.det(a)))
        out.append({"ratio": ratio, "beta": float(b[1]), "se": float(np.sqrt(scale * np.linalg.inv(a)[1, 1])), "scale": float(scale), "likelihood": float(likelihood)})
    return out


def rise_and_decay(t: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Fixed formula of the correlogram's shape: decay less rise from t0 on, a Gaussian burst there, and a rate, floored at 0."""
    decay, rise, c, d, t0, burst, h, rate = p
    return np.maximum(c * (np.exp(-(t - t0) / decay) - d * np.exp(-(t - t0) / rise)) + h * np.exp(-(((t - t0) / burst) ** 2)) + rate, 0)


def fitted_shape(t: np.ndarray, y: np.ndarray, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Parameters inside their bounds and R^2 by damped least squares; NaN where the data has no shape."""
    top = y.max() if len(y) else 0
    if len(t) < 8 or not np.isfinite(y).all() or top <= 0:
        return np.full(8, np.nan), float("nan")
    span = t.max()
    low, high = np.array([span / 100, span / 500, 0, 0, -span / 10, span / 500, 0, 0]), np.array([10 * span, span, 10 * top, 15, span / 2, span, 10 * top, 2 * top])
    p = np.clip(np.array([span / 2, span / 20, top, 1, span / 100, span / 50, top / 10, y[-len(y) // 5 :].mean()]), low, high)
    damp, cost = 1e-2, ((y - rise_and_decay(t, p)) ** 2).sum()
    for _ in range(rounds):
        base = rise_and_decay(t, p)
        step = 1e-6 * (high - low)
        jac = np.stack([(rise_and_decay(t, p + step * e) - base) / step[i] for i, e in enumerate(np.eye(8))], axis=1)
        a = jac.T @ jac
        move = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-9), jac.T @ (y - base))
        trial = np.clip(p + move, low, high)
        new = ((y - rise_and_decay(t, trial)) ** 2).sum()
        p, cost, damp = (trial, new, damp / 3) if new < cost else (p, cost, min(damp * 4, 1e9))
    spread = ((y - y.mean()) ** 2).sum()
    return p, float(1 - cost / spread) if spread > 0 else float("nan")


def split_spaces(w: np.ndarray, tolerance: float = 1e-3, scatter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases (as columns) of what a map x W lets through and of what it does not; at least one direction is let through.

    A map says nothing of the axes inside the second space, which rounding would choose. With ``scatter``, a covariance of x, they are its
    principal axes there, greatest variance first. Each direction's largest loading is positive.
    """
    left, value, _ = np.linalg.svd(w, full_matrices=True)
    rank = max(1, int((value > tolerance * value[0]).sum()))
    potent, null = left[:, :rank], left[:, rank:]
    if scatter is not None and null.shape[1]:
        null = null @ np.linalg.eigh(null.T @ scatter @ null)[1][:, ::-1]
    signed = lambda basis: basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1.0, 1.0)
    return signed(potent), signed(null)


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """Two-sided p of a 2 x 2 table: the chance of all tables that are no likelier."""
    n, row, column = a + b + c + d, a + b, a + c
    log = lambda x: lgamma(x + 1)
    fixed = log(row) + log(n - row) + log(column) + log(n - column) - log(n)
    chance = lambda x: fixed - log(x) - log(row - x) - log(column - x) - log(n - row - column + x)
    low, high = max(0, row + column - n), min(row, column)
    p = np.exp([chance(x) for x in range(low, high + 1)])
    return float(min(1.0, p[p <= p[a - low] * (1 + 1e-7)].sum()))


def sub_moments(m: np.ndarray, p: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The moment matrix of chosen samples: ``left`` from the first ``p``, ``right`` from the others; choices may repeat."""
    take = np.concatenate([[0], 1 + left, 1 + p + right])
    return m[np.ix_(take, take)]


def rank_scores(folds: dict[int, np.ndarray], p: int, penalties: list[float], ranks: list[int]) -> np.ndarray:
    """Cross-validated R^2 (penalties x ranks x folds) of reduced rank maps."""
    whole = sum(folds.values())
    out = np.full((len(penalties), len(ranks), len(folds)), np.nan)
    for f, test in enumerate(folds.values()):
        train = whole - test
        xx, xy, _ = split_moments(train, p)
        for a, penalty in enumerate(penalties):
            w = np.linalg.solve(xx + penalty * np.eye(p), xy)
            value, vector = np.linalg.eigh(w.T @ xx @ w)
            lead = vector[:, np.argsort(value)[::-1]]
            for r, rank in enumerate(ranks):
                out[a, r, f] = r_squared(test, train, p, w @ lead[:, :rank] @ lead[:, :rank].T)
    return out


def nested_errors(folds: dict[int, np.ndarray], p: int, penalties: list[float], ranks: list[int]) -> np.ndarray:
    """Normalised squared errors (folds x ranks); each fold's penalty is chosen by cross-validation among the other folds."""
    out = np.full((len(folds), len(ranks)), np.nan)
    for i, f in enumerate(folds):
        inner = {k: m for k, m in folds.items() if k != f}
        full = [float(np.mean([r_squared(test, sum(inner.values()) - test, p, ridge(sum(inner.values()) - test, p, a)) for test in inner.values()])) for a in penalties]
        best = penalties[int(np.argmax(full))]
        out[i] = 1 - rank_scores({0: folds[f], 1: sum(inner.values())}, p, [best], ranks)[0, :, 0]
    return out


def smallest_within_error(errors: np.ndarray) -> int:
    """Place of the first column whose mean error is at most the least one plus its standard error (over rows)."""
    mean, se = errors.mean(axis=0), errors.std(axis=0, ddof=1) / np.sqrt(len(errors))
    best = int(np.argmin(mean))
    return int(np.flatnonzero(mean <= mean[best] + se[best])[0])


def padded_curve(values: np.ndarray, length: int) -> np.ndarray:
    """Cumulative shares of ``values``, cut at ``length`` or carried on flat to it."""
    curve = np.cumsum(values) / values.sum() if values.sum() > 0 else np.zeros(max(len(values), 1))
    return np.concatenate([curve, np.full(max(0, length - len(curve)), curve[-1])])[:length]


def factor_dimension(folds: dict[int, np.ndarray], most: int, share: float = 0.95, rounds: int = 60) -> tuple[int, int, np.ndarray]:
    """(best number of factors by cross-validated likelihood, dimensions of their shared covariance, its eigenvalues)."""
    whole = sum(folds.values())
    fits = [np.mean([gaussian_fit(*factor_analysis(covariance(whole - m)[1], q, rounds), whole - m, m) for m in folds.values()]) for q in range(most + 1)]
    best = int(np.argmax(fits))
    load, _ = factor_analysis(covariance(whole)[1], max(best, 1), rounds)
    values = np.sort(np.linalg.eigvalsh(load @ load.T))[::-1].clip(0)
    return best, dimension(values, share), values


def nested_intercepts(units: DataFrame, group: str, ratios: list[tuple[float, float]]) -> DataFrame:
    """(group, combo, cells): generalised least squares sums of y on (1, x) for each pair of variance ratios (unit, block in the unit).

    ``units`` has group and blocks, an array of the sums (n, x, y, xx, xy, yy) of each block of a unit. Both random intercepts are taken
    out in closed form, blocks first. cells are nn, nx, ny, xx, xy, yy, the log determinant and the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r2, r1 = (np.array([r[i] for r in ratios]) for i in (0, 1))
        total: dict = {}
        for batch in batches:
            for key, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, x, y, xx, xy, yy = np.array([[b[c] for c in ("n", "x", "y", "xx", "xy", "yy")] for b in blocks], dtype=float).T
                w = r1[:, None] / (1 + r1[:, None] * n)
                cells = [(a - w * b * c).sum(axis=1) for a, b, c in ((n, n, n), (x, n, x), (y, n, y), (xx, x, x), (xy, x, y), (yy, y, y))]
                nn, nx, ny = cells[:3]
                v = r2 / (1 + r2 * nn)
                logdet = np.log1p(r1[:, None] * n).sum(axis=1) + np.log1p(r2 * nn)
                cells = [a - v * b * c for a, (b, c) in zip(cells, ((nn, nn), (nn, nx), (nn, ny), (nx, nx), (nx, ny), (ny, ny)), strict=True)]
                total[key] = total.get(key, 0) + np.stack([*cells, logdet, np.full(len(ratios), n.sum())], axis=1)
        for key, cells in total.items():
            yield pa.RecordBatch.from_pydict({group: pa.array([key] * len(ratios), pa.int64()), "combo": pa.array(range(len(ratios)), pa.int64()), "cells": pa.array(cells.tolist(), pa.list_(pa.float64()))})

    found = units.select(F.col(group).cast("long"), "blocks").mapInArrow(run, f"{group} long, combo long, cells array<double>")
    return found.groupBy(group, "combo").agg(F.array(*[F.sum(F.get("cells", i)) for i in range(8)]).alias("cells"))


def interaction_fit(units: DataFrame, group: str, passes: int = 4) -> dict:
    """Slopes of y on x in each group, with random intercepts for units and for blocks in them, by restricted likelihood.

    The two variance ratios are found on a grid that is narrowed around the best pair in each pass. Every group has its own intercept
    and slope, so the information is block-diagonal. Gives ratios, likelihood, groups, beta, se, and the joint Wald statistic of equal slopes.
    """
    axes = [np.concatenate([[0.0], 2.0 ** np.arange(-12, 5, 2)]) for _ in range(2)]
    best: dict = {}
    for number in range(passes):
        ratios = [(float(a), float(b)) for a in axes[0] for b in axes[1]]
        cells: dict[int, dict[int, list]] = {}
        for r in nested_intercepts(units, group, ratios).toLocalIterator():
            cells.setdefault(r["combo"], {})[r[group]] = r["cells"]
        for combo, by_group in sorted(cells.items()):
            groups = sorted(g for g, c in by_group.items() if np.linalg.matrix_rank(np.array([[c[0], c[1]], [c[1], c[3]]])) == 2)
            rows, residual, logdet, slopes, inverse = sum(by_group[g][7] for g in groups), 0.0, 0.0, [], []
            for g in groups:
                nn, nx, ny, xx, xy, yy, ld, _ = by_group[g]
                a, c = np.array([[nn, nx], [nx, xx]]), np.array([ny, xy])
                b = np.linalg.solve(a, c)
                residual += yy - b @ c
                logdet += ld + np.log(np.linalg.det(a))
                slopes.append(b[1])
                inverse.append(np.linalg.inv(a)[1, 1])
            free = rows - 2 * len(groups)
            scale = residual / free
            likelihood = -0.5 * (free * np.log(scale) + logdet)
            if not best or likelihood > best["likelihood"]:
                variance = scale * np.array(inverse)
                weight = 1 / variance
                middle = (weight * slopes).sum() / weight.sum()
                best = {"ratios": ratios[combo], "likelihood": float(likelihood), "groups": groups, "beta": np.array(slopes), "se": np.sqrt(variance), "wald": float((weight * (slopes - middle) ** 2).sum())}
        step = 2.0 / 2**number
        axes = [np.unique(np.clip([r * 2**k for k in np.linspace(-step, step, 5)] if r > 0 else [0.0, *(2.0 ** np.arange(-16, -11, 1) / 4**number)], 0, None)) for r in best["ratios"]]
    return best


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-square variable, by the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    term = total = 1 / a
    for k in range(1, 2000):
        term *= z / (a + k)
        total += term
        if term < total * 1e-15:
            break
    return float(max(0.0, 1 - total * np.exp(-z + a * np.log(z) - lgamma(a))))


def von_mises_concentration(r: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Concentration whose mean resultant length I1 / I0 is ``r``, by Newton steps."""
    r = np.clip(r, 0, 1 - 1e-9)
    k = r * (2 - r**2) / (1 - r**2)
    angle = (np.arange(512) + 0.5) * np.pi / 512
    for _ in range(rounds):
        weight = np.exp(k[:, None] * (np.cos(angle) - 1))
        a = (weight * np.cos(angle)).sum(axis=1) / weight.sum(axis=1)
        slope = (weight * np.cos(angle) ** 2).sum(axis=1) / weight.sum(axis=1) - a**2
        k = np.maximum(k - (a - r) / np.maximum(slope, 1e-12), 0)
    return k


def poisson_glm(x: np.ndarray, y: np.ndarray, exposure: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, float]:
    """(coefficients, standard errors, deviance) of log rate = x b with known exposure, by Newton steps."""
    b = np.zeros(x.shape[1])
    b[0] = np.log(max(y.sum(), 0.5) / exposure.sum())
    for _ in range(rounds):
        rate = exposure * np.exp(np.clip(x @ b, -30, 30))
        b = b + np.clip(np.linalg.solve(x.T @ (rate[:, None] * x) + 1e-9 * np.eye(len(b)), x.T @ (y - rate)), -2, 2)
    rate = exposure * np.exp(np.clip(x @ b, -30, 30))
    error = np.sqrt(np.diag(np.linalg.inv(x.T @ (rate[:, None] * x) + 1e-9 * np.eye(len(b)))))
    return b, error, float(2 * (np.where(y > 0, y * np.log(np.maximum(y, 1e-12) / rate), 0) - (y - rate)).sum())


def best_assignment(table: np.ndarray) -> int:
    """The largest total of a one-to-one choice of columns for rows, by shortest augmenting paths."""
    n = max(table.shape)
    cost = np.full((n, n), 0.0)
    cost[: table.shape[0], : table.shape[1]] = -table
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, back, used = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int), np.zeros(n + 1, dtype=bool)
        while match[j]:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            gap = cost[match[j] - 1, free - 1] - u[match[j]] - v[free]
            better = gap < low[free]
            low[free[better]], back[free[better]] = gap[better], j
            nxt = free[np.argmin(low[free])]
            step = low[nxt]
            u[match[used]] += step
            v[used] -= step
            low[~used] -= step
            j = nxt
        while j:
            match[j], j = match[back[j]], back[j]
    return int(sum(table[match[j] - 1, j - 1] for j in range(1, n + 1) if match[j] <= table.shape[0] and j <= table.shape[1]))


def lasso(m: np.ndarray, p: int, penalty: float, rounds: int = 200) -> np.ndarray:
    """W of y = x W with absolute weights penalised, for all targets at once, by coordinate steps on centred moments.

    It minimises half the mean squared error plus ``penalty`` times the sum of absolute weights, target by target.
    """
    xx, xy, _ = split_moments(m, p)
    n = m[0, 0]
    xx, xy = xx / n, xy / n
    w = np.zeros_like(xy)
    for _ in range(rounds):
        before = w.copy()
        for k in range(p):
            pull = xy[k] - xx[k] @ w + xx[k, k] * w[k]
            w[k] = np.sign(pull) * np.maximum(np.abs(pull) - penalty, 0) / max(xx[k, k], 1e-12)
        if np.abs(w - before).max() < 1e-9:
            break
    return w


def target_r_squared(test: np.ndarray, train: np.ndarray, p: int, w: np.ndarray) -> np.ndarray:
    """``r_squared`` of each target alone."""
    return np.array([r_squared(sub_moments(test, p, np.arange(p), np.array([j])), sub_moments(train, p, np.arange(p), np.array([j])), p, w[:, j : j + 1]) for j in range(w.shape[1])])
