"""Linear discriminants from moments by class, and machines with a radial kernel from random features, cross-validated in one go.

Both need sums over rows only: the moments of each class and fold, or, step by step, the gradients and slopes of a squared hinge loss of
all folds' models at once. What reaches the driver is of the size of the classes, folds and features squared, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.operators import neighbours as N
from intervale.operators import scans

Save = Callable[[DataFrame], DataFrame]


def stratified(rows: DataFrame, folds: int, save: Save) -> DataFrame:
    """(unit, label, fold, samples) of rows (unit, samples, label): folds that hold each label alike, by a hash of the unit.

    Rows without a label, or whose vector is none of ``neighbours.usable``, take no part.
    """
    labels = rows.where("label IS NOT NULL").groupBy("unit").agg(F.min("label").alias("label"))
    placed = N.usable(rows.select("unit", "samples")).join(labels, "unit").withColumn("_lot", F.xxhash64("unit"))
    order = ["_lot", "unit"]
    ranked = scans.scanned(scans.dealt(placed, ["label"], order, save), ["label"], order, {"_rank": ("rank", None)})
    return save(ranked.select("unit", "label", ((F.col("_rank") - 1) % folds).cast("int").alias("fold"), "samples"))


def _samples(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("samples").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, shape: tuple, add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """The sum over all tasks of arrays of ``shape`` that ``add`` fills from batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                add(total, batch)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"cell": some, "s": total.ravel()[some]})

    found = rows.mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(int(np.prod(shape)))
    out[np.asarray(found.column("cell"))] = np.asarray(found.column("s"))
    return out.reshape(shape)


def class_moments(rows: DataFrame, classes: list, folds: int) -> np.ndarray:
    """Sums of products of (1, samples) for each class and fold."""
    width = rows.select(F.size("samples")).first()[0] + 1

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        z = np.hstack([np.ones((batch.num_rows, 1)), _samples(batch)])
        label, fold = batch.column("label").to_pylist(), np.asarray(batch.column("fold"))
        which = np.array([classes.index(v) for v in label]) * folds + fold
        for k in np.unique(which):
            own = z[which == k]
            total[k // folds, k % folds] += own.T @ own

    return _summed(rows, (len(classes), folds, width, width), add)


def discriminant(moments: np.ndarray, shrinkage: float = 1e-9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, offsets, axes) from moments by class: a row's scores are x @ weights + offsets, the log of its class's share included.

    The pooled covariance within classes has ``shrinkage`` of its mean variance added. axes are the generalised eigenvectors of the
    covariance between classes against it, the widest apart first, with unit variance within classes. Classes without a row never win.
    """
    n = moments[:, 0, 0]
    mean = moments[:, 0, 1:] / np.maximum(n, 1)[:, None]
    within = (moments[:, 1:, 1:] - n[:, None, None] * mean[:, :, None] * mean[:, None, :]).sum(axis=0) / max(n.sum() - (n > 0).sum(), 1)
    within += np.eye(len(within)) * (shrinkage * np.trace(within) / len(within) + 1e-300)
    weights = np.linalg.solve(within, mean.T)
    with np.errstate(divide="ignore"):
        offsets = np.log(n / n.sum()) - 0.5 * (mean * weights.T).sum(axis=1)
    away = mean - (n[:, None] * mean).sum(axis=0) / n.sum()
    between = (away * n[:, None]).T @ away / n.sum()
    value, vector = np.linalg.eigh(within)
    root = vector / np.sqrt(value)
    spread, turn = np.linalg.eigh(root.T @ between @ root)
    return weights, offsets, (root @ turn[:, ::-1])[:, : max((n > 0).sum() - 1, 0)]


def _scored(rows: DataFrame, classes: list, score: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """(fold, n, hit): rows of each fold, and those whose highest score is their class's (of equal ones the first)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, fold, label = _samples(batch), np.asarray(batch.column("fold")), np.array([classes.index(v) for v in batch.column("label").to_pylist()])
                for m in np.unique(fold):
                    own = fold == m
                    yield pa.RecordBatch.from_pydict({"fold": [int(m)], "n": [int(own.sum())], "hit": [int((score(x[own], int(m)).argmax(axis=1) == label[own]).sum())]})

    return rows.mapInArrow(run, "fold long, n long, hit long").groupBy("fold").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit"))


def decode_discriminant(rows: DataFrame, folds: int) -> DataFrame:
    """(fold, n, hit) of linear discriminants on rows of ``stratified``, each fold by the model of the others."""
    classes = sorted(r[0] for r in rows.select("label").distinct().collect())
    moments = class_moments(rows, classes, folds)
    models = [discriminant(np.delete(moments, m, axis=1).sum(axis=1))[:2] for m in range(folds)]
    return _scored(rows, classes, lambda x, m: x @ models[m][0] + models[m][1])


def random_features(width: int, size: int, scale: float, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """``size`` random cosines and a one for each row: their inner products are near exp(-scale * squared distance), plus one."""
    dice = np.random.default_rng(seed)
    turn, phase = dice.standard_normal((width, size)) * np.sqrt(2 * scale), dice.uniform(0, 2 * np.pi, size)
    return lambda x: np.hstack([np.sqrt(2 / size) * np.cos(x @ turn + phase), np.ones((len(x), 1))])


def kernel_machines(rows: DataFrame, folds: int, size: int = 128, cost: float = 1.0, seed: int = 3, steps: int = 20) -> tuple[np.ndarray, Callable, list]:
    """(weights by fold and class, features, classes): one against the rest, by Newton steps on the squared hinge loss over random features.

    The kernel's scale is one over the samples' number and variance. A step is one pass for all folds and classes; steps end when the
    weights stand still.
    """
    classes = sorted(r[0] for r in rows.select("label").distinct().collect())
    every = rows.select(F.explode("samples").alias("v")).agg(F.var_pop("v")).first()[0]
    width = rows.select(F.size("samples")).first()[0]
    features = random_features(width, size, 1.0 / (width * every) if every else 1.0, seed)
    d = size + 1
    weights = np.zeros((folds, len(classes), d))
    for _ in range(steps):

        def add(total: np.ndarray, batch: pa.RecordBatch, weights: np.ndarray = weights) -> None:
            z, fold, label = features(_samples(batch)), np.asarray(batch.column("fold")), np.array([classes.index(v) for v in batch.column("label").to_pylist()])
            for m in range(folds):
                own = z[fold != m]
                for k in range(len(classes)):
                    y = np.where(label[fold != m] == k, 1.0, -1.0)
                    short = 1 - y * (own @ weights[m, k])
                    act = short > 0
                    total[m, k, 0] += -2 * cost * (y[act] * short[act]) @ own[act]
                    total[m, k, 1:] += 2 * cost * own[act].T @ own[act]

        sums = _summed(rows, (folds, len(classes), d + 1, d), add)
        step = np.linalg.solve(sums[:, :, 1:] + np.eye(d), (sums[:, :, 0] + weights)[..., None])[..., 0]
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    return weights, features, classes


def decode_kernel(rows: DataFrame, folds: int, size: int = 128, cost: float = 1.0) -> DataFrame:
    """(fold, n, hit) of machines with a radial kernel on rows of ``stratified``, each fold by the model of the others."""
    weights, features, classes = kernel_machines(rows, folds, size, cost)
    return _scored(rows, classes, lambda x, m: features(x) @ weights[m].T)
