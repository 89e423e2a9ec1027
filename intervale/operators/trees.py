"""Boosted trees on binned features, with cross-validation and attributions.

Features are cut into bins once. A level of the trees is grown from sums of gradients by (model, class, node, feature, bin), which tasks
make from their rows and Spark adds up; the best cuts follow from these sums, whose number does not depend on the rows. The models of all
folds, and the one of all rows, grow in the same passes. Trees are small and go to the tasks whole. A row's attributions are exact
Shapley values under the trees' own weights: a tree of few cuts has few patterns of decisions, and each pattern's values are a table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.operators import neighbours as N
from intervale.operators import scans

Save = Callable[[DataFrame], DataFrame]


@dataclass
class Tree:
    """A binary tree in an array: node ``i`` has children 2 i + 1 (bin at most ``cut``) and 2 i + 2; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n))

    def reached(self, bins: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row after ``levels`` decisions; rows stay at leaves."""
        node = np.zeros(len(bins), int)
        for _ in range(levels):
            f = self.feature[node]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.cut[node]
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        return node

    def attributions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, features, table): the cuts, the features that they use, and for each pattern of decisions the value of each of these.

        The value of a set of features is the tree's mean where the features outside it are unknown, by the rows that each side covers.
        """
        nodes = np.flatnonzero(self.feature >= 0)
        used = np.unique(self.feature[nodes])
        k = len(used)
        table = np.zeros((2 ** len(nodes), k))
        share = {s: factorial(s) * factorial(k - s - 1) / factorial(k) for s in range(k)}
        for pattern in range(2 ** len(nodes)):
            right = {int(node): pattern >> i & 1 for i, node in enumerate(nodes)}

            def mean(known: tuple, node: int = 0, right: dict = right) -> float:
                if self.feature[node] < 0:
                    return float(self.value[node])
                if known[int(np.searchsorted(used, self.feature[node]))]:
                    return mean(known, 2 * node + 1 + right[node])
                a, b = self.cover[2 * node + 1], self.cover[2 * node + 2]
                return (a * mean(known, 2 * node + 1) + b * mean(known, 2 * node + 2)) / (a + b)

            worth = {known: mean(known) for known in product((0, 1), repeat=k)}
            for known, v in worth.items():
                for j in range(k):
                    if not known[j]:
                        table[pattern, j] += share[sum(known)] * (worth[(*known[:j], 1, *known[j + 1 :])] - v)
        return nodes, used, table

    def base(self, node: int = 0) -> float:
        """The mean over the rows that the tree was grown on."""
        if self.feature[node] < 0:
            return float(self.value[node])
        a, b = self.cover[2 * node + 1], self.cover[2 * node + 2]
        return (a * self.base(2 * node + 1) + b * self.base(2 * node + 2)) / (a + b)


@dataclass
class Forest:
    """rounds x classes of trees, and the edges of the features' bins."""

    classes: list
    depth: int
    rounds: list[list[Tree]] = field(default_factory=list)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), len(self.classes)))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.reached(bins, self.depth)]
        return out


def softmax(margins: np.ndarray) -> np.ndarray:
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def binned(rows: DataFrame, folds: int, n_bins: int, save: Save) -> DataFrame:
    """(unit, label, fold, bins) of rows (unit, samples, label): the bin of each sample, and folds that hold each label alike.

    Edges are approximate quantiles of each sample. Rows without a label, or whose vector is none of ``neighbours.usable``, take no part.
    """
    labels = rows.where("label IS NOT NULL").groupBy("unit").agg(F.min("label").alias("label"))
    placed = save(N.usable(rows.select("unit", "samples")).join(labels, "unit"))
    first = placed.select(F.size("samples")).first()
    width = first[0] if first else 0
    shares = [i / n_bins for i in range(1, n_bins)]
    edges = placed.agg(*[F.percentile_approx(F.get("samples", i), shares, 10_000).alias(f"e{i}") for i in range(width)]).first() if width else []
    cuts = [F.array(*[F.lit(float(v)) for v in sorted(set(e))]) for e in edges]
    below = lambda c, v: F.size(F.filter(c, lambda edge: edge < v))
    bins = [below(c, F.get("samples", i)) for i, c in enumerate(cuts)]
    order = ["_lot", "unit"]
    dealt = scans.dealt(placed.withColumn("_lot", F.xxhash64("unit")), ["label"], order, save)
    ranked = scans.scanned(dealt, ["label"], order, {"_rank": ("rank", None)})
    return save(ranked.select("unit", "label", ((F.col("_rank") - 1) % folds).cast("int").alias("fold"), F.array(*bins).cast("array<int>").alias("bins")))


def _pass(rows: DataFrame, forests: list[Forest], growing: list[list[Tree]], level: int, n_bins: int) -> np.ndarray:
    """Sums (2, models, classes, nodes of the level, features, bins) of the gradients and their slopes over each model's rows."""
    spark, classes = rows.sparkSession, forests[0].classes
    width = rows.select(F.size("bins")).first()[0]
    shape = (len(forests), len(classes), 2**level, width, n_bins)
    sent = spark.sparkContext.broadcast((forests, growing))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests, growing = sent.value
        place = {label: i for i, label in enumerate(forests[0].classes)}
        total = np.zeros((2, *shape))
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.asarray(batch.column("bins").flatten()).reshape(batch.num_rows, -1)
            y, fold = np.array([place[v] for v in batch.column("label").to_pylist()]), np.asarray(batch.column("fold"))
            for m, forest in enumerate(forests):
                own = fold != m
                mine = bins[own]
                p = softmax(forest.margins(mine))
                slope = 2 * p * (1 - p)
                p[np.arange(len(mine)), y[own]] -= 1
                cell = np.arange(width) * n_bins + mine
                for k in range(len(classes)):
                    node = growing[m][k].reached(mine, level) - (2**level - 1)
                    here = node >= 0  # the others have come to a leaf above
                    at = (node[here, None] * width * n_bins + cell[here]).ravel()
                    for i, g in enumerate((p, slope)):
                        total[i, m, k] += np.bincount(at, weights=np.repeat(g[here, k], width), minlength=2**level * width * n_bins).reshape(shape[2:])
        flat = total.reshape(2, -1)
        some = np.flatnonzero(flat[1])
        yield pa.RecordBatch.from_pydict({"cell": some, "g": flat[0, some], "h": flat[1, some]})

    out = np.zeros((2, int(np.prod(shape))))
    found = rows.mapInArrow(run, "cell long, g double, h double").groupBy("cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
    at = np.asarray(found.column("cell"))
    out[0, at], out[1, at] = np.asarray(found.column("g")), np.asarray(found.column("h"))
    return out.reshape(2, *shape)


def _cut(tree: Tree, level: int, sums: np.ndarray, rate: float, penalty: float, least: float) -> None:
    """Give the nodes of ``level`` their best cut and their children their values, from sums (2, nodes, features, bins)."""
    for i in range(2**level):
        node = 2**level - 1 + i
        if level and tree.feature[(node - 1) // 2] < 0:
            continue
        g, h = sums[0, i], sums[1, i]
        total_g, total_h = g[0].sum(), h[0].sum()
        if level == 0:
            tree.value[0], tree.cover[0] = -rate * total_g / (total_h + penalty), total_h
        left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty) - total_g**2 / (total_h + penalty)
        gain = np.where((left_h >= least) & (right_h >= least), np.round(gain, 9), -np.inf)
        f, c = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, c] <= 0:
            continue
        tree.feature[node], tree.cut[node] = f, c
        for child, (cg, ch) in ((2 * node + 1, (left_g[f, c], left_h[f, c])), (2 * node + 2, (right_g[f, c], right_h[f, c]))):
            tree.value[child], tree.cover[child] = -rate * cg / (ch + penalty), ch


def boosted(rows: DataFrame, folds: int, rounds: int, depth: int = 3, n_bins: int = 16, rate: float = 0.3, penalty: float = 1.0, least: float = 1.0) -> list[Forest]:
    """The forests of ``rows`` (of ``binned``): one without each fold, and the last of all rows."""
    classes = sorted(r[0] for r in rows.select("label").distinct().collect())
    forests = [Forest(classes, depth) for _ in range(folds + 1)]
    for _ in range(rounds):
        growing = [[Tree.empty(depth) for _ in classes] for _ in forests]
        for level in range(depth):
            sums = _pass(rows, forests, growing, level, n_bins)
            for m, trees in enumerate(growing):
                for k, tree in enumerate(trees):
                    _cut(tree, level, sums[:, m, k], rate, penalty, least)
        for forest, trees in zip(forests, growing, strict=True):
            forest.rounds.append(trees)
    return forests


def accuracy(rows: DataFrame, forests: list[Forest]) -> float:
    """Share of the rows that the forest without their fold puts into their class (the first of equally likely ones)."""
    sent = rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = sent.value
        for batch in batches:
            if batch.num_rows:
                bins, fold = np.asarray(batch.column("bins").flatten()).reshape(batch.num_rows, -1), np.asarray(batch.column("fold"))
                right = 0
                for m in np.unique(fold):
                    guess = forests[m].margins(bins[fold == m]).argmax(axis=1)
                    right += sum(forests[m].classes[g] == v for g, v in zip(guess, batch.column("label").filter(pa.array(fold == m)).to_pylist(), strict=True))
                yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "hit": [int(right)]})

    n, hit = rows.mapInArrow(run, "n long, hit long").agg(F.sum("n"), F.sum("hit")).first()
    return hit / n if n else float("nan")


def attributed(rows: DataFrame, forest: Forest) -> DataFrame:
    """(unit, base, margins, values): a row's margin for each class, and what each feature adds to it (classes x features, class by class).

    base has the classes' mean margins; base and the values of a class add up to its margin.
    """
    tables = [[(*tree.attributions(), tree.base()) for tree in trees] for trees in forest.rounds]
    sent = rows.sparkSession.sparkContext.broadcast((forest, tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, tables = sent.value
        for batch in batches:
            n = batch.num_rows
            bins = np.asarray(batch.column("bins").flatten()).reshape(n, -1) if n else np.zeros((0, 1), int)
            values, base = np.zeros((n, len(forest.classes), bins.shape[1])), np.zeros(len(forest.classes))
            for trees, own in zip(forest.rounds, tables, strict=True):
                for k, (tree, (nodes, used, table, mean)) in enumerate(zip(trees, own, strict=True)):
                    pattern = ((bins[:, tree.feature[nodes]] > tree.cut[nodes]) << np.arange(len(nodes))).sum(axis=1)
                    values[:, k, used] += table[pattern]
                    base[k] += mean
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array([base.tolist()] * n, pa.list_(pa.float64())), pa.array(forest.margins(bins).tolist(), pa.list_(pa.float64())), pa.array(values.reshape(n, -1).tolist(), pa.list_(pa.float64()))], names=["unit", "base", "margins", "values"])

    return rows.select("unit", "bins").mapInArrow(run, "unit long, base array<double>, margins array<double>, values array<double>")


def importance(rows: DataFrame, save: Save, folds: int = 5, rounds: int = 10, depth: int = 3, n_bins: int = 16) -> DataFrame:
    """(sample, mean_abs, accuracy) of rows (unit, samples, label): each sample's mean absolute attribution over rows and classes.

    Of the trees on all rows; accuracy is that of ``folds``-fold cross-validation, the same in each row.
    """
    spark = rows.sparkSession
    table = binned(rows, folds, n_bins, save)
    if table.isEmpty():
        return spark.createDataFrame([], "sample long, mean_abs double, accuracy double")
    forests = boosted(table, folds, rounds, depth, n_bins)
    width = F.size("values") / len(forests[-1].classes)
    each = attributed(table, forests[-1]).select(width.cast("int").alias("width"), F.posexplode("values").alias("at", "v"))
    means = each.groupBy((F.col("at") % F.col("width")).cast("long").alias("sample")).agg(F.avg(F.abs("v")).alias("mean_abs"))
    return means.withColumn("accuracy", F.lit(accuracy(table, forests)))
