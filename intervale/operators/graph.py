"""Weights, communities and spectra of edge tables, and distances of pairs in groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.operators.models import matrices, moments

#: Rows of a block of pairs.
BLOCK = 256


def _blocks(df: DataFrame, n: Column, size: int) -> DataFrame:
    """Rows (unit, samples, cell) as one row for each of the ``n`` / ``size`` blocks of a cell: cell, units, flat."""
    block = F.pmod(F.xxhash64("unit"), F.greatest(F.ceil(n / size), F.lit(1)))
    return df.withColumn("_b", block).groupBy("cell", "_b").agg(F.collect_list("unit").alias("units"), F.flatten(F.collect_list("samples")).alias("flat")).drop("_b")


def pair_distances(rows: DataFrame, parts: int) -> DataFrame:
    """(grp, v, c): how many pairs of a cell's rows (unit, cell, samples, n rows in the cell) lie at each distance in 1 / ``parts``.

    Blocks of a cell meet, each pair of rows counts once, and no pair leaves its task.
    """
    blocks = _blocks(rows.select("unit", "cell", "samples", "n"), F.col("n"), BLOCK)
    pairs = blocks.join(blocks.select("cell", F.col("units").alias("q_units"), F.col("flat").alias("q_flat")), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, other = (np.asarray(batch.column(c)[row].values, dtype=np.int64) for c in ("q_units", "units"))
                a, b = (np.asarray(batch.column(c)[row].values, dtype=np.float64).reshape(n, -1) for c, n in (("q_flat", len(ids)), ("flat", len(other))))
                far = np.stack([np.sqrt(((x - b) ** 2).sum(axis=1)) for x in a])
                v, c = np.unique(np.round(far[ids[:, None] < other] * parts).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_pydict({"grp": pa.array([batch.column("cell")[row].as_py()] * len(v), pa.int64()), "v": pa.array(v), "c": pa.array(c)})

    return pairs.mapInArrow(run, "grp long, v long, c long").groupBy("grp", "v").agg(F.sum("c").alias("c"))


def fuzzy_weights(edges: DataFrame, k: int, rounds: int = 40) -> DataFrame:
    """Edges with w = exp(-(distance - nearest) / sigma), where sigma makes a vertex's weights add up to log2(k).

    A vertex has k edges, so its array is small; sigma is found by halving intervals in all vertices of a batch at once.
    """
    each = edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("distance", "dst"))).alias("near"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, n = batch.column("near").flatten(), np.asarray(batch.column("near").value_lengths(), dtype=np.int64)
            if not len(n):
                continue
            row = np.repeat(np.arange(len(n)), n)
            gap = np.full((len(n), n.max()), np.inf)
            gap[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = np.asarray(flat.field(0))
            gap -= gap[:, :1]
            low, high = np.full(len(n), 1e-9), np.maximum(np.where(np.isfinite(gap), gap, 0).max(axis=1), 1e-9) * 1000
            for _ in range(rounds):
                sigma = np.sqrt(low * high)
                short = np.exp(-gap / sigma[:, None]).sum(axis=1) < np.log2(max(k, 2))
                low, high = np.where(short, sigma, low), np.where(short, high, sigma)
            w = np.exp(-gap / sigma[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("src").take(pa.array(row)), flat.field(1), pa.array(w[np.isfinite(gap)])], names=["src", "dst", "w"])

    return each.mapInArrow(weigh, "src long, dst long, w double")


def symmetric(edges: DataFrame) -> DataFrame:
    """Undirected edges (src < dst) with the fuzzy union a + b - a b of the two directions' weights."""
    one = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    return one.groupBy("src", "dst").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("w"), F.lit(1e-12)))))).alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """Modularity of a labeling (unit, label) on undirected edges: two joins and sums by label."""
    of = lambda side: labels.select(F.col("unit").alias(side), F.col("label").alias(f"l_{side}"))
    marked = edges.join(of("src"), "src").join(of("dst"), "dst")
    inside = F.sum(F.when(F.col("l_src") == F.col("l_dst"), F.col("w")).otherwise(0.0))
    degree = marked.select(F.col("l_src").alias("label"), "w").unionByName(marked.select(F.col("l_dst").alias("label"), "w")).groupBy("label").agg(F.sum("w").alias("k"))
    total = marked.agg(F.sum("w").alias("m"), inside.alias("inside"))
    expected = degree.agg(F.sum(F.col("k") * F.col("k")).alias("kk"))
    return total.crossJoin(expected).select((F.col("inside") / F.col("m") - resolution * F.col("kk") / (4 * F.col("m") * F.col("m"))).alias("modularity"))


def _moves(both: DataFrame, degree: DataFrame, m2: float, gamma: float, save, rounds: int, seed: int) -> DataFrame:
    """(unit, label): greedy modularity moves from single vertices until fewer than one in a hundred moves.

    Half of the vertices (by hash) may move in a round, so that neighbours do not swap.
    """
    # the round's number is a column, so that every round runs the same compiled code
    labels = save(degree.select("unit", "k", F.col("unit").alias("label"), F.lit(0).alias("round")))
    total, quiet = labels.count(), 0
    for _ in range(rounds):
        size = labels.groupBy("label").agg(F.sum("k").alias("size"))
        links = both.where("src <> dst").join(labels.select(F.col("unit").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("unit"), "label").agg(F.sum("w").alias("links"))
        here = F.when(F.col("label") == F.col("own"), F.col("size") - F.col("k")).otherwise(F.col("size"))
        with_own = links.join(labels.select("unit", F.col("label").alias("own"), "k"), "unit").join(size, "label")
        gain = F.round(F.col("links") - gamma * F.col("k") * here / m2, 9)
        best = with_own.withColumn("gain", gain).groupBy("unit").agg(F.max(F.struct(F.col("gain"), -F.col("label"))).alias("best"), F.max(F.when(F.col("label") == F.col("own"), F.col("gain"))).alias("stay"))
        may = F.pmod(F.xxhash64("unit", "round", *([F.lit(seed)] if seed else [])), F.lit(2)) == 0
        to = F.when(may & (F.col("best.gain") > F.greatest(F.coalesce("stay", F.lit(0.0)), F.lit(0.0))), -F.col("best.col2")).otherwise(F.col("label"))
        after = save(labels.join(best, "unit", "left").select("unit", "k", "label", (F.col("round") + 1).alias("round"), to.alias("to")))
        quiet = quiet + 1 if after.where("`to` <> label").count() * 100 <= total else 0
        labels = after.select("unit", "k", F.col("to").alias("label"), "round")
        if quiet == 2:  # both halves have had their turn
            break
    return labels.select("unit", "label")


def communities(edges: DataFrame, save, resolutions: list[float] | None = None, levels: int = 4, rounds: int = 20, seed: int = 0) -> DataFrame:
    """(resolution, unit, label) by levels of greedy modularity moves; each level's communities are the vertices of the next.

    A level ends when the moves have settled, and the levels when no community joins another.
    ``save`` writes a table and reads it back, which keeps the lineage short. ``seed`` chooses which vertices may move in a round.
    """
    out = None
    for gamma in resolutions or [1.0]:
        level = save(edges.select("src", "dst", "w"))
        m2 = 2 * (level.agg(F.sum("w")).first()[0] or 0.0)
        names = None
        for _ in range(levels):
            both = save(both_ways(level.where("src <> dst")).unionByName(level.where("src = dst").withColumn("w", 2 * F.col("w"))))
            degree = save(both.groupBy(F.col("src").alias("unit")).agg(F.sum("w").alias("k")))
            found = save(_moves(both, degree, m2, float(gamma), save, rounds, seed))
            names = save(names.join(found.select(F.col("unit").alias("label"), F.col("label").alias("to")), "label").select("unit", F.col("to").alias("label"))) if names is not None else found
            if found.select("label").distinct().count() == found.count():
                break
            of = lambda side: found.select(F.col("unit").alias(side), F.col("label").alias(f"l_{side}"))
            ends = level.join(of("src"), "src").join(of("dst"), "dst")
            level = save(ends.select(F.least("l_src", "l_dst").alias("src"), F.greatest("l_src", "l_dst").alias("dst"), "w").groupBy("src", "dst").agg(F.sum("w").alias("w")))
        one = names.select(F.lit(float(gamma)).alias("resolution"), "unit", "label")
        out = one if out is None else out.unionByName(one)
    return out


def spectral_embedding(edges: DataFrame, size: int, save, steps: int = 5, restarts: int = 6, tolerance: float = 1e-4) -> tuple[DataFrame, np.ndarray]:
    """(unit, x: its entries in the leading eigenvectors of the normalised adjacency) and their eigenvalues, largest first.

    Each restart multiplies the vectors ``steps`` times (a join and a sum over neighbours each). What reaches the driver is the matrix
    of products of all vectors, of (size * (steps + 1)) squared cells, from which the best combinations and their eigenvalues follow.
    Restarts end when the eigenvalues stand still. Eigenvalues of the Laplacian are 1 less these.
    """
    both = both_ways(edges)
    degree = both.groupBy("src").agg(F.sum("w").alias("k"))
    scaled = both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("k").alias("k_dst")), "dst")
    scaled = save(scaled.select("src", "dst", (F.col("w") / F.sqrt(F.col("k") * F.col("k_dst"))).alias("w")))
    start = F.transform(F.sequence(F.lit(1), F.lit(size - 1)), lambda i: F.pmod(F.xxhash64("src", i), F.lit(100_003)) / 100_003.0 - 0.5) if size > 1 else F.array().cast("array<double>")
    x = save(degree.select("src", F.concat(F.array(F.sqrt("k")), start).alias("v")))
    before = None
    for _ in range(restarts):
        last, every = x, x.select("src", F.col("v").alias("z"))
        for _ in range(steps):
            sums = scaled.join(last.select(F.col("src").alias("dst"), "v"), "dst").groupBy("src").agg(F.array(*[F.sum(F.col("w") * F.get("v", i)) for i in range(size)]).alias("v"))
            last = sums
            every = every.join(sums, "src").select("src", F.concat("z", "v").alias("z"))
        every = save(every)
        gram = matrices(moments(every.select(F.lit(0).alias("key"), F.col("z").alias("samples")), "key"))[0][1:, 1:]
        n = size * steps
        value, vector = np.linalg.eigh(gram[:n, :n])
        good = value > value.max() * 1e-11
        base = vector[:, good] / np.sqrt(value[good])
        inner = base.T @ gram[:n, size:] @ base
        ritz, mix = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = ritz[::-1][:size], base @ mix[:, ::-1][:, :size]

        def turned(batches: Iterator[pa.RecordBatch], turn: np.ndarray = turn, n: int = n) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = np.asarray(batch.column("z").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)[:, :n] if batch.num_rows else np.zeros((0, n))
                yield pa.RecordBatch.from_arrays([batch.column("src"), pa.array((z @ turn).tolist(), pa.list_(pa.float64()))], names=["src", "v"])

        x = save(every.mapInArrow(turned, "src long, v array<double>"))
        settled = before is not None and len(before) == len(values) and np.abs(values - before).max() < tolerance
        before, size = values, len(values)
        if settled:
            break
    return x.select(F.col("src").alias("unit"), F.col("v").alias("x")), before


def bisected(edges: DataFrame, save) -> DataFrame:
    """(unit, side): sign of the second eigenvector of the normalised adjacency."""
    found, _ = spectral_embedding(edges, 4, save)
    return found.select("unit", (F.get("x", 1) >= 0).cast("int").alias("side"))
