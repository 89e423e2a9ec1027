"""Scores of clusterings: silhouettes without pairs, profiles, shares of factors, stability over seeds, and a grid of all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.operators import graph as G
from intervale.operators import neighbours as N
from intervale.operators import quantiles as Q
from intervale.operators import relational as R

Save = Callable[[DataFrame], DataFrame]

#: Entries of the clusters' means that are sent to the tasks at once.
SENT = 1 << 20


def silhouettes(rows: DataFrame, save: Save) -> DataFrame:
    """(unit, label, own, other, silhouette) of rows (unit, samples, label), by squared distance.

    The mean squared distance of a row to a cluster follows from the cluster's size, mean and mean squared length, which one pass sums; so
    no rows meet. own is that to the other members of its cluster, other the least of those to the other clusters. The clusters go to the
    tasks in blocks of bounded size. A row alone in its cluster has 0, as does every row of a single cluster. Rows without a label, or
    whose vector is none of ``neighbours.usable``, take no part.
    """
    labels = rows.where("label IS NOT NULL").select("unit", F.col("label").cast("string").alias("_label"), "label")
    placed = save(N.usable(rows.select("unit", "samples")).join(labels.groupBy("unit").agg(F.min("_label").alias("_label"), F.min_by("label", "_label").alias("label")), "unit"))
    first = placed.select(F.size("samples")).first()
    if first is None:
        return placed.select("unit", "label", *[F.lit(None).cast("double").alias(c) for c in ("own", "other", "silhouette")])
    width = first[0]
    squares = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)
    sums = save(placed.groupBy("_label").agg(F.count(F.lit(1)).alias("n"), F.avg(squares).alias("square"), F.array(*[F.avg(F.get("samples", i)) for i in range(width)]).alias("mean")))
    blocks = save(sums.withColumn("_block", F.floor((F.row_number().over(Window.orderBy("_label")) - 1) / max(1, SENT // width))))
    kind = placed.schema["_label"].dataType.simpleString()
    found = None
    for number in range((blocks.agg(F.max("_block")).first()[0] or 0) + 1):
        some = blocks.where(F.col("_block") == number).collect()
        sent = rows.sparkSession.sparkContext.broadcast(({r["_label"]: i for i, r in enumerate(some)}, np.array([r["n"] for r in some], dtype=float), np.array([r["square"] for r in some]), np.array([r["mean"] for r in some])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            places, n, square, mean = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    x = np.asarray(part.column("samples").flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                    far = np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ mean.T + square, 0.0)
                    mine = np.array([places.get(k, -1) for k in part.column("_label").to_pylist()])
                    here = np.flatnonzero(mine >= 0)
                    own = np.full(len(x), np.nan)
                    size = n[mine[here]]
                    own[here] = np.where(size > 1, far[here, mine[here]] * size / np.maximum(size - 1, 1), np.nan)
                    far[here, mine[here]] = np.inf
                    other = far.min(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("unit"), part.column("_label"), pa.array(own, mask=np.isnan(own)), pa.array(other, mask=~np.isfinite(other))], names=["unit", "_label", "own", "other"])

        one = placed.select("unit", "_label", "samples").mapInArrow(run, f"unit long, _label {kind}, own double, other double")
        found = one if found is None else found.unionByName(one)
    each = found.groupBy("unit").agg(F.max("own").alias("own"), F.min("other").alias("other"))
    most = F.greatest("own", "other")
    value = F.when(F.col("own").isNull() | F.col("other").isNull() | (most == 0), 0.0).otherwise((F.col("other") - F.col("own")) / most)
    return placed.select("unit", "label").join(each, "unit").select("unit", "label", "own", "other", value.alias("silhouette"))


def least_profile_distance(features: DataFrame, names: list[str], save: Save) -> float | None:
    """The least distance between two labels' median features (of rows label and ``names``), each z-scored over the labels.

    Near 0, two clusters are nearly the same. A feature without spread counts as 0; fewer than two labels give None.
    """
    whole = features.where("label IS NOT NULL")
    profile = None
    for name in names:
        one = Q.medians(whole, ["label"], F.col(name), name, save)
        profile = one if profile is None else profile.join(one, "label")
    profile = save(profile)
    stats = profile.agg(*[f(name).alias(f"{s}_{name}") for name in names for s, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [F.coalesce(F.when(F.col(f"s_{name}") > 0, (F.col(name) - F.col(f"m_{name}")) / F.col(f"s_{name}")), F.lit(0.0)) for name in names]
    scaled = save(profile.crossJoin(F.broadcast(stats)).select(F.row_number().over(Window.orderBy("label")).cast("long").alias("unit"), F.array(*z).alias("samples")))
    return N.nearest(scaled, scaled, 1).agg(F.min("distance")).first()[0]


def largest_share(rows: DataFrame, factor: str) -> float | None:
    """The largest share that one value of ``factor`` has in a label's rows: near 1, a cluster is made of one source."""
    counts = rows.where("label IS NOT NULL").groupBy("label", factor).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("label").agg((F.max("n") / F.sum("n")).alias("share")).agg(F.max("share")).first()[0]


SCHEMA = "neighbours long, resolution double, clusters long, modularity double, silhouette double, stability double, least_profile double, largest_share double"


def grid(rows: DataFrame, features: DataFrame, names: list[str], factor: str, neighbours: list[int], resolutions: list[float], seeds: list[int], save: Save) -> DataFrame:
    """A row for each number of ``neighbours`` and resolution: clusters, and how well they are told apart.

    ``rows`` are (unit, samples) and ``features`` (unit, ``names``, ``factor``). All graphs are prefixes of one list of neighbours.
    modularity is that of the unscaled null model; stability is the mean adjusted Rand index between the labels of the ``seeds``; all else
    is of the first seed.
    """
    lists = save(N.nearest_of_all(rows, max(neighbours), save))
    out = []
    for k in neighbours:
        edges = save(G.symmetric(G.fuzzy_weights(lists.where(F.col("place") <= k), k)))
        runs = [save(G.communities(edges, save, resolutions, seed=seed)) for seed in seeds]
        for resolution in resolutions:
            labels = [r.where(F.col("resolution") == resolution).select("unit", "label") for r in runs]
            pairs = [R.adjusted_rand(a.withColumnRenamed("label", "a").join(b.withColumnRenamed("label", "b"), "unit"), "a", "b").first()["ari"] for a, b in combinations(labels, 2)]
            own = save(features.join(labels[0], "unit"))
            clusters = labels[0].select("label").distinct().count()
            silhouette = silhouettes(rows.join(labels[0], "unit"), save).agg(F.avg("silhouette")).first()[0] if clusters > 1 else None
            out.append((k, float(resolution), clusters, G.modularity(edges, labels[0]).first()[0], silhouette, float(np.mean(pairs)) if pairs else None, least_profile_distance(own, names, save), largest_share(own, factor)))
    return rows.sparkSession.createDataFrame(out, SCHEMA)
