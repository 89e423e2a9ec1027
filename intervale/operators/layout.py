"""Two-dimensional layouts of weighted graphs by attraction along edges and repulsion from random vertices.

Coordinates are a table by vertex, and an epoch is two joins: a vertex meets the ends of its edges, and a few vertices that a hash of it and
the epoch draws from all. Its moves are added up, in whole numbers, so neither partitions nor their order change a digit; each epoch's
coordinates are written, which keeps the lineage short.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.operators import graph as G
from intervale.operators import models as M
from intervale.operators import neighbours as N
from intervale.operators import scans

Save = Callable[[DataFrame], DataFrame]

#: Shape of the curve 1 / (1 + a d^(2 b)) that joins two vertices at distance d, for layouts in which near ones are about 0.1 apart.
CURVE = (1.577, 0.895)
#: Vertices that repel one in an epoch, and how much they count as for each edge.
REPELLING, PER_EDGE = 8, 5.0
#: A force's greatest component, and a step of the whole numbers that moves are added in.
LIMIT, UNIT = 4.0, 1e-12


def started(data: DataFrame, save: Save, spread: float = 10.0) -> DataFrame:
    """(unit, number, x, y): the first two principal scores of ``data`` (unit, samples), scaled to ``spread``, and units numbered from 0.

    A unit's coordinates are moved a little by its hash, so that equal vectors do not stay together. Rows are those of ``neighbours.usable``.
    """
    rows = save(N.usable(data))
    if rows.isEmpty():
        return data.sparkSession.createDataFrame([], "unit long, number long, x double, y double")
    found = M.matrices(M.moments(rows.select(F.lit(0).alias("key"), "samples"), "key"))[0]
    mean, parts, values = M.principal(found, min(2, len(found) - 1))
    top = max(float(values[0]) ** 0.5, 1e-12) * 3
    score = lambda p: F.aggregate(F.zip_with("samples", F.array(*[F.lit(float(w)) for w in p]), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v) - float(mean @ p)
    at = [F.round(score(p) * spread / top, 6) for p in parts] + [F.lit(0.0)] * (2 - len(parts))
    nudge = lambda k: (F.pmod(F.xxhash64("unit", F.lit(k)), F.lit(20_001)) - 10_000) / 1e5
    placed = rows.select("unit", *[(c + nudge(k)).alias(n) for k, (c, n) in enumerate(zip(at, "xy", strict=True))])
    ranked = scans.scanned(scans.dealt(placed, [], ["unit"], save), [], ["unit"], {"number": ("rank", None)})
    return save(ranked.select("unit", (F.col("number") - 1).alias("number"), "x", "y"))


def _whole(c: Column) -> Column:
    return F.round(F.greatest(F.least(c, F.lit(LIMIT)), F.lit(-LIMIT)) / UNIT).cast("long")


def laid_out(edges: DataFrame, start: DataFrame, save: Save, epochs: int = 60, rate: float = 1.0, seed: int = 0) -> DataFrame:
    """(unit, x, y) after ``epochs`` of moves from ``start`` (unit, number, x, y) along undirected ``edges`` (src, dst, w).

    Attraction follows the edges by weight; repulsion comes from REPELLING vertices, as strong as PER_EDGE for each edge of mean weight.
    The rate falls to zero, and a vertex's forces are shared among its edges' weight, so that one of high degree does not overshoot.
    """
    a, b = CURVE
    both = G.both_ways(edges.where("src <> dst"))
    degree = both.groupBy(F.col("src").alias("unit")).agg(F.sum(F.round(F.col("w") / UNIT).cast("long")).alias("_k"))
    both = save(both.join(degree.withColumnRenamed("unit", "src"), "src").select("src", "dst", (F.col("w") / (F.col("_k") * UNIT)).alias("w")))
    n = start.count()
    now = start
    for epoch in range(epochs if n > 1 else 0):
        dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
        d2 = dx * dx + dy * dy
        other = now.select(F.col("unit").alias("dst"), F.col("number").alias("_n"), F.col("x").alias("ox"), F.col("y").alias("oy"))
        own = now.select(F.col("unit").alias("src"), "x", "y")
        pull = F.when(d2 > 0, -2.0 * a * b * F.pow(d2, b - 1) / (1 + a * F.pow(d2, b))).otherwise(0.0) * F.col("w") * REPELLING / PER_EDGE
        pulled = both.join(own, "src").join(other.drop("_n"), "dst").select("src", _whole(pull * dx).alias("mx"), _whole(pull * dy).alias("my"))
        drawn = F.transform(F.sequence(F.lit(1), F.lit(REPELLING)), lambda j: F.pmod(F.xxhash64("unit", F.lit(seed), F.lit(epoch), j), F.lit(n)))
        pairs = now.select(F.col("unit").alias("src"), "x", "y", F.explode(drawn).alias("_n")).join(other.select("_n", "dst", "ox", "oy"), "_n").where("src <> dst")
        push = 2.0 * b / ((0.001 + d2) * (1 + a * F.pow(d2, b)))
        pushed = pairs.select("src", _whole(push * dx).alias("mx"), _whole(push * dy).alias("my"))
        moves = pulled.unionByName(pushed).groupBy(F.col("src").alias("unit")).agg(F.sum("mx").alias("mx"), F.sum("my").alias("my"))
        step = rate * (1 - epoch / epochs) * UNIT
        now = save(now.join(moves, "unit", "left").select("unit", "number", *[F.round(F.col(c) + F.greatest(F.least(F.coalesce(F.col(f"m{c}"), F.lit(0)) * step, F.lit(LIMIT)), F.lit(-LIMIT)), 9).alias(c) for c in "xy"]))
    return now.select("unit", "x", "y")


def kept_neighbours(layout: DataFrame, near: DataFrame, k: int, save: Save) -> DataFrame:
    """(n, share): of each vertex's ``k`` nearest in the ``layout``, the share that its list ``near`` (src, dst) has."""
    flat = N.nearest_of_all(layout.select("unit", F.array("x", "y").alias("samples")), k, save)
    met = flat.select("src", "dst").join(near.select("src", "dst").withColumn("_in", F.lit(1)), ["src", "dst"], "left")
    return met.agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("_in", F.lit(0))).alias("share"))
