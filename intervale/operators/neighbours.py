"""Nearest neighbours of vectors: exact for a stated set of queries, and of every vector by neighbour descent.

Descent keeps a list of near vectors for each one. Lists start from a few orders of all vectors in which near ones mostly stand close:
runs of consecutive vectors are compared within themselves. Then, round by round, the vectors that stand on the lists of one vector, or
have it on theirs, are compared with each other, as neighbours of neighbours are often neighbours; lists take what is nearer. Only pairs
with an entry that came in the round before are compared, so rounds get cheaper, and they end when few lists change. A round's work grows
with the number of vectors, and rounds grow with its logarithm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive vectors that are compared with each other, entries of a list, orders of the vectors, and rounds at most.
RUN, LIST, ORDERS, ROUNDS = 512, 32, 3, 15
#: Rounds end when a smaller share of all list entries is new.
SETTLED = 0.01
#: Vectors that an order is fitted on (those with the smallest hashes) and entries of their matrix at most, and its halvings at most.
SAMPLE, SAMPLE_CELLS, DEPTH = 20_000, 4 << 20, 11
#: Queries of a block times their entries, and queries and vectors that meet at once.
QUERY_CELLS, AT_ONCE = 1 << 20, 256

NEAR = "array<struct<far: double, dst: bigint>>"


def usable(data: DataFrame) -> DataFrame:
    """(unit, samples) of the vectors that can be compared, one for each unit.

    These have no null and only finite entries, and the length that most of them have (of equally common ones the greatest). Of vectors
    that repeat a unit the smallest counts. The others take no part.
    """
    whole = data.where("unit IS NOT NULL AND size(samples) > 0").where(~F.exists("samples", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    lengths = whole.groupBy(F.size("samples").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    return whole.where(F.size("samples") == (lengths["length"] if lengths else -1)).groupBy("unit").agg(F.min(F.col("samples").cast("array<double>")).alias("samples"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(rows, -1)


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``x`` and ``y``; a pair's has the same bits wherever it is computed."""
    return np.sqrt(np.stack([((a - y) ** 2).sum(axis=1) for a in x])) if len(x) else np.zeros((0, len(y)))


def _first(gap: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first entries by distance, to nine decimals, and id; as many as are finite."""
    gap = np.round(gap, 9)
    if len(gap) > 4 * k:
        some = np.flatnonzero(gap <= np.partition(gap, k - 1)[k - 1])
        some = some[np.lexsort((ids[some], gap[some]))[:k]]
    else:
        some = np.lexsort((ids, gap))[:k]
    return some[np.isfinite(gap[some])]


def _met(data: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """(src, dst, distance): the ``k`` nearest of each task's vectors to each query."""
    sent = data.sparkSession.sparkContext.broadcast((ids, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for batch in batches:
            if not batch.num_rows:
                continue
            other, y = np.asarray(batch.column("unit"), dtype=np.int64), _matrix(batch.column("samples"), batch.num_rows)
            size = (y**2).sum(axis=1)
            for at in range(0, len(ids), AT_ONCE):
                x = vectors[at : at + AT_ONCE]
                rough = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + size - 2 * x @ y.T, 0))
                for i, gap in enumerate(rough, at):
                    gap[other == ids[i]] = np.inf
                    held, names = best[i]
                    # products lose digits: what can come first is measured again
                    bound = np.partition(gap, k - 1)[k - 1] if len(gap) > k else np.inf
                    bound = min(bound, held[-1] if len(held) == k else np.inf)
                    some = np.flatnonzero((gap <= bound + 1e-6 * (1 + bound)) & np.isfinite(gap))
                    far, who = np.concatenate([held, _gaps(vectors[i : i + 1], y[some])[0]]), np.concatenate([names, other[some]])
                    first = _first(far, who, k)
                    best[i] = far[first], who[first]
        n = np.array([len(far) for far, _ in best], dtype=np.int64)
        if n.sum():
            yield pa.RecordBatch.from_pydict({"src": np.repeat(ids, n), "dst": np.concatenate([w for _, w in best]), "distance": np.concatenate([f for f, _ in best])})

    return data.select("unit", "samples").mapInArrow(run, "src long, dst long, distance double")


def nearest(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(src, dst, distance, place): the ``k`` nearest of ``data`` to each of ``queries`` (both unit, samples), other than itself.

    Exact. Queries go to the tasks in blocks of bounded size, and each block meets all vectors where they lie; a task keeps ``k`` of its
    own for each query. Ties go to the smaller unit. Vectors take part as in ``usable``, and queries that have their length.
    """
    vectors = usable(data)
    asked = queries.select("unit").distinct().join(vectors, "unit")
    width, out, block = None, None, []

    def add() -> DataFrame:
        found = _met(vectors, np.array([u for u, _ in block], dtype=np.int64), np.array([x for _, x in block]), k)
        return found if out is None else out.unionByName(found)

    for r in asked.toLocalIterator():
        width = width or len(r["samples"])
        block.append((r["unit"], np.array(r["samples"])))
        if len(block) * width >= QUERY_CELLS:
            out, block = add(), []
    out = add() if block else out
    if out is None:
        return data.sparkSession.createDataFrame([], "src long, dst long, distance double, place long")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.round("distance", 9), "dst"))
    return out.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def fitted_order(sample: np.ndarray, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normals, cuts, direction): a tree of halvings, each by the direction between two vectors of its part, and one more direction."""
    dice = np.random.default_rng(seed)
    d = sample.shape[1]
    normals, cuts = np.zeros((2**depth - 1, d)), np.zeros(2**depth - 1)
    node = np.zeros(len(sample), np.int64)
    for at in range(2**depth - 1):
        own = np.flatnonzero(node == at)
        if len(own) > 1:
            a, b = dice.choice(own, 2, replace=False)
            normals[at] = sample[a] - sample[b]
            along = sample[own] @ normals[at]
            cuts[at] = np.median(along)
            node[own] = 2 * at + 1 + (along > cuts[at])
    return normals, cuts, dice.standard_normal(d)


def _runs(vectors: DataFrame, n: int, sample: np.ndarray, seed: int, size: int, entries: int) -> DataFrame:
    """(unit, near): from one order of the vectors, each one's nearest within its run of about ``size``."""
    depth = int(min(DEPTH, max(0, np.ceil(np.log2(max(1, n / (2 * size)))))))
    sent = vectors.sparkSession.sparkContext.broadcast(fitted_order(sample, depth, seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals, cuts, direction = sent.value
        for batch in batches:
            x = _matrix(batch.column("samples"), batch.num_rows) if batch.num_rows else np.zeros((0, len(direction)))
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + ((x * normals[node]).sum(axis=1) > cuts[node])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node), pa.array(x @ direction)], names=["unit", "samples", "cell", "along"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            gap = _gaps(x, x)
            gap[ids[:, None] == ids] = np.inf
            first = [_first(g, ids, entries) for g in gap]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            flat = np.concatenate(first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
            row = np.repeat(np.arange(len(ids)), np.diff(ends))
            near = pa.StructArray.from_arrays([pa.array(gap[row, flat]), pa.array(ids[flat])], names=["far", "dst"])
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), near)], names=["unit", "near"])

        ids, x = np.zeros(0, np.int64), None
        for batch in batches:
            if batch.num_rows:
                more = _matrix(batch.column("samples"), batch.num_rows)
                ids, x = np.concatenate([ids, np.asarray(batch.column("unit"), dtype=np.int64)]), more if x is None else np.concatenate([x, more])
                while 2 * len(ids) >= 3 * size:  # the last run has half of ``size`` at least
                    yield met(ids[:size], x[:size])
                    ids, x = ids[size:], x[size:]
        if len(ids):
            yield met(ids, x)

    placed = vectors.mapInArrow(place, "unit long, samples array<double>, cell long, along double")
    parts = int(min(10_000, max(1, n // (4 * size))))
    order = placed.repartitionByRange(parts, "cell", "along", "unit").sortWithinPartitions("cell", "along", "unit")
    return order.select("unit", "samples").mapInArrow(compare, f"unit long, near {NEAR}")


def _joined(members: DataFrame) -> DataFrame:
    """(unit, far, dst): pairs of each row's members (u, fresh, radius, samples) that are nearer than the radius of unit.

    A pair counts if one of the two is fresh.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))])
            flat = lists.flatten()
            if not len(flat):
                continue
            u, fresh, radius = (np.asarray(flat.field(i).to_numpy(zero_copy_only=False)) for i in range(3))
            x = _matrix(flat.field(3), len(flat))
            out = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                ids, first = np.unique(u[a:b], return_index=True)
                new = np.zeros(len(ids), bool)
                np.logical_or.at(new, np.searchsorted(ids, u[a:b]), fresh[a:b])
                some = a + first
                gap = _gaps(x[some], x[some])
                one, two = np.nonzero((new[:, None] | new) & (gap < radius[some][:, None]) & (ids[:, None] != ids))
                out.append((ids[one], gap[one, two], ids[two]))
            yield pa.RecordBatch.from_pydict({"unit": np.concatenate([o[0] for o in out]), "far": np.concatenate([o[1] for o in out]), "dst": np.concatenate([o[2] for o in out])})

    return members.mapInArrow(run, "unit long, far double, dst long")


def nearest_of_all(data: DataFrame, k: int, save: Callable[[DataFrame], DataFrame], size: int = RUN, entries: int = LIST, orders: int = ORDERS, rounds: int = ROUNDS) -> DataFrame:
    """(src, dst, distance, place) of the ``k`` nearest of every row of ``data`` (unit, samples), by neighbour descent.

    Tests hold the recall above 0.9, among vectors with and without clusters; up to one and a half runs the result is exact. Of the vectors
    that have one on their lists, ``entries`` by a hash meet there in a round, so a vector that is near to very many is no hot key.
    Vectors take part as in ``usable``; equal ones are at distance 0. ``save`` writes a table and reads it back.
    """
    vectors = save(usable(data))
    n = vectors.count()
    whole = 2 * n < 3 * size
    width = (vectors.select(F.size("samples")).first() or [1])[0]
    few = min(SAMPLE, max(2, SAMPLE_CELLS // width))
    sample = np.array([r["samples"] for r in vectors.orderBy(F.xxhash64("unit"), "unit").limit(few).toLocalIterator()], dtype=np.float64).reshape(-1, width)
    entries = max(entries, k)
    near = None
    for seed in range(1 if whole else orders):
        one = _runs(vectors, n, sample, seed, size, entries)
        near = one if near is None else near.unionByName(one)
    cut = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, entries)
    lists = near.groupBy("unit").agg(cut(F.flatten(F.collect_list("near"))).alias("near"))
    marked = lambda near, fresh: F.transform(near, lambda e: F.struct(e["far"].alias("far"), e["dst"].alias("dst"), fresh(e["dst"]).alias("fresh")))
    lists = save(lists.select("unit", marked("near", lambda _: F.lit(True)).alias("near")))
    for number in range(0 if whole else rounds):
        edges = lists.select("unit", F.inline("near"))
        forward = edges.select(F.col("unit").alias("v"), F.col("dst").alias("u"), "fresh")
        turn = F.row_number().over(Window.partitionBy("dst").orderBy(F.xxhash64("unit", F.lit(number)), "unit"))
        back = edges.withColumn("turn", turn).where(F.col("turn") <= entries).select(F.col("dst").alias("v"), F.col("unit").alias("u"), "fresh")
        around = forward.unionByName(back).groupBy("v").agg(F.collect_set(F.struct("u", "fresh")).alias("m")).where(F.exists("m", lambda e: e["fresh"]))
        radius = F.when(F.size("near") >= entries, F.get("near", F.lit(entries - 1))["far"]).otherwise(float("inf"))
        known = vectors.join(lists.select("unit", radius.alias("radius")), "unit").withColumnRenamed("unit", "u")
        members = around.select("v", F.inline("m")).join(known, "u").groupBy("v").agg(F.collect_list(F.struct("u", "fresh", "radius", "samples")).alias("members"))
        found = _joined(members.select("members")).groupBy("unit").agg(F.collect_set(F.struct("far", "dst")).alias("found"))
        old = F.transform("near", lambda e: F.struct(e["far"].alias("far"), e["dst"].alias("dst")))
        merged = lists.join(found, "unit", "left").select("unit", F.col("near.dst").alias("before"), cut(F.concat(old, F.coalesce("found", F.array().cast(NEAR)))).alias("near"))
        lists = save(merged.select("unit", marked("near", lambda dst: ~F.array_contains("before", dst)).alias("near")))
        changed = lists.agg(F.sum(F.size(F.filter("near", lambda e: e["fresh"])))).first()[0] or 0
        if changed <= SETTLED * entries * n:
            break
    ordered = F.slice(F.array_sort(F.transform("near", lambda e: F.struct(F.round(e["far"], 9).alias("r"), e["dst"].alias("dst"), e["far"].alias("distance")))), 1, k)
    return lists.select(F.col("unit").alias("src"), F.posexplode(ordered).alias("at", "e")).select("src", "e.dst", "e.distance", (F.col("at") + 1).cast("long").alias("place"))
