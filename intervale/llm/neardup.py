"""Near-duplicate documents by min-max hashing of word shingles.

Signatures: each of the permutations gives a document its smallest and its largest shingle value, so half as many hash
evaluations fill a signature. Bands of the signature choose candidates; full shingle sets confirm links.

Copies with the same set form a class, which is one vertex from then on. Each bucket links its members to its smallest one; the
components of these candidate links are clusters. All sets of a cluster meet in blocks of bounded size and are compared exactly, so
a link inside a bucket is never missed because the bucket is large; what leaves a block is a spanning forest of its links, not its
pairs. Rows of a frequent band, cluster or class are spread over tasks wherever they meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm import words as W
from intervale.llm.components import connected_components
from intervale.llm.skew import hot_keys, spread_join
from intervale.llm.store import dropped, written

#: Bands, and values of a band. At similarity 0.85 a link is missed with probability (1 - 0.85 ** 6) ** 40 < 1e-8.
BANDS, ROWS = 40, 6
#: Documents of a cluster that are compared at once, and the bytes of their sets (a larger set is a block of its own).
BLOCK, BLOCK_BYTES = 125, 4 << 20
#: Shingles whose signatures are computed at once, to stay in a core's cache.
AT_ONCE = 1 << 15

SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    codes, ends, distinct = W.split(texts, W.LOWER)
    hashed = W.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    runs = W.windows(hashed, size)
    out = []
    for start, end in zip(ends[:-1], ends[1:], strict=True):
        n = end - start
        if n >= size:
            out.append(np.unique(runs[start : end - size + 1]))
        elif n:
            out.append(W.mix(W.windows(hashed[start:end], int(n)) ^ np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band keys of non-empty sets, by min-max hashing with ``bands * rows / 2`` permutations."""
    n_perm = bands * rows // 2
    dice = np.random.default_rng(20240229)
    factor, shift = dice.integers(1, 1 << 63, n_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1), dice.integers(0, 1 << 63, n_perm, dtype=np.uint64)
    low, high = np.empty((n_perm, len(sets)), np.uint64), np.empty((n_perm, len(sets)), np.uint64)
    at = 0
    while at < len(sets):
        upto, total = at, 0
        while upto < len(sets) and (upto == at or total + len(sets[upto]) <= AT_ONCE):
            total += len(sets[upto])
            upto += 1
        values = np.concatenate(sets[at:upto])
        starts = np.cumsum([0] + [len(s) for s in sets[at : upto - 1]])
        for p in range(n_perm):
            permuted = (values ^ shift[p]) * factor[p]
            low[p, at:upto] = np.minimum.reduceat(permuted, starts)
            high[p, at:upto] = np.maximum.reduceat(permuted, starts)
        at = upto
    signature = np.stack([low, high], axis=1).reshape(2 * n_perm, len(sets))
    keys = np.empty((bands, len(sets)), np.uint64)
    for band in range(bands):
        key = np.full(len(sets), band, np.uint64)
        for row in range(rows):
            key = W.joined(key, signature[band * rows + row])
        keys[band] = key
    return keys.T


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each set."""
    a = np.array([W.mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    b = np.array([W.mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return a, b


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """Of each document: the number of its shingles, a 128-bit fingerprint of the set and its band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in W.slices(batch, most=2 << 20):
                sets = shingle_sets(some.column("text"), size)
                full = [s for s in sets if len(s)]
                keys = band_keys(full, bands, rows) if full else np.zeros((0, bands), np.uint64)
                has = np.array([len(s) > 0 for s in sets], dtype=bool)
                a, b = fingerprints(sets)
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), W.signed(np.ascontiguousarray(keys).reshape(-1)))
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), W.signed(a), W.signed(b), lists], names=["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, SIGNATURE)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For runs of rows of ``left``: the first row, and the sizes of their intersections with all of ``right``."""
    values = np.concatenate(right)
    owner = np.repeat(np.arange(len(right)), [len(s) for s in right])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    for at in range(len(left)):
        first, last = np.searchsorted(values, left[at]), np.searchsorted(values, left[at], side="right")
        n = last - first
        total = int(n.sum())
        spread = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        yield at, np.bincount(owner[spread], minlength=len(right))


def forest(ids: np.ndarray, sets: list[np.ndarray], blocks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """(id, root) of a spanning forest of the links between sets of one block, or of two different ones."""
    n = len(ids)
    root = np.arange(n)
    own = blocks == blocks[0]
    rows, columns = (np.arange(n), np.arange(n)) if own.all() else (np.flatnonzero(own), np.flatnonzero(~own))
    size = np.array([len(s) for s in sets], dtype=np.int64)
    for at, shared in overlaps([sets[i] for i in rows], [sets[i] for i in columns]):
        i = rows[at]
        linked = columns[100 * shared >= percent * (size[i] + size[columns] - shared)]
        group = np.unique(np.append(root[linked], root[i]))
        if len(group) > 1:
            root[np.isin(root, group)] = group[0]
    return [(int(ids[i]), int(ids[root[i]])) for i in range(n) if root[i] != i]


def sets_of_clusters(docs: DataFrame, clusters: DataFrame, size: int, block: int) -> DataFrame:
    """(id, root, n_blocks, own, shingles): the full set of each class of a cluster, and its block there.

    ``clusters`` has id, root, and of the class doc_id, n_shingles, set_a and set_b; of the texts of a repeated doc_id those of the
    class itself are taken.
    """
    sizes = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("_shingles"))
    n_blocks = F.ceil(F.greatest(F.col("n") / F.lit(block), 8 * F.col("_shingles") / F.lit(BLOCK_BYTES))).cast("int")
    counted = sizes.select("root", "n", n_blocks.alias("n_blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int")
    placed = spread_join(clusters, counted.drop("n"), ["root"], hot_keys(counted, ["root"]), ["id"]).withColumn("own", own).drop("n_shingles")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "root", "n_blocks", "own"]
        for batch in batches:
            for some in W.slices(batch, most=2 << 20):
                sets = shingle_sets(some.column("text"), size)
                a, b = fingerprints(sets)
                its_own = (a.view(np.int64) == np.asarray(some.column("set_a"))) & (b.view(np.int64) == np.asarray(some.column("set_b")))
                rows = pa.RecordBatch.from_arrays([*(some.column(c) for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*names, "shingles"])
                yield rows.filter(pa.array(its_own))

    texts = docs.select("doc_id", "text")
    # a sort-merge join at every size: the plan, and what it shuffles, grows evenly
    return texts.join(placed.hint("merge"), "doc_id").drop("doc_id").mapInArrow(sets_of, "id long, root long, n_blocks int, own int, shingles binary").dropDuplicates(["id"])


def compared(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, whole): forests of the links in each group (root, one, two) of rows (those, side, id, shingles, whole).

    Rows of side 0 meet those of side 1; a group with one side is compared with itself. A group holds two blocks at most.
    """
    ordered = rows.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two", "side", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, sets, is_whole = None, [], [], [], False
        found: list[tuple[int, int, bool]] = []

        def settle() -> None:
            if len(ids) > 1:
                found.extend((a, b, is_whole) for a, b in forest(np.array(ids), sets, np.array(sides), percent) if a != b)

        def out() -> pa.RecordBatch:
            a, b, w = zip(*found, strict=True) if found else ((), (), ())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(w, pa.bool_())], names=["a", "b", "whole"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("root", "one", "two", "id", "side", "whole", "shingles")]
            for root, one, two, i, side, whole, shingles in zip(*columns, strict=True):
                if (root, one, two) != key:
                    settle()
                    key, ids, sides, sets, is_whole = (root, one, two), [], [], [], whole
                ids.append(i)
                sides.append(side)
                sets.append(np.frombuffer(shingles, np.uint64))
            yield out()
        settle()
        yield out()

    return ordered.select("root", "one", "two", "id", "side", "whole", "shingles").mapInArrow(compare, "a long, b long, whole boolean")


def confirmed(docs: DataFrame, clusters: DataFrame, size: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b, whole): links between the classes of each cluster on full sets, as forests of bounded blocks.

    ``whole`` tells that the cluster was one block, so that b is the smallest class of a's component.

    A cluster of several blocks is compared block by block first, with its root in each. What is linked with the root then is one
    component already; only the documents outside it meet the other blocks. So a large group of true copies costs its own size,
    and the square is left to groups whose members share bands but not links.
    """
    rows = written(sets_of_clusters(docs, clusters, size, block), "sets")
    whole = F.col("n_blocks") == 1
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    own = rows.select("root", F.col("own").alias("one"), F.lit(0).alias("two"), F.lit(0).alias("side"), "id", whole.alias("whole"), "shingles")
    roots = rows.where("id = root AND n_blocks > 1").select("*", all_blocks.alias("one")).where("one <> own")
    first = written(compared(own.unionByName(roots.select("root", "one", F.lit(0).alias("two"), F.lit(0).alias("side"), "id", F.lit(False).alias("whole"), "shingles")), percent), "links")
    several = rows.where("n_blocks > 1")
    if several.isEmpty():
        return first
    parts = connected_components(first.where("NOT whole").select("a", "b")).withColumnRenamed("root", "part")
    outside = several.join(parts, "id", "left").where(F.coalesce("part", "id") != F.col("root")).drop("part")
    # as many blocks of strays as the cluster has for as many classes: one row a large cluster, which few are
    n_out = written(outside.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(block)), F.ceil(F.sum(F.octet_length("shingles")) / F.lit(BLOCK_BYTES))).cast("int").alias("n_out"), F.count(F.lit(1)).alias("n")), "strays")
    crowded = hot_keys(several.groupBy("root").agg(F.count(F.lit(1)).alias("n")), ["root"])
    strays = spread_join(outside, n_out.drop("n"), ["root"], crowded, ["id"]).withColumn("one", F.pmod(F.xxhash64("id", F.lit(1)), F.col("n_out")).cast("int"))
    columns = ["root", "one", "two", "side", "id", "whole", "shingles"]
    left = strays.select("*", all_blocks.alias("two"), F.lit(0).alias("side"), F.lit(False).alias("whole")).select(columns)
    right = spread_join(several, n_out.drop("n"), ["root"], crowded, ["id"]).select("*", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("one"), F.col("own").alias("two"), F.lit(1).alias("side"), F.lit(False).alias("whole")).select(columns)
    return first.unionByName(compared(left.unionByName(right), percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are what lies between ASCII white space, with A-Z lower-cased; a document's set has its distinct ``size``-word
    shingles, or its whole word sequence if that is shorter. Documents are linked when 100 * intersection >= percent * union,
    and component_id is the smallest doc_id that can be reached over links; kept marks that document.

    Null, empty and blank texts have no shingles and are linked with nothing. A null doc_id is linked with nothing either and
    has a null component_id. Repeated rows get a row each; rows of one doc_id with different texts are judged by their own text. An
    empty table gives an empty one. Other columns are not read. Very long texts are taken whole.
    """
    signed = written(signatures(docs, size, bands, rows), "signatures")
    able = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    same_set = signed.where(able).groupBy("set_a", "set_b").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = written(same_set.withColumn("id", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("id", F.explode("bands").alias("key"))
    buckets = written(keyed.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    candidates = spread_join(keyed, buckets.drop("n"), ["key"], hot_keys(buckets, ["key"]), ["id"]).where("id <> least")
    # a class and the smallest ones of all its buckets hang on the smallest of these: few edges, however many buckets a group shares
    shared = candidates.groupBy("id").agg(F.collect_set("least").alias("leasts"))
    star = F.transform(F.array_append("leasts", F.col("id")), lambda v: F.struct(v.alias("a"), F.array_min("leasts").alias("b")))
    edges = shared.select(F.explode(star).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
    clusters = written(connected_components(edges).join(classes.select("id", "doc_id", "n_shingles", "set_a", "set_b"), "id"), "clusters")
    links = written(confirmed(docs, clusters, size, percent), "links")
    single = links.where("whole").select(F.col("a").alias("id"), F.col("b").alias("root"))
    several = links.where("NOT whole").select("a", "b")
    roots = single if several.isEmpty() else single.unionByName(connected_components(several))
    members = written(classes.select("set_a", "set_b", "id", "doc_id", "n").join(roots, "id", "left").select("set_a", "set_b", "doc_id", "n", F.coalesce("root", "id").alias("root")), "members")
    components = members.groupBy("root").agg(F.min("doc_id").alias("component"), F.count(F.lit(1)).alias("n"))
    named = spread_join(members.drop("n"), components.drop("n"), ["root"], hot_keys(components, ["root"]), ["doc_id"]).select("set_a", "set_b", "component")
    columns = signed.select("doc_id", "n_shingles", "set_a", "set_b")
    found = spread_join(columns.where(able), named, ["set_a", "set_b"], hot_keys(members, ["set_a", "set_b"]), ["doc_id"]).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = columns.where(~able).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    dropped(buckets)
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
