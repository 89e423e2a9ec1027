"""Hard negatives by branch and bound over vertically stored vectors.

Vectors are stored by dimension. An anchor reads the dimensions in the order of its own magnitudes, largest first, and keeps a bitmap of
candidates; what the dimensions not yet read can add at least and at most, by the block's smallest and largest entries, drops those that
cannot come among its results. What is left when all dimensions are read has exact scores.

Anchors are a stated share of the rows. They are sent to the tasks in blocks of bounded size, one block at a time, and each block meets
all rows where they lie: vectors are not shuffled, and a task keeps a few results an anchor, whatever it reads.

Edge cases: rows with a null id, label or vector, with a null or non-finite component, or with one beyond ``LARGEST`` (whose products may
leave a long) take no part. A shorter vector counts as filled up with zeros. Rows that repeat an id are rows of their own: each may be
an anchor, a positive of the other, or a negative. Equal scores go to the smaller id, then to the row that was numbered first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.llm.store import written

#: Entries of the vectors of one block of anchors at most (8 MB), and rows that a task scans at once.
ANCHOR_CELLS, SCAN_ROWS = 1 << 20, 16_384
#: Dimensions read between two looks at the bounds.
STEP = 8
#: Components are integers of this magnitude at most: sums of up to 2048 products fit into a long.
LARGEST = 1 << 26


def usable(df: DataFrame, id_column: str, label: str, vector: str, scale: int) -> DataFrame:
    """(_row, id, label, x): the rows that take part, with floor(scale * component) as long."""
    entry = F.col("_v")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & entry.isNotNull() & ~F.exists(entry, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST / scale))
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("_v")).where(fine)
    return rows.select(F.monotonically_increasing_id().alias("_row"), "id", "label", F.transform(entry, lambda c: F.floor(c * scale).cast("long")).alias("x"))


def filled(lists: pa.Array, width: int | None = None) -> np.ndarray:
    """Lists of whole numbers as the columns of a (width, rows) matrix, shorter ones filled with zeros, longer ones cut."""
    n = np.asarray(lists.value_lengths(), dtype=np.int64)
    width = int(n.max(initial=0)) if width is None else width
    flat = np.asarray(lists.flatten(), dtype=np.int64)
    out = np.zeros((width, len(n)), np.int64)
    row, place = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    inside = place < width
    out[place[inside], row[inside]] = flat[inside]
    return out


class Block:
    """Rows in vertical storage: one line of entries per dimension, with the least and the greatest of each."""

    def __init__(self, x: np.ndarray, largest: int):
        # sums of products below 2 ** 53 are exact as doubles
        exact = float(np.abs(x).max(initial=0)) * largest * max(len(x), 1) < 2**53
        self.x = x.astype(np.float64) if exact else x
        self.low, self.high = (self.x.min(axis=1), self.x.max(axis=1)) if x.size else (np.zeros(len(x)), np.zeros(len(x)))


def scanned(block: Block, anchor: np.ndarray, alive: np.ndarray, windows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores): those of the rows ``alive`` that can be among the ``most`` best inside one of ``windows``.

    ``windows`` has a line (least score that still counts, greatest one) each. The result holds every row that belongs to a window's best,
    and may hold others; their scores are exact.
    """
    a = anchor.astype(block.x.dtype)
    order = np.argsort(-np.abs(a), kind="stable")
    order = order[a[order] != 0]
    ends = np.stack([a[order] * block.low[order], a[order] * block.high[order]])
    # what the dimensions from a place on can add, at least and at most
    least = np.append(np.cumsum(ends.min(axis=0)[::-1])[::-1], 0)
    greatest = np.append(np.cumsum(ends.max(axis=0)[::-1])[::-1], 0)
    windows = windows.copy()
    score = np.zeros(len(alive), block.x.dtype)
    for start in range(0, len(order), STEP):
        dims = order[start : start + STEP]
        more = (a[dims] @ block.x[dims])[alive] if 4 * len(alive) > block.x.shape[1] else a[dims] @ block.x[np.ix_(dims, alive)]
        score = score + more
        done = min(start + STEP, len(order))
        low, high = score + least[done], score + greatest[done]
        keep = np.zeros(len(alive), bool)
        for w in windows:
            sure = (low >= w[0]) & (high <= w[1])
            if np.count_nonzero(sure) >= most:
                w[0] = max(w[0], np.partition(low[sure], -most)[-most])
            keep |= (high >= w[0]) & (low <= w[1])
        if not keep.all():
            alive, score = alive[keep], score[keep]
        if not len(alive):
            break
    return alive, score.astype(np.int64)


def best_of(score: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` first by score (high first), id and row."""
    if len(score) > 4 * most:
        some = np.flatnonzero(score >= np.partition(score, -most)[-most])
        return some[np.lexsort((rows[some], ids[some], -score[some]))[:most]]
    return np.lexsort((rows, ids, -score))[:most]


NO_LIMIT = np.iinfo(np.int64).max


def scan(rows: DataFrame, anchors: list, widest: int, most: int, same_label: bool) -> DataFrame:
    """(a_row, low, high, score, id, row): what each task finds for each anchor and window, its ``most`` best rows.

    ``anchors`` are tuples (_row, label, x, windows: a line of the least and the greatest score each). A row meets the anchors of its own
    label, or of the others, and never itself.
    """
    vectors = np.zeros((widest, len(anchors)), np.int64)
    for i, (_, _, x, _) in enumerate(anchors):
        vectors[: len(x), i] = x
    sent = rows.sparkSession.sparkContext.broadcast((vectors, np.array([a[0] for a in anchors]), np.array([a[1] for a in anchors]), [a[3] for a in anchors]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, names, labels, windows = sent.value
        largest = int(np.abs(vectors).max(initial=0))
        best: dict[tuple[int, int], np.ndarray] = {}  # (anchor, window): lines of score, id, row

        def meet(parts: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(parts).combine_chunks()
            own, ids, own_labels = (np.asarray(table.column(c)) for c in ("_row", "id", "label"))
            block = Block(filled(table.column("x").combine_chunks(), len(vectors)), largest)
            places = {label: np.flatnonzero(own_labels == label) for label in np.unique(own_labels)}
            everything = np.arange(len(own))
            others: dict[int, np.ndarray] = {}
            for i in range(len(names)):
                if same_label:
                    alive = places.get(labels[i], everything[:0])
                    alive = alive[own[alive] != names[i]]
                else:
                    if labels[i] not in others:
                        others[labels[i]] = everything[own_labels != labels[i]]
                    alive = others[labels[i]]
                if not len(alive):
                    continue
                bounds = windows[i].copy()
                for w in range(len(bounds)):
                    held = best.get((i, w))
                    if held is not None and len(held) == most:
                        bounds[w, 0] = max(bounds[w, 0], held[-1, 0])
                found, score = scanned(block, vectors[:, i], alive, bounds, most)
                for w, (low, high) in enumerate(bounds):
                    inside = (score >= low) & (score <= high)
                    if inside.any():
                        new = np.stack([score[inside], ids[found[inside]], own[found[inside]]], axis=1)
                        if (i, w) in best:
                            new = np.concatenate([best[i, w], new])
                        best[i, w] = new[best_of(new[:, 0], new[:, 1], new[:, 2], most)]

        waiting, n = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, SCAN_ROWS):
                piece = batch.slice(at, SCAN_ROWS)
                if n and n + piece.num_rows > SCAN_ROWS:
                    meet(waiting)
                    waiting, n = [], 0
                waiting.append(piece)
                n += piece.num_rows
        if n:
            meet(waiting)
        for i in sorted({i for i, _ in best}):
            lines = [(w, best[i, w]) for w in range(len(windows[i])) if (i, w) in best]
            bounds = np.concatenate([np.tile(windows[i][w], (len(found), 1)) for w, found in lines])
            found = np.concatenate([found for _, found in lines])
            yield pa.RecordBatch.from_pydict({"a_row": np.full(len(found), names[i]), "low": bounds[:, 0], "high": bounds[:, 1], "score": found[:, 0], "id": found[:, 1], "row": found[:, 2]})

    return rows.select("_row", "id", "label", "x").mapInArrow(run, "a_row long, low long, high long, score long, id long, row long")


def first_of_each(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` first rows of each anchor and window with their ``place``; each task cuts its own before the shuffle."""
    by = Window.partitionBy("a_row", "low", "high").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("place", F.row_number().over(by)).where(F.col("place") <= most)


def over_blocks(rows: DataFrame, anchors: DataFrame, most: int, same_label: bool, name: str) -> DataFrame | None:
    """``scan`` with the ``anchors`` (_row, label, x, windows), block by block, written; None if there is no anchor."""
    widest = anchors.agg(F.max(F.size("x"))).first()[0]
    size, block, out = max(1, ANCHOR_CELLS // max(widest or 1, 1)), [], None

    def add() -> DataFrame:
        found = written(first_of_each(scan(rows, block, widest or 0, most, same_label), most), name)
        return found if out is None else out.unionByName(found)

    for r in anchors.toLocalIterator():
        block.append((r["_row"], r["label"], np.array(r["x"], dtype=np.int64), np.array(r["windows"], dtype=np.int64).reshape(-1, 2)))
        if len(block) == size:
            out, block = add(), []
    return add() if block else out


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(df: DataFrame, id_column: str, label: str, vector: str, scale: int = 256, every: int = 50, positives: int = 5, negatives: int = 3, share: tuple[int, int] = (50, 95)) -> DataFrame:
    """For each anchor and each of its positives the hardest negatives: anchor_id, positive_id, rank, negative_id and both scores.

    Anchors are the rows whose id ``every`` divides, against all rows. A score is the inner product of whole-number vectors. Positives are
    the best ``positives`` other rows of the anchor's label; negatives the best ``negatives`` rows of other labels whose score lies
    between ``share`` hundredths of the positive's.
    """
    spark = df.sparkSession
    rows = written(usable(df, id_column, label, vector, scale), "vectors")
    anchors = rows.where(F.col("id") % every == 0)
    anywhere = F.array(F.array(F.lit(-NO_LIMIT), F.lit(NO_LIMIT)))
    found = over_blocks(rows, anchors.select("_row", "label", "x", anywhere.alias("windows")), positives, True, "positives")
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    least, most = share
    # whole numbers: the greatest is rounded down, the least up
    pairs = written(found.select("a_row", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.expr(f"(score * {least} + pmod(-score * {least}, 100)) div 100").alias("low"), F.expr(f"(score * {most} - pmod(score * {most}, 100)) div 100").alias("high")), "pairs")
    windows = pairs.where("low <= high").groupBy("a_row").agg(F.array_sort(F.collect_set(F.array("low", "high"))).alias("windows"))
    asked = anchors.join(windows, anchors["_row"] == windows["a_row"]).select("_row", "label", "x", "windows")
    hard = over_blocks(rows, asked, negatives, False, "negatives")
    if hard is None:
        return spark.createDataFrame([], SCHEMA)
    named = pairs.join(hard.select("a_row", "low", "high", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["a_row", "low", "high"])
    return named.join(anchors.select(F.col("_row").alias("a_row"), F.col("id").alias("anchor_id")), "a_row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVES_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS MATERIALIZED (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM r a JOIN r b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b AS p, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.p, s.b, p.score AS ps, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.score DESC, s.b) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, p AS positive_id, rank::INTEGER AS rank, b AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 3
"""
