"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

Features of a text are its words, pairs of neighbouring words and the character n-grams of each word, hashed into buckets. Each
bucket has a learned vector; a document is the mean of its features' vectors, and a softmax layer gives the class. Vectors and
layer are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled documents. The trained model is
of fixed size and is broadcast; scoring runs where the documents lie, without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm import words as W

#: Labelled documents that the model is fitted on, at most; those with the smallest hashes are taken.
SAMPLE = 6000
#: Distinct features that a text is fitted on, at most: of a longer one, so many by a hash are drawn from the whole text. So the driver gets
#: SAMPLE * FITTED features at most, packed (1 to 2 bytes each, as texts go). Any text is scored with all its features.
FITTED = 4096
BUCKETS, SIZE = 1 << 17, 8
#: Lengths of character n-grams.
GRAMS = (2, 3, 4)
EPOCHS, RATE = 4, 0.6
#: Bytes of text that a task scores at once; a byte gives about three features.
SCORED_BYTES = 1 << 20
#: Features that the prior weighs as much as: texts of a few words give little evidence of their own.
PRIOR_WEIGHT = 20


def _gram_features(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of each distinct word (itself and its character n-grams, with borders), and ends."""
    n = len(distinct)
    words = distinct.to_pylist()
    data = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], dtype=np.int64)
    end = np.cumsum(length)
    owner = np.repeat(np.arange(n, dtype=np.int32), length)
    bucket = lambda h: (h % np.uint64(BUCKETS)).astype(np.int32)
    buckets, owners = [bucket(W.mix(W.hashes(distinct)))], [np.arange(n, dtype=np.int32)]
    base = W.mix(data + np.uint64(0x1F3))
    for size in GRAMS:
        rolled = W.windows(base, size)
        if len(rolled):
            fits = np.arange(len(rolled)) + size <= end[owner[: len(rolled)]]
            buckets.append(bucket(rolled[fits] ^ np.uint64(size << 8)))
            owners.append(owner[: len(rolled)][fits])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.searchsorted(owner[order], np.arange(n + 1))


def _pair_features(codes: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """The bucket of each pair of neighbouring words; a word that follows itself gives one bucket of its own."""
    if len(codes) < 2:
        return np.zeros(0, np.int32)
    pair = W.joined(hashed[codes[:-1]], hashed[codes[1:]])
    return np.where(codes[:-1] == codes[1:], np.int32(0), 1 + (pair % np.uint64(BUCKETS - 1)).astype(np.int32))


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text."""
    codes, ends, distinct = W.split(texts)
    hashed = W.hashes(distinct) if len(distinct) else np.zeros(0, np.uint64)
    flat, cuts = _gram_features(distinct) if len(distinct) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    out = []
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        mine = codes[a:b]
        n = cuts[mine + 1] - cuts[mine]
        grams = flat[np.repeat(cuts[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if len(mine) else flat[:0]
        bucket, count = np.unique(np.concatenate([grams, _pair_features(mine, hashed)]), return_counts=True)
        out.append((bucket, count.astype(np.float32)))
    return out


@dataclass
class Model:
    """Bucket vectors, output layer, and the prior that a text without features gets."""

    vectors: np.ndarray
    layer: np.ndarray
    bias: np.ndarray
    prior: float

    @property
    def gains(self) -> np.ndarray:
        """What each bucket adds to the log-odds of class 1: the mean of the vectors goes through a linear layer."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)


def packed(bucket: np.ndarray, count: np.ndarray) -> bytes:
    """A bag in few bytes: steps between its rising buckets, then counts (cut at 65,535), equal places of all numbers together, deflated."""
    if not len(bucket):
        return b""
    numbers = np.concatenate([np.diff(bucket, prepend=0), np.minimum(count, 65_535)]).astype("<u4")
    return zlib.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The (buckets, counts) of ``packed``."""
    places = np.frombuffer(zlib.decompress(bag) if bag else b"", np.uint8).reshape(4, -1)
    steps, count = np.ascontiguousarray(places.T).view("<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), count.astype(np.float32)


def drawn(bucket: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The bag itself, or ``most`` entries of it by a hash of the bucket and of the whole bag, so that texts draw independently."""
    if len(bucket) <= most:
        return bucket, count
    lot = W.mix(bucket.astype(np.uint64) ^ W.mix(np.uint64(len(bucket)) + W.mix((bucket.astype(np.uint64) << np.uint64(20)) + count.astype(np.uint64)).sum(keepdims=True)))
    some = np.sort(np.argpartition(lot, most)[:most])
    return bucket[some], count[some]


def bagged(texts: DataFrame, most: int = FITTED) -> DataFrame:
    """(doc_id, lot, quality, bag) of rows (doc_id, lot, quality, text): bags are made and packed where the texts lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in W.slices(batch, most=1 << 20):
                found = pa.array([packed(*drawn(*bag, most)) for bag in bags(some.column("text"))], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), some.column("lot"), some.column("quality"), found], names=["doc_id", "lot", "quality", "bag"])

    return texts.select("doc_id", "lot", "quality", "text").mapInArrow(run, "doc_id long, lot long, quality int, bag binary")


def fit(documents: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent on the softmax loss over packed bags, unpacked one at a time; both classes weigh the same."""
    dice = np.random.default_rng(seed)
    vectors = dice.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    layer, bias = np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32)
    share = np.bincount(labels, minlength=2) / max(len(labels), 1)
    weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
    usable = np.flatnonzero([len(bag) > 0 for bag in documents])
    steps, done = max(1, epochs * len(usable)), 0
    for _ in range(epochs):
        for i in dice.permutation(usable):
            bucket, part = unpacked(documents[i])
            part /= part.sum()
            mean = part @ vectors[bucket]
            score = mean @ layer + bias
            p = np.exp(score - score.max())
            p /= p.sum()
            p[labels[i]] -= 1
            step = np.float32(rate * (1 - done / steps) * weight[labels[i]])
            pull = layer @ p
            layer -= step * np.outer(mean, p)
            bias -= step * 0.1 * p
            vectors[bucket] -= (step * len(bucket) ** 0.5 * 4) * part[:, None] * pull
            done += 1
    return Model(vectors, layer, bias, float(share[1]))


def trained(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> Model:
    """The model of at most ``sample`` labelled documents for which ``usable`` (a condition on doc_id) holds."""
    label = labels.where(F.col("quality").isin(0, 1) & usable).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    some = label.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").withColumn("lot", F.xxhash64("text"))
    table = bagged(texts).orderBy("doc_id", "lot").limit(sample).select("quality", "bag").toArrow()
    if not table.num_rows:
        return Model(np.zeros((BUCKETS, SIZE), np.float32), np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32), 0.5)
    return fit(table.column("bag").to_pylist(), np.asarray(table.column("quality").combine_chunks()))


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Each row of ``docs`` with its score in ``column``, a new name: the model's odds, drawn to the prior in texts of few features."""
    gains = docs.sparkSession.sparkContext.broadcast((model.gains, float(model.bias[1] - model.bias[0]), model.prior))
    columns = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, bias, prior = gains.value
        for batch in batches:
            for some in W.slices(batch, most=SCORED_BYTES):
                n = some.num_rows
                codes, ends, distinct = W.split(some.column("text"))
                total, count = np.zeros(n), np.zeros(n)
                if len(codes):
                    flat, cuts = _gram_features(distinct)
                    sums = np.add.reduceat(gain[flat].astype(np.float64), cuts[:-1])
                    text = np.repeat(np.arange(n), np.diff(ends))
                    pairs = np.concatenate([_pair_features(codes, W.hashes(distinct)), [0]])
                    within = np.concatenate([text[1:] == text[:-1], [False]])
                    total = np.bincount(text, weights=sums[codes] + np.where(within, gain[pairs], 0), minlength=n)
                    count = np.bincount(text, weights=np.diff(cuts)[codes] + within, minlength=n)
                prior_odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
                own = count / (count + PRIOR_WEIGHT)
                odds = own * (total / np.maximum(count, 1) + bias) + (1 - own) * prior_odds
                p = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in columns), pa.array(p)], names=[*columns, column])

    return docs.mapInArrow(score, docs.withColumn(column, F.lit(0.0)).schema)


def held_out(doc_id: Column) -> Column:
    """The fold that no label is learned from: crc32 of doc_id as text, a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fold_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled documents outside the held-out fold."""
    return trained(docs, labels, ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull(), sample)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` at least, with all their columns; cases as in ``quality_scores``."""
    column = "_score"
    while column in docs.columns:
        column += "_"
    return scored(docs, fold_model(docs, labels, sample), column).where(F.col(column) >= threshold).drop(column)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, likelier of quality 1) and predicted (score >= threshold) of every row of ``docs``.

    Learned from labelled documents outside the held-out fold, at most ``sample`` of them, of any length; only text
    enters a score.

    Null and empty texts get the share of class 1 among the fitted documents. Without usable labels every score is 0.5. Repeated
    rows score alike; a null doc_id is scored and never held out. Labels other than 0 and 1 are left out; where a document has
    several, the highest counts. An empty table gives an empty one; other columns are not read. Texts are scored whole.
    """
    model = fold_model(docs, labels, sample)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
