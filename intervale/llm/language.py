"""Language identification by nearest centroid.

A text's vector holds the TF-IDF weights of its character n-grams, hashed into buckets and scaled to length one. Each language
has several centroids, found by k-means on the cosine over its own training documents, in one task per language. A text takes
the language of the centroid with the largest cosine; a text that lies further from it than nearly all training documents of that
centroid is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intervale.llm import words as W

BUCKETS = 4096
GRAMS = (1, 2, 3)
CENTROIDS, ROUNDS = 4, 8
#: Training documents of a language, at most; those with the smallest hashes are taken.
SAMPLE = 1500
#: Share of a centroid's training documents that lie nearer than its bound.
WITHIN = 0.995
UNKNOWN = "und"


def counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """N-gram counts (texts x buckets), and which texts have a letter. Letters are lower-cased, all else is a space."""
    whole = [(t or "").lower() for t in texts.to_pylist()]
    data = np.frombuffer("\n".join([*whole, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.array([len(t) + 1 for t in whole], dtype=np.int64)
    text = np.repeat(np.arange(len(whole)), length)
    distinct, code = np.unique(data, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in distinct], dtype=bool)
    data = np.where(letter, distinct, 32)[code].astype(np.uint64)
    is_letter = letter[code]
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])  # one space for a run of others
    data, text, is_letter = data[keep], text[keep], is_letter[keep]
    out = np.zeros(len(whole) * BUCKETS, np.float32)
    for size in GRAMS:
        hashed = data
        for k in range(1, size):
            hashed = hashed[: len(data) - k] * np.uint64(0x9E3779B97F4A7C15) + data[k:]
        n = len(hashed)
        inside = (text[:n] == text[size - 1 :]) & (is_letter[:n] | is_letter[size - 1 :])
        bucket = (W.mix(hashed[inside] + np.uint64(size << 40)) % np.uint64(BUCKETS)).astype(np.int64)
        out += np.bincount(text[:n][inside] * BUCKETS + bucket, minlength=len(out)).astype(np.float32)
    return out.reshape(len(whole), BUCKETS), np.bincount(text[is_letter], minlength=len(whole)) > 0


def weighted(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Vectors of length one, with logarithmic counts."""
    v = np.log1p(n) * idf
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)


def clustered(vectors: np.ndarray, k: int, rounds: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Centroids by cosine k-means, and the cosine that all but few members of each reach."""
    dice = np.random.default_rng(seed)
    centre = vectors[dice.permutation(len(vectors))[: min(k, len(vectors))]]
    for _ in range(rounds):
        nearest = (vectors @ centre.T).argmax(axis=1)
        sums = np.stack([vectors[nearest == c].sum(axis=0) if (nearest == c).any() else centre[c] for c in range(len(centre))])
        centre = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    cosine = vectors @ centre.T
    nearest = cosine.argmax(axis=1)
    bound = [np.quantile(cosine[nearest == c, c], 1 - WITHIN) if (nearest == c).any() else 1.0 for c in range(len(centre))]
    return centre.astype(np.float32), np.array(bound)


@dataclass
class Centroids:
    """A row for each centroid."""

    langs: list[str]
    centres: np.ndarray
    bounds: np.ndarray
    idf: np.ndarray


def counted(rows: DataFrame) -> DataFrame:
    """(lang, lot, buckets, ns): the n-gram counts of rows (lang, lot, text) whose text has a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                for some in W.slices(batch.slice(at, 200)):
                    n, has = counts(some.column("text"))
                    rows = np.flatnonzero(has)
                    row, bucket = np.nonzero(n[rows])
                    ends = pa.array(np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (bucket.astype(np.int32), n[rows][row, bucket])]
                    yield pa.RecordBatch.from_arrays([*(some.column(c).take(pa.array(rows)) for c in ("lang", "lot")), *lists], names=["lang", "lot", "buckets", "ns"])

    return rows.select("lang", "lot", "text").mapInArrow(run, "lang string, lot long, buckets array<int>, ns array<float>")


def trained(docs: DataFrame, usable: Column, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Centroids:
    """Centroids of every language among the rows for which ``usable`` holds, at most ``sample`` documents of each.

    Rows are chosen where they lie, by their hash, so a language with most rows is no hot key.
    """
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("lot"))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("lot", 0.02).alias("n")).toLocalIterator()}
    # lots are spread evenly over 64 bits: this bound leaves about twice the sample of each language
    share = F.create_map(*[x for lang in sorted(n) for x in (F.lit(lang), F.lit(min(1.0, 2.0 * sample / max(n[lang], 1))))]) if n else F.create_map(F.lit(""), F.lit(1.0))
    lot_share = (F.col("lot") / F.lit(2.0**64)) + 0.5
    # texts are counted where they lie, so that what is gathered of one is BUCKETS counts at most, however long it is
    chosen = counted(rows.where(lot_share <= share[F.col("lang")])).dropDuplicates(["lang", "lot"])  # copies of a row count once

    def vectors(pdf: pd.DataFrame) -> np.ndarray:
        pdf = pdf.sort_values("lot").head(sample)
        out = np.zeros((len(pdf), BUCKETS), np.float32)
        for row, (at, n) in enumerate(zip(pdf["buckets"], pdf["ns"], strict=True)):
            out[row, np.asarray(at, dtype=np.int64)] = n
        return out

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        n = vectors(pdf)
        return pd.DataFrame({"n": [len(n)], "seen": [(n > 0).sum(axis=0).astype(np.int64).tolist()]})

    total, seen = 0, np.zeros(BUCKETS)
    for row in chosen.groupBy("lang").applyInPandas(frequencies, "n long, seen array<long>").toLocalIterator():
        total, seen = total + row["n"], seen + np.array(row["seen"])
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def centres(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = vectors(pdf)
        if not len(n):
            return pd.DataFrame({"lang": [], "bound": [], "centre": []})
        centre, bound = clustered(weighted(n, idf), centroids, ROUNDS)
        return pd.DataFrame({"lang": [key[0]] * len(centre), "bound": bound, "centre": [c.tolist() for c in centre]})

    found = sorted(chosen.groupBy("lang").applyInPandas(centres, "lang string, bound double, centre array<float>").toLocalIterator(), key=lambda r: (r["lang"], r["centre"]))
    matrix = np.array([r["centre"] for r in found], np.float32).reshape(len(found), BUCKETS)
    return Centroids([r["lang"] for r in found], matrix, np.array([r["bound"] for r in found]), idf)


def predicted(docs: DataFrame, model: Centroids) -> DataFrame:
    """doc_id, lang_pred, score (the cosine) and rejected of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                n, has = counts(some.column("text"))
                if len(model.langs):
                    cosine = weighted(n, model.idf) @ model.centres.T
                    nearest = cosine.argmax(axis=1)
                    score = np.clip(cosine[np.arange(len(n)), nearest], 0, 1).astype(np.float64)
                    far = score < model.bounds[nearest]
                else:
                    nearest, score, far = np.full(len(n), -1), np.zeros(len(n)), np.ones(len(n), bool)
                nearest, score, far = np.where(has, nearest, -1), np.where(has, score, 0.0), far | ~has
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(names[nearest], pa.string()), pa.array(score), pa.array(far)], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    """The fold that no language is learned from: crc32 of doc_id as text, 1 more than a multiple of 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of ``docs``.

    Learned from text and lang of the rows outside the held-out fold, at most ``sample`` of each language, of any length;
    only text enters a prediction. lang_pred is always a learned language unless the text is null or has no letter (then "und", score 0); rejected
    marks texts that are too far from every centroid, and those. Rows without a lang or a doc_id are predicted but not learned from.
    Without any training row all is "und". Repeated rows are predicted alike; an empty table gives an empty one; other columns are
    not read. Texts are taken whole.
    """
    model = trained(docs.select("doc_id", "text", "lang"), ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull(), sample)
    found = predicted(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
