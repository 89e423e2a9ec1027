"""Benchmark decontamination over a positional inverted index of the training documents.

The index covers every token of the corpus and is built once. It is kept in segments: one row for the documents that lie next to
each other in a partition, with the sorted terms of the segment and the posting list (positions) of each term. Terms are 64-bit
hashes. No posting leaves its segment, so a term in every document makes no hot key, and a search needs no shuffle of postings.

A search takes each test phrase, orders its terms by their number of postings in the whole corpus, opens the list of the rarest one,
moves it back by the term's place in the phrase, and intersects it with the lists of the next rarer terms, moved likewise. What
survives all terms is an exact match; with a slop, terms may be off their place by so many positions, and a share of them may be
missing. Test items beyond BLOCK_BYTES are searched block after block in the same index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm import words as W
from intervale.llm.store import small_batches, written

#: Bytes of test items in one block, whose phrases the driver prepares and broadcasts: about 12 times as much.
BLOCK_BYTES = 4 << 20

#: Words of a segment at most (a single longer document is one of its own), and empty positions between its documents.
SEGMENT_WORDS, GAP = 200_000, 64

#: Candidates that are intersected at once: about 100 bytes each.
CANDIDATES = 1 << 17

#: Documents that are read at once, bytes that Python gets at once, and segments (of 1 to 3 MB) of a row group. So what a task holds
#: depends neither on the size of its part nor on how the input's files are cut.
READ_ROWS, SENT_BYTES, GROUP_ROWS = 256, 8 << 20, 8

SEGMENTS = "rows array<long>, doc_ids array<long>, n_words array<long>, terms array<long>, counts array<int>, gaps array<int>"
MATCHES = "row long, first array<int>, last array<int>, items array<string>"


def index(docs: DataFrame) -> DataFrame:
    """The segments of ``docs`` (doc_id, text): every row of it gets a number of its own, whatever its doc_id."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, names = TaskContext.get().partitionId() << 33, [c.split()[0] for c in SEGMENTS.split(", ")]
        for some in (part for batch in batches for part in W.slices(batch)):
            codes, ends, distinct = W.split(some.column("text"), W.WORDY)
            hashed, of_term = np.unique(W.hashes(distinct).view(np.int64) if len(distinct) else np.zeros(0, np.int64), return_inverse=True)
            term = of_term.astype(np.int32)[codes] if len(codes) else codes
            low = 0
            while low < some.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, ends[low] + SEGMENT_WORDS, side="right")) - 1)
                n_words, own = np.diff(ends[low : high + 1]), term[ends[low] : ends[high]]
                place = np.arange(len(own)) + GAP * np.repeat(np.arange(high - low), n_words)
                order = np.argsort(own, kind="stable")  # positions of a term stay in order
                place = place[order]
                used, opens, counts = np.unique(own[order], return_index=True, return_counts=True)
                gaps = np.diff(place, prepend=0)
                gaps[opens] = place[opens]
                columns = [np.arange(row, row + high - low), some.column("doc_id").slice(low, high - low).cast(pa.int64()), n_words, hashed[used], counts.astype(np.int32), gaps.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns], names=names)
                row, low = row + high - low, high

    return docs.select("doc_id", "text").mapInArrow(post, SEGMENTS)


@dataclass
class Phrases:
    """The distinct phrases of a block of items: codes into the sorted ``terms`` (padded with -1), lengths, and their items."""

    terms: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray
    items: list[str]
    owner_ends: np.ndarray
    owners: np.ndarray


def phrases_of(items: list[tuple[str, str]], size: int) -> Phrases:
    """All windows of ``size`` words of the items; an item with fewer words is one phrase."""
    codes, ends, distinct = W.split(pa.array([text for _, text in items], pa.string()), W.WORDY)
    terms, of_term = np.unique(W.hashes(distinct).view(np.int64) if len(distinct) else np.zeros(0, np.int64), return_inverse=True)
    words = np.concatenate([of_term[codes] if len(codes) else codes, np.full(size, -1)]).astype(np.int32)
    n = np.diff(ends)
    n_phrases = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), n_phrases)
    start = np.arange(n_phrases.sum()) - np.repeat(np.cumsum(n_phrases) - n_phrases, n_phrases) + ends[item]
    length = np.minimum(n[item], size)
    window = words[start[:, None] + np.arange(size)]
    window[np.arange(size) >= length[:, None]] = -1
    distinct_windows, of_window = np.unique(window, axis=0, return_inverse=True) if len(window) else (window, np.zeros(0, np.int64))
    names = sorted({name for name, _ in items})
    number = {name: i for i, name in enumerate(names)}
    pair = np.unique(np.stack([of_window.ravel(), np.array([number[name] for name, _ in items], dtype=np.int64)[item]], axis=1), axis=0)
    owner_ends = np.searchsorted(pair[:, 0], np.arange(len(distinct_windows) + 1))
    return Phrases(terms, distinct_windows, (distinct_windows >= 0).sum(axis=1), names, owner_ends, pair[:, 1])


@dataclass
class Postings:
    """The posting lists that a block's terms have in one segment, as one sorted array of code * span + position."""

    keys: np.ndarray
    span: int
    ends: np.ndarray

    def has(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which positions are in the list of their term."""
        key = code * self.span + at
        found = np.searchsorted(self.keys, key)
        return (at >= 0) & (at < self.span) & (self.keys[np.minimum(found, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(at), bool)


def opened(terms: np.ndarray, counts: np.ndarray, gaps: np.ndarray, span: int, wanted: np.ndarray) -> Postings:
    """The lists of the ``wanted`` terms (sorted hashes; their order is their code)."""
    code = np.searchsorted(wanted, terms)
    known = (code < len(wanted)) & (wanted[np.minimum(code, len(wanted) - 1)] == terms) if len(wanted) else np.zeros(len(terms), bool)
    first = np.cumsum(counts) - counts
    own, n = code[known], counts[known]
    flat = gaps[np.repeat(first[known] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64)
    run = np.cumsum(flat)
    begin = np.cumsum(n) - n
    at = run - np.repeat(run[begin] - flat[begin], n) if len(flat) else flat
    return Postings(np.repeat(own, n) * span + at, span, np.searchsorted(np.repeat(own, n), np.arange(len(wanted) + 1)))


def _lists(batch: pa.RecordBatch, names: list[str]) -> Iterator[list[np.ndarray]]:
    for row in range(batch.num_rows):
        yield [np.asarray(batch.column(c)[row].values) for c in names]


def posting_counts(segments: DataFrame, terms: np.ndarray) -> np.ndarray:
    """The length of each term's posting list in the whole corpus; each task sums its own segments first."""
    shared = segments.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = shared.value, np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, n in _lists(batch, ["terms", "counts"]):
                code = np.searchsorted(wanted, own)
                known = (code < len(wanted)) & (wanted[np.minimum(code, len(wanted) - 1)] == own) if len(wanted) else np.zeros(len(own), bool)
                np.add.at(total, code[known], n[known])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["code", "n"])

    out = np.zeros(len(terms), np.int64)
    for r in segments.select("terms", "counts").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["code"]] = r["n"]
    return out


def matches(postings: Postings, codes: np.ndarray, lengths: np.ndarray, by_rarity: np.ndarray, anchors: tuple, slop: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, start) of the matches in one segment, from the rarest term's list on, each list moved back by its term's place."""
    anchor_codes, anchor_ends, anchor_phrases = anchors
    opens = postings.ends[anchor_codes]
    n_lists, n_phrases = postings.ends[anchor_codes + 1] - opens, np.diff(anchor_ends)
    some = np.flatnonzero(n_lists > 0)
    work = np.append(0, np.cumsum((n_lists * n_phrases)[some]))
    for begin in range(0, int(work[-1]), CANDIDATES):
        # every phrase of an anchor with every posting of its list, numbered through all anchors
        number = np.arange(begin, min(begin + CANDIDATES, int(work[-1])))
        of = np.searchsorted(work, number, side="right") - 1
        a = some[of]
        of_anchor, posting = np.divmod(number - work[of], n_lists[a])
        phrase = anchor_phrases[anchor_ends[a] + of_anchor]
        place = postings.keys[opens[a] + posting] - anchor_codes[a] * postings.span
        start = place - by_rarity[phrase, 0]
        inside = start >= 0
        phrase, start = phrase[inside], start[inside]
        missed, spare = np.zeros(len(phrase), np.int64), np.floor((1 - share) * lengths + 1e-9).astype(np.int64)
        for k in range(1, codes.shape[1]):
            offset = by_rarity[phrase, k]
            code = codes[phrase, np.maximum(offset, 0)].astype(np.int64)
            found = offset < 0
            for shift in range(-slop, slop + 1):
                found |= postings.has(code, start + offset + shift)
            missed += ~found
            stay = missed <= spare[phrase]
            phrase, start, missed = phrase[stay], start[stay], missed[stay]
        yield phrase, start


def search(segments: DataFrame, phrases: Phrases, slop: int = 0, share: float = 1.0) -> DataFrame:
    """(row, first, last, items) of each row of the index with a match: the spans of words and the items they come from.

    ``slop`` 0 and ``share`` 1 give exact phrases. Otherwise a match has its rarest term, and at least ``share`` of all its terms
    within ``slop`` positions of their places. A phrase with a term that no document has is not looked for when all are needed.
    """
    if slop >= GAP - phrases.codes.shape[1]:
        raise ValueError(f"slop {slop} reaches over the {GAP} positions between documents")
    frequency = np.append(posting_counts(segments, phrases.terms), np.iinfo(np.int64).max)
    rarity = frequency[phrases.codes]  # the padding is commonest
    by_rarity = np.argsort(rarity, axis=1, kind="stable").astype(np.int64)
    by_rarity[np.sort(rarity, axis=1) == np.iinfo(np.int64).max] = -1
    rarest = phrases.codes[np.arange(len(phrases.codes)), by_rarity[:, 0]].astype(np.int64) if len(phrases.codes) else np.zeros(0, np.int64)
    alive = np.flatnonzero(rarity.min(axis=1, initial=np.iinfo(np.int64).max) > 0) if share >= 1 else np.arange(len(rarest))
    order = alive[np.argsort(rarest[alive], kind="stable")]
    anchor_codes, first = np.unique(rarest[order], return_index=True)
    shared = segments.sparkSession.sparkContext.broadcast((phrases, by_rarity.astype(np.int8), (anchor_codes, np.append(first, len(order)), order)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, by_rarity, anchors = shared.value
        names = np.array(phrases.items, dtype=object)
        for batch in batches:
            for rows, n_words, terms, counts, gaps in _lists(batch, ["rows", "n_words", "terms", "counts", "gaps"]):
                base = np.cumsum(n_words + GAP) - n_words - GAP
                postings = opened(terms, counts, gaps, int(n_words.sum() + GAP * len(rows)), phrases.terms)
                found = list(matches(postings, phrases.codes, phrases.lengths, by_rarity, anchors, slop, share)) if len(anchors[0]) else []
                phrase, start = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
                if not len(phrase):
                    continue
                owner = np.searchsorted(base, start, side="right") - 1
                first = start - base[owner]
                order = np.lexsort((phrases.lengths[phrase], first, owner))
                owner, first, phrase = owner[order], first[order], phrase[order]
                last = first + phrases.lengths[phrase] - 1
                hit, cuts = np.unique(owner, return_index=True)
                cuts = np.append(cuts, len(owner)).astype(np.int32)
                items = [names[np.unique(np.concatenate([phrases.owners[phrases.owner_ends[p] : phrases.owner_ends[p + 1]] for p in np.unique(phrase[a:b])]))].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                spans = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(rows[hit]), *spans, pa.array(items, pa.list_(pa.string()))], names=["row", "first", "last", "items"])

    return segments.select("rows", "n_words", "terms", "counts", "gaps").mapInArrow(match, MATCHES)


def block_count(items: DataFrame) -> int:
    """How many blocks of about BLOCK_BYTES the test items make."""
    named = items.where("item_id IS NOT NULL")
    return 1 + (named.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0) // BLOCK_BYTES


def item_blocks(items: DataFrame, n: int) -> Iterator[list[tuple[str, str]]]:
    """The test items as (id, text), in ``n`` blocks, read one after another: the driver holds one at a time."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text")).where("item IS NOT NULL")
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for b in range(n):
        yield [tuple(r) for r in (rows.where(block == b) if n > 1 else rows).orderBy("item", "text").toLocalIterator()]


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = 10, slop: int = 0, share: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, first, last (spans of matched words), items (ids as strings, sorted).

    Words are runs of letters, digits and characters beyond ASCII, with A-Z lower-cased. Phrases are all windows of ``size``
    consecutive words of an item, or the whole item if it is shorter. ``slop`` and ``share`` as in ``search``.

    Null and empty texts have no words, null and empty items no phrases; items without an id are not searched. Repeated items
    count once per id. A repeated document, or one without a doc_id, has its row as any other. An empty table of documents gives
    an empty result, an empty table of items one without spans. Extra columns are not read. Blocks of items are searched one after
    another in one index; a row's matches of all blocks are put together by the row's number.
    """
    found = None
    with small_batches(docs.sparkSession, READ_ROWS, SENT_BYTES):
        segments = written(index(docs), "segments", compression="zstd", **{"parquet.block.row.count.limit": str(GROUP_ROWS)})
    with small_batches(docs.sparkSession, 1, SENT_BYTES):  # a segment is a row
        for block in item_blocks(items, block_count(items)):
            hits = written(search(segments, phrases_of(block, size), slop, share), "matches")
            found = hits if found is None else found.unionByName(hits)
    flat = [F.flatten(F.collect_list(c)).alias(c) for c in ("first", "last")]
    hits = found.groupBy("row").agg(*flat, F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = segments.select(F.inline(F.arrays_zip("rows", "doc_ids", "n_words"))).toDF("row", "doc_id", "n_words")
    none = {c: F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("first", "array<int>"), ("last", "array<int>"), ("items", "array<string>"))}
    return rows.join(hits, "row", "left").select("doc_id", "n_words", *none.values())


def contamination(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document; cases as in ``phrase_matches``."""
    found = phrase_matches(docs, items, size)
    spans = F.array_sort(F.arrays_zip("first", "last"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("upto"))
    add = lambda s, x: F.struct((s["n"] + F.greatest(x["last"] - F.greatest(x["first"] - 1, s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["last"]).alias("upto"))
    n_hit = F.aggregate(spans, zero, add, lambda s: s["n"].cast("long"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("first") > 0).alias("contaminated"))
