"""Removal of repeated word passages by recompression.

Each text is rewritten in rounds. A round first names runs of equal symbols, then splits the alphabet in two halves by the
symbols' names and names each pair of a left symbol and a right one. Names are hashes of what they stand for, so they are global
without a table, and equal substrings get equal symbols but near their borders. Each symbol carries its context: the span of
words that fixes it. A symbol whose context lies inside a window is found in every equal window, at the same place.

Each window of the text is keyed by one such symbol, chosen by content alone, and neighbouring windows mostly choose the same
one. Spark compares the chosen symbols of all documents: a symbol that occurs once ends the matter for its windows. Where a
symbol's whole stretch of windows occurs earlier, all of them are repeats. Only the windows of what remains are compared one by
one, by 128-bit names. Occurrences that a task has seen before are settled there, so that a passage in many documents sends one
row from each slice of them, and a symbol that stands in many different surroundings at most CROWD rows: beyond that its stretches go
by their own names. So no key has more than CROWD of the several hundred thousand rows that a slice of text sends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.llm import words as W
from intervale.llm.skew import hot_keys, spread_join
from intervale.llm.store import written

#: Rounds of runs and pairs: two give symbols of about 1.8 words with contexts of about 8.
ROUNDS = 2

#: Stretches of a slice that may go by one symbol's key.
CROWD = 8

STRETCHES = "key long, name long, doc_id long, first int, last int, settled boolean, known boolean"


def _halves(names: np.ndarray, number: int) -> np.ndarray:
    return (W.mix(names ^ np.uint64(0x5851F42D4C957F2D * (2 * number + 1) % (1 << 64))) & np.uint64(1)).astype(bool)


def recompress(hashed: np.ndarray, ends: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one word of each symbol's context after ``rounds``, in order; word positions run through all texts.

    Contexts that depend on a text's border reach one word over it, so they lie inside no window.
    """
    n = len(hashed)
    text = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    names, low, high = hashed, np.arange(n), np.arange(1, n + 1)
    for number in range(rounds):
        for runs in (True, False):
            if not len(names):
                break
            meets = text[:-1] == text[1:]
            before = np.concatenate([[False], meets])
            after = np.concatenate([meets, [False]])
            low_before = np.where(before, np.concatenate([low[:1], low[:-1]]), ends[text] - 1)
            high_after = np.where(after, np.concatenate([high[1:], high[-1:]]), ends[text + 1] + 1)
            if runs:
                stays = np.concatenate([[False], meets & (names[:-1] == names[1:])])
                first = np.flatnonzero(~stays)
                last = np.concatenate([first[1:], [len(names)]]) - 1
                length = (last - first + 1).astype(np.uint64)
                names = np.where(length > 1, W.joined(names[first], length), names[first])
                low, high, text = low_before[first], high_after[last], text[first]
            else:
                left = _halves(names, number)
                merges = np.concatenate([left[:-1] & ~left[1:] & meets, [False]])
                first = np.flatnonzero(~np.concatenate([[False], merges[:-1]]))
                pair, is_left = merges[first], left[first]
                second = np.minimum(first + 1, len(names) - 1)
                named = np.where(pair, W.joined(names[first], names[second]), names[first])
                low = np.where(pair | is_left, low[first], low_before[first])
                high = np.where(pair, high[second], np.where(is_left, high_after[first], high[first]))
                names, text = named, text[first]
    return low, high


class Spans:
    """Names of word spans, from hashes of all stretches whose lengths are powers of two."""

    def __init__(self, hashed: np.ndarray, longest: int) -> None:
        self.levels = [hashed]
        while 2 ** len(self.levels) <= longest:
            half = 2 ** (len(self.levels) - 1)
            below = self.levels[-1]
            self.levels.append(W.joined(below[:-half], below[half:]) if len(below) > half else below[:0])

    def names(self, first: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        length = end - first
        out = np.zeros(len(first), np.uint64)
        for k, level in enumerate(self.levels):
            mine = (length >= 2**k) & ((length < 2 ** (k + 1)) | (k == len(self.levels) - 1))
            a, b = first[mine], end[mine]
            out[mine] = W.joined(W.joined(level[a], level[b - 2**k]), length[mine].astype(np.uint64) + np.uint64(seed << 32))
        return out


def stretches(hashed: np.ndarray, ends: np.ndarray, window: int, rounds: int) -> tuple[np.ndarray, ...]:
    """(key, name, first window, last window) of each chosen symbol: all windows lie in one stretch each.

    key names the chosen symbol by its context and name the whole stretch of words; positions run through all texts.
    """
    none = np.zeros(0, np.int64)
    start = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(ends[:-1], ends[1:], strict=True) if b - a >= window] or [none])
    if not len(start):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    spans = Spans(hashed, 2 * window)
    low, high = recompress(hashed, ends, rounds)
    inside = high - low <= window
    low, high = low[inside], high[inside]
    inner = (low >= 0) & (high <= len(hashed))
    key = np.zeros(len(low), np.uint64)
    key[inner] = spans.names(low[inner], high[inner], 1)
    rank = W.mix(key)
    rank[~inner] = np.uint64(0xFFFFFFFFFFFFFFFF)
    first, last = np.searchsorted(low, start), np.searchsorted(high, start + window, side="right") - 1
    width = last - first + 1
    chosen = np.full(len(start), -1)
    best, step = np.arange(len(low)), 1
    while (width > 0).any() and step <= width.max():
        mine = (width >= step) & (width < 2 * step)
        a, b = best[first[mine]], best[last[mine] - step + 1]
        chosen[mine] = np.where(rank[b] < rank[a], b, a)
        if len(best) > step:
            a, b = best[:-step], best[step:]
            best = np.where(rank[b] < rank[a], b, a)
        step *= 2
    # windows without a symbol of their own stand for themselves
    mark = np.where(chosen >= 0, chosen, -1 - start)
    text = np.searchsorted(ends, start, side="right")
    opens = np.concatenate([[True], (mark[1:] != mark[:-1]) | (text[1:] != text[:-1])])
    at = np.flatnonzero(opens)
    begin, end = start[at], start[np.concatenate([at[1:], [len(start)]]) - 1]
    mark = mark[at]
    keys = np.where(mark >= 0, key[np.maximum(mark, 0)] if len(key) else np.uint64(0), spans.names(begin, begin + window, 2))
    return keys, spans.names(begin, end + window, 3), begin, end


def _earliest(columns: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows are the earliest of those with equal ``columns``; a repeated row is the same place again."""
    order = np.lexsort((at, doc, *columns))
    if not len(order):
        return np.zeros(0, bool)
    same = np.ones(len(order) - 1, bool)
    for c in columns:
        same &= c[order][1:] == c[order][:-1]
    opens = np.concatenate([[True], ~same])
    head = order[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    out = np.empty(len(order), bool)
    out[order] = (doc[order] == doc[head]) & (at[order] == at[head])
    return out


def _hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes, ends, distinct = W.split(texts)
    return (W.hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)), ends


def _crowded(key: np.ndarray, name: np.ndarray, settled: np.ndarray, crowd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, known, markers): stretches of keys that more than ``crowd`` of a slice share get keys by their names.

    Such a stretch is ``known`` to share its symbol. A marker of each such key tells the other slices.
    """
    distinct, which, n = np.unique(key[~settled], return_inverse=True, return_counts=True)
    known = np.zeros(len(key), bool)
    known[~settled] = n[which] > crowd
    return np.where(known, W.joined(key, name), key), known, distinct[n > crowd]


def chosen_symbols(docs: DataFrame, window: int, rounds: int, crowd: int = CROWD) -> DataFrame:
    """The stretches of all documents. Those with an earlier equal one in the same slice of the input are ``settled``.

    Those of a crowded symbol are ``known`` to share it; rows without a doc_id are the markers of such symbols.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in STRETCHES.split(", ")]
        for batch in batches:
            for some in W.slices(batch):
                some = some.filter(pc.is_valid(some.column("doc_id")))
                hashed, ends = _hashed(some.column("text"))
                key, name, first, last = stretches(hashed, ends, window, rounds)
                row = np.searchsorted(ends, first, side="right") - 1
                doc = np.asarray(some.column("doc_id").cast(pa.int64()))[row]
                first, last = first - ends[row], last - ends[row]
                # a settled row needs no company: its own place keeps it off the others' keys
                settled = ~_earliest([key, name], doc, first)
                key = np.where(settled, W.mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + first.astype(np.uint64)), key)
                key, known, markers = _crowded(key, name, settled, crowd)
                rows = [W.signed(key), W.signed(name), pa.array(doc), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(settled), pa.array(known)]
                yield pa.RecordBatch.from_arrays(rows, names=names)
                if len(markers):
                    m = len(markers)
                    yield pa.RecordBatch.from_arrays([W.signed(markers), W.signed(W.mix(markers)), pa.nulls(m, pa.int64()), *[pa.nulls(m, pa.int32())] * 2, *[pa.array(np.zeros(m, bool))] * 2], names=names)

    return docs.select("doc_id", "text").mapInArrow(choose, STRETCHES)


def shared_symbols(symbols: DataFrame) -> DataFrame:
    """(doc_id, first, last, settled) of stretches that may hold repeats; settled: all windows are repeats.

    A row is dropped only if its key occurs nowhere else. One exchange and one sort serve both windows. A stretch that has an equal one
    under another key (crowded in one slice, not in the other) stays open, and its windows are compared.
    """
    by_key = Window.partitionBy("key").orderBy("name", "doc_id", "first")
    by_name = Window.partitionBy("key", "name").orderBy("doc_id", "first")
    seen = symbols.select("*", F.lag("key").over(by_key).isNotNull().alias("follows"), F.lead("key").over(by_key).isNotNull().alias("leads"), F.rank().over(by_name).alias("turn"))
    return seen.where("doc_id IS NOT NULL AND (settled OR known OR follows OR leads)").select("doc_id", "first", "last", (F.col("settled") | (F.col("turn") > 1)).alias("settled"))


def open_windows(texts: DataFrame, window: int) -> DataFrame:
    """128-bit names of the windows of texts' unsettled stretches; ``settled``: an equal one is earlier in the same slice."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("open")), pc.greater(pc.list_value_length(batch.column("open")), 0)))
            for some in W.slices(batch):
                hashed, ends = _hashed(some.column("text"))
                spans = some.column("open")
                row = np.repeat(np.arange(some.num_rows), np.asarray(pc.list_value_length(spans)))
                flat = spans.flatten()
                first, last = (np.asarray(flat.field(i), dtype=np.int64) for i in (0, 1))
                n = last - first + 1
                row = np.repeat(row, n)
                at = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                fits = ends[row] + at + window <= ends[row + 1]
                row, at = row[fits], at[fits]
                place = ends[row] + at
                a, b = W.windows(hashed, window)[place], W.windows(hashed ^ np.uint64(0xD6E8FEB86659FD93), window)[place]
                doc = np.asarray(some.column("doc_id"))[row]
                settled = ~_earliest([a, b], doc, at)
                a = np.where(settled, W.mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)), a)
                yield pa.RecordBatch.from_arrays([W.signed(a), W.signed(b), pa.array(doc), pa.array(at.astype(np.int32)), pa.array(settled)], names=["a", "b", "doc_id", "first", "settled"])

    return texts.mapInArrow(name, "a long, b long, doc_id long, first int, settled boolean")


def repeated_windows(named: DataFrame) -> DataFrame:
    """(doc_id, first, last): windows with an earlier equal one."""
    turn = F.rank().over(Window.partitionBy("a", "b").orderBy("doc_id", "first"))
    return named.withColumn("turn", turn).where("settled OR turn > 1").select("doc_id", "first", F.col("first").alias("last"))


def without(texts: DataFrame, window: int, digest: bool) -> DataFrame:
    """Texts without the words of their ``gone`` windows: (doc_id, n_words, n_removed, kept_text or its SHA-256)."""
    column = "kept_sha256" if digest else "kept_text"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in W.slices(batch):
                n_words, n_removed, kept = [], [], []
                for text, gone in zip(some.column("text").to_pylist(), some.column("gone"), strict=True):
                    found = (text or "").encode().split()
                    n = len(found)
                    if gone.is_valid and len(gone):
                        flat = gone.values
                        edges = np.zeros(n + 1, np.int64)
                        np.add.at(edges, np.minimum(np.asarray(flat.field(0)), n), 1)
                        np.add.at(edges, np.minimum(np.asarray(flat.field(1), dtype=np.int64) + window, n), -1)
                        stay = np.cumsum(edges[:n]) == 0
                        found = [w for w, s in zip(found, stay.tolist(), strict=True) if s]
                    whole = b" ".join(found)
                    n_words.append(n)
                    n_removed.append(n - len(found))
                    kept.append(hashlib.sha256(whole).hexdigest() if digest else whole.decode())
                yield pa.RecordBatch.from_arrays([some.column("of"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", column])

    return texts.mapInArrow(cut, f"doc_id long, n_words long, n_removed long, {column} string")


def own_ids(texts: DataFrame) -> DataFrame:
    """``texts`` (doc_id, text) with ``of``, the doc_id that was given; doc_id itself becomes another one for a further text under it.

    The others come after all given ids below 2 ** 62. Without such texts nothing is joined.
    """
    lot = F.xxhash64(F.coalesce("text", F.lit("")))
    named = texts.withColumn("of", F.col("doc_id"))
    lots = texts.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(lot).alias("least"), F.max(lot).alias("most"), F.count(F.lit(1)).alias("n"))
    shared = written(lots.where("least < most"), "shared-ids")
    if shared.isEmpty():
        return named
    found = spread_join(named.withColumn("lot", lot), shared.select("doc_id", "least"), ["doc_id"], hot_keys(shared, ["doc_id"]), ["lot"], "left")
    other = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("doc_id", "lot"), 2)
    return found.select(F.when(F.col("lot") != F.col("least"), other).otherwise(F.col("doc_id")).alias("doc_id"), "text", "of")


def remove_repeats(docs: DataFrame, window: int = 20, rounds: int = ROUNDS, digest: bool = False, crowd: int = CROWD) -> DataFrame:
    """Remove each word covered by a window of ``window`` words that also starts earlier.

    Earlier is a smaller doc_id, or an earlier place in the same document. Words lie between ASCII white space and stay as they
    are. Columns: doc_id, n_words, n_removed and kept_text (the kept words joined by one space; with ``digest`` its SHA-256).

    Null, empty and short texts lose nothing. A row with a null doc_id is left whole and takes no part. Rows that repeat a
    doc_id with the same text count as that document and get a row each. Of different texts under one doc_id, one (by a hash) is the
    document, and the others are documents of their own that come after all. An empty table gives an empty one; other columns are not read.
    """
    # a cast would keep Spark from seeing that both joins below deal the texts out alike, which it then does once
    texts = own_ids(docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long"), "text"))
    shared = written(shared_symbols(chosen_symbols(texts, window, rounds, crowd)), "shared")
    span = F.struct("first", "last")
    still_open = shared.where("NOT settled").groupBy("doc_id").agg(F.collect_set(span).alias("open"))
    repeats = repeated_windows(open_windows(texts.join(still_open, "doc_id", "left"), window))
    gone = shared.where("settled").select("doc_id", "first", "last").unionByName(repeats)
    return without(texts.join(gone.groupBy("doc_id").agg(F.collect_list(span).alias("gone")), "doc_id", "left"), window, digest)
