"""Quality rules on tokeniser fertility: characters per token, byte-fallback share and token entropy.

Two public vocabularies measure each text: a piece vocabulary with byte fallback, and a byte-level one made for many languages. A
text is rejected when a measure leaves its band. Fixed bands hold per script. Finer bands come from the corpus: the quartiles of
each measure over all texts of one language and length class (entropy grows with length) give the middle and the spread. They are
exact, from counts of the measures in hundredths, so no verdict depends on how the rows are dealt. A group's band weighs as much
as its texts against the script's band, so a small group's band goes over into the script's without a step.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.llm import words as W
from intervale.llm.packing import byte_level
from intervale.llm.skew import hot_keys, spread_join
from intervale.llm.store import written

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: Accepted (lowest, highest) characters per token of the two vocabularies, highest byte-fallback share, lowest token entropy in
#: bits, by script.
BANDS = {
    "latin": {"chars_per_token": (1.35, 7.0), "chars_per_multi_token": (1.2, 9.0), "byte_share": 0.05, "entropy": 4.0},
    "cyrillic": {"chars_per_token": (1.0, 7.0), "chars_per_multi_token": (0.9, 9.0), "byte_share": 0.05, "entropy": 4.0},
    "cjk": {"chars_per_token": (0.4, 4.0), "chars_per_multi_token": (0.3, 4.0), "byte_share": 0.6, "entropy": 4.0},
    "other": {"chars_per_token": (0.3, 7.0), "chars_per_multi_token": (0.3, 9.0), "byte_share": 0.6, "entropy": 3.5},
}
SCRIPTS = list(BANDS)

#: Spreads that a text may lie below its group's middle, and texts of a group that weigh as much as the script's band.
SPREADS, GROUP = 4.0, 30
#: Measures with bands of their own in each group, in parts of the unit that they are counted in.
GROUPED, PARTS = ("chars_per_token", "chars_per_multi_token", "entropy"), 100
#: Groups that are sent to all executors; more of them are joined by a shuffle.
BROADCAST_GROUPS = 100_000

#: Words whose pieces a task keeps; it starts anew beyond that.
CACHE_WORDS = 400_000

MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, script string, n_tokens long, chars_per_token double, n_multi_tokens long, chars_per_multi_token double, byte_share double, entropy double, kept boolean"


@lru_cache(maxsize=2)
def pieces(model_path: str) -> tuple[sentencepiece.SentencePieceProcessor, np.ndarray]:
    """The vocabulary, and which of its ids are byte-fallback pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return model, np.array([model.is_byte(i) for i in range(model.vocab_size())])


class WordPieces:
    """Piece ids of words; the vocabulary never joins characters across spaces, so words are encoded alone and kept."""

    def __init__(self, model_path: str) -> None:
        self.model, self.is_byte = pieces(model_path)
        self.cache: dict[str, np.ndarray] = {}

    def of(self, distinct: list[str]) -> list[np.ndarray]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in distinct if w not in self.cache]
        for word, ids in zip(new, self.model.encode(new, num_threads=1) if new else [], strict=True):
            self.cache[word] = np.asarray(ids, dtype=np.int32)
        return [self.cache[w] for w in distinct]


class TokenCounts:
    """Tokens of words in a byte-level vocabulary, each with the space before it, which the vocabulary's pattern never joins to more."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        self.encoding, self.cache = byte_level(ranks_path, pattern), {}

    def of(self, distinct: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, encode = self.cache, self.encoding.encode_ordinary
        for word in distinct:
            if word not in cache:
                cache[word] = len(encode(" " + word))
        return np.array([cache[w] for w in distinct], dtype=np.int64)


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 ... for count[0] entries, then the next."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())


def scripts_of(text: np.ndarray, chars: np.ndarray, n: int) -> np.ndarray:
    """The script of most characters beyond ASCII punctuation, as an index of SCRIPTS; Latin where there is none."""
    latin = ((chars >= 65) & (chars <= 122) & ((chars <= 90) | (chars >= 97))) | ((chars >= 0xC0) & (chars < 0x250))
    cyrillic = (chars >= 0x400) & (chars < 0x530)
    cjk = (chars >= 0x2E80) & (chars < 0xFB00)
    other = (chars >= 0x250) & ~cyrillic & ~cjk
    counts = np.stack([np.bincount(text[mask], minlength=n) for mask in (latin, cyrillic, cjk, other)])
    return counts.argmax(axis=0)


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.encode().split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            n += line in seen
            seen.add(line)
    return n


def repeated_words(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more in it."""
    n_texts, n = len(ends) - 1, len(codes)
    out = np.zeros(n_texts, np.int64)
    if n < 3:
        return out
    text = np.repeat(np.arange(n_texts), np.diff(ends))
    start = np.flatnonzero(text[2:] == text[:-2])
    named = codes.astype(np.uint64)
    window = W.windows(W.mix(named + np.uint64(1)), 3)[start]
    order = np.lexsort((window, text[start]))
    a, b = window[order], text[start][order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[start[order[twice]] + k] = True
    return np.bincount(text[hit], minlength=n_texts)


def entropies(text: np.ndarray, token: np.ndarray, n: int, size: int) -> np.ndarray:
    """Entropy in bits of each text's tokens."""
    pair, count = np.unique(text * size + token, return_counts=True)
    owner = pair // size
    total = np.bincount(owner, weights=count, minlength=n)
    plogp = np.bincount(owner, weights=count * np.log2(count), minlength=n)
    return np.where(total > 0, np.log2(np.maximum(total, 1)) - plogp / np.maximum(total, 1), 0.0)


def measured(texts: pa.Array, vocabulary: WordPieces, multi: TokenCounts, bands: dict) -> list[np.ndarray]:
    """The columns of MEASURED after lang."""
    n = len(texts)
    codes, ends, distinct = W.split(texts)
    text = np.repeat(np.arange(n), np.diff(ends))
    n_words = np.diff(ends)
    length = np.asarray(pc.utf8_length(distinct), dtype=np.int64)
    word_chars = np.bincount(text, weights=length[codes], minlength=n).astype(np.int64)
    filled = pc.fill_null(texts, "")
    data = np.frombuffer("".join(filled.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.asarray(pc.utf8_length(filled), dtype=np.int64)
    owner = np.repeat(np.arange(n), sizes)
    n_symbols = np.bincount(owner[np.isin(data, [ord(c) for c in SYMBOLS])], minlength=n)
    script = scripts_of(owner, data, n)
    dup_lines = np.array([duplicate_lines(t) for t in filled.to_pylist()], dtype=np.int64)
    repeats = repeated_words(codes, ends)
    failed = (n_words < 50) | (100 * repeats > 50 * n_words)

    words = distinct.to_pylist()
    ids = vocabulary.of(words)
    n_multi = np.bincount(text, weights=multi.of(words)[codes] if len(codes) else None, minlength=n).astype(np.int64)
    per_multi = word_chars / np.maximum(n_multi, 1)
    count = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    first = np.cumsum(count) - count
    token = flat[ranges(first[codes], count[codes])] if len(codes) else flat
    token_text = np.repeat(text, count[codes])
    n_tokens = np.bincount(token_text, minlength=n)
    safe = np.maximum(n_tokens, 1)
    per_token = word_chars / safe
    byte_share = np.bincount(token_text[vocabulary.is_byte[token]], minlength=n) / safe
    entropy = entropies(token_text, token.astype(np.int64), n, len(vocabulary.is_byte))
    kept = ~failed
    for name, value in (("chars_per_token", per_token), ("chars_per_multi_token", per_multi)):
        low, high = (np.array([bands[s][name][i] for s in SCRIPTS])[script] for i in (0, 1))
        kept &= (value >= low) & (value <= high)
    most, least = (np.array([bands[s][k] for s in SCRIPTS])[script] for k in ("byte_share", "entropy"))
    kept &= (byte_share <= most) & (entropy >= least)
    return [n_words, word_chars, n_symbols, dup_lines, repeats, failed, np.array(SCRIPTS)[script], n_tokens, per_token, n_multi, per_multi, byte_share, entropy, kept]


def measures(docs: DataFrame, model_path: str, multi: tuple[str, str], bands: dict) -> DataFrame:
    """The base counts and the measures of every row, and its verdict by the bands of its script."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts = WordPieces(model_path), TokenCounts(*multi)
        names = [c.split()[0] for c in MEASURED.split(", ")]
        for batch in batches:
            for some in W.slices(batch, most=4 << 20):
                columns = [pa.array(c) for c in measured(some.column("text"), vocabulary, counts, bands)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), some.column("lang"), *columns], names=names)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", lang.alias("lang"), "text").mapInArrow(rate, MEASURED)


def exact_quartiles(found: DataFrame) -> DataFrame:
    """(tongue, class, n, and the three quartiles of each grouped measure, as arrays of hundredths) of the texts that do not fail.

    Texts are counted by value first; a group has a bounded number of values, whatever its rows.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * PARTS).cast("long").alias("value")) for m in GROUPED]))
    cells = found.where("NOT base_failed").select("tongue", "class", each.alias("x")).groupBy("tongue", "class", "x.measure", "x.value").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("tongue", "class", "measure")
    placed = cells.select("*", F.sum("c").over(group.orderBy("value")).alias("upto"), F.sum("c").over(group).alias("n"))
    quartile = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("n"), F.col("value")))
    by_measure = placed.groupBy("tongue", "class", "measure").agg(F.first("n").alias("n"), F.array(*[quartile(k) for k in (1, 2, 3)]).alias("q"))
    return by_measure.groupBy("tongue", "class").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("measure") == m, F.col("q"))).alias(f"q_{m}") for m in GROUPED])


def fertility_rules(docs: DataFrame, model_path: str, multi: tuple[str, str], bands: dict | None = None) -> DataFrame:
    """Base counts and the verdict on tokeniser fertility of every row of ``docs``.

    ``model_path`` is the piece vocabulary, ``multi`` the ranks and the pattern of the byte-level one.

    Columns: doc_id, n_words (between ASCII white space), word_chars, n_symbols, n_dup_lines (lines with a word that equal an
    earlier line), n_repeat_words (words in three-word windows that the text has twice or more), base_failed (fewer than 50
    words, or over half of them repeated), script, n_tokens, chars_per_token, n_multi_tokens, chars_per_multi_token, byte_share
    (tokens that stand for a single byte the piece vocabulary has no piece for), entropy (bits of a text's token distribution) and
    kept: not base_failed, all measures inside the script's bands, and no characters per token and no entropy below the group's
    band. That is SPREADS below the middle of the texts of the same language and length class, weighed by their number against
    GROUP times the script's lowest value. The language is the column lang; without it, or where it is null, the script stands for it.

    Null and empty texts have zeros everywhere and fail. Repeated rows and rows without a doc_id are measured as any other. An
    empty table gives an empty one; columns other than doc_id, text and lang are not read. Very long texts are taken whole.
    """
    bands = bands or BANDS
    found = written(measures(docs, model_path, multi, bands), "fertility")
    found = found.withColumns({"tongue": F.coalesce("lang", "script"), "class": F.floor(2 * F.log2(F.greatest("n_words", F.lit(1)))).cast("int")})
    groups = written(exact_quartiles(found), "groups")
    if groups.count() <= BROADCAST_GROUPS:
        placed = found.join(F.broadcast(groups), ["tongue", "class"], "left")
    else:
        placed = spread_join(found, groups, ["tongue", "class"], hot_keys(groups, ["tongue", "class"]), ["doc_id"], "left")
    inside = F.col("kept")
    for m in GROUPED:
        fixed = F.coalesce(*[F.when(F.col("script") == s, F.lit(float(bands[s][m] if m == "entropy" else bands[s][m][0]))) for s in SCRIPTS])
        q = F.col(f"q_{m}")
        own = (F.get(q, 1) - SPREADS * (F.get(q, 2) - F.get(q, 0)) / 1.349) / PARTS
        low = (F.col("n") * own + GROUP * fixed) / (F.col("n") + GROUP)
        inside = inside & (F.round(F.col(m), 9) >= F.round(F.coalesce(low, fixed), 9))
    names = [c.split()[0] for c in MEASURED.split(", ") if not c.startswith(("lang", "kept"))]
    return placed.select(*names, inside.alias("kept"))
