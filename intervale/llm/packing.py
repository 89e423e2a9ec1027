"""Packing of documents into fixed token sequences: concatenate and cut.

Pass one tokenises each document once, where its partition lies, and writes the ids with the partition's number and the tokens
before the document in it. Prefix sums over the partitions' totals (one row each) give every document its global offset. Pass
two cuts the written ids at multiples of the sequence length; each piece is a boundary record of its document. Every sequence
but the last is full, whatever the documents' lengths, so padding is below one sequence in all.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intervale.llm.store import written

#: Entries of the word cache of a task; it starts anew beyond that.
CACHE_WORDS = 300_000

TOKENS = "doc_id long, part int, before long, n_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def byte_level(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level vocabulary of a ranks file; its ids equal those of the JSON form, added tokens apart."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Token ids of whole texts as bytes, with the ids of space-separated pieces kept between documents.

    The vocabulary's own pattern never joins characters across a single space that precedes a non-space character, so such
    pieces can be encoded alone. Texts with other spacing are encoded whole. A text is split at the ``added`` tokens first: each
    has one id, and what lies between is encoded alone.
    """

    def __init__(self, ranks_path: str, pattern: str, width: type = np.uint32, added: dict[str, int] | None = None) -> None:
        self.encoding, self.width, self.cache = byte_level(ranks_path, pattern), width, {}
        self.added = {token: width(number).tobytes() for token, number in (added or {}).items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ids(self, text: str) -> bytes:
        if self.at_added is None or not any(token in text for token in self.added):
            return self.plain_ids(text)
        return b"".join(self.added.get(part) or self.plain_ids(part) for part in self.at_added.split(text) if part)

    def plain_ids(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and (not first or any(not piece or piece[0].isspace() for piece in rest)):
            return np.asarray(self.encoding.encode_ordinary(text), dtype=self.width).tobytes()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, encode = self.cache, self.encoding.encode_ordinary
        out = [np.asarray(encode(first), dtype=self.width).tobytes()]
        for piece in rest:
            known = cache.get(piece)
            if known is None:
                known = cache[piece] = np.asarray(encode(" " + piece), dtype=self.width).tobytes()
            out.append(known)
        return b"".join(out)


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, vocabulary: int, end_id: int, added: dict[str, int] | None = None) -> DataFrame:
    """One row per document: its ids (with ``end_id``) as little-endian integers, its partition and the tokens before it there."""
    width = np.uint16 if max(vocabulary, end_id + 1) <= 1 << 16 else np.uint32

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, before = Encoder(ranks_path, pattern, width, added), width(end_id).tobytes(), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                ids = [encoder.ids(text or "") + end for text in some.column("text").to_pylist()]
                counts = np.array([len(x) // width().itemsize for x in ids], dtype=np.int64)
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts), pa.array(counts), pa.array(ids, pa.binary())], names=["doc_id", "part", "before", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, TOKENS)


def concatenate_and_cut(tokens: DataFrame, sequence: int, wide: bool) -> DataFrame:
    """Boundary records of ``tokens`` (a written table of ``tokenised``) cut into sequences of ``sequence`` ids."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per input partition: a few million at most, whatever the input
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    width = np.dtype("<u4" if wide else "<u2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "begin", "n_tokens")]
            for doc_id, begin, n, ids in zip(*columns, batch.column("ids"), strict=True):
                values = np.frombuffer(ids.as_buffer(), width)
                start = 0
                while start < n:
                    at = begin + start
                    length = min(n - start, sequence - at % sequence)
                    crc = zlib.crc32(values[start : start + length].astype("<u4").tobytes())
                    for column, value in zip(rows, (doc_id, start, length, crc, n, at // sequence, at % sequence), strict=True):
                        column.append(value)
                    start += length
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=[c.split()[0] for c in PIECES.split(", ")])

    placed = tokens.join(F.broadcast(base), "part")
    return placed.select("doc_id", (F.col("base") + F.col("before")).alias("begin"), "n_tokens", "ids").mapInArrow(cut, PIECES)


def pack(docs: DataFrame, ranks_path: str, pattern: str, vocabulary: int, end_id: int = 1, sequence: int = 2048, added: dict[str, int] | None = None) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text, more) into sequences of at most ``sequence`` tokens.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32 (of the ids as little-endian 32-bit
    integers), doc_tokens (with the end id), sequence_id, offset (in the sequence, gapless from 0).

    ``added`` are the vocabulary's added tokens with their ids, below ``vocabulary``; the ids are then those of the tokenizer's
    JSON form with its default settings. Without ``added`` their text is spelled out (encode_special_tokens).

    A null or empty text is its end id alone. Repeated rows are packed each on their own; a null doc_id stays null. An empty
    table gives no pieces. Very long texts become many pieces. Documents follow each other in the order of the input's
    partitions. Only the last sequence can be short: it is padded to ``sequence`` when used, unless its length is a power of two.
    """
    tokens = written(tokenised(docs, ranks_path, pattern, vocabulary, end_id, added), "tokens", compression="zstd")
    return concatenate_and_cut(tokens, sequence, max(vocabulary, end_id + 1) > 1 << 16)
