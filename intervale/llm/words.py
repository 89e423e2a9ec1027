"""Vectorised words and hashes over Arrow string columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a task turns into words at once.
SLICE_BYTES = 4 << 20

KEEP = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all else as it is.
LOWER = KEEP.copy()
LOWER[65:91] += 32
#: For words of letters, digits and everything beyond ASCII: the rest becomes a space.
WORDY = LOWER.copy()
WORDY[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 32

_ODD = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batch`` with about ``most`` bytes of text each, one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            pa.default_memory_pool().release_unused()  # what the last piece took goes back before the next one
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """``texts`` with each byte replaced through ``table``; nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts])  # offsets from 0
    offsets, data = texts.buffers()[1:3]
    start = np.frombuffer(offsets, np.int64, count=texts.offset + len(texts) + 1)[texts.offset :]
    if data is None or not len(texts):
        return texts
    new = table[np.frombuffer(data, np.uint8)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(start.tobytes()), pa.py_buffer(new.tobytes())])


def split(texts: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space.

    Returns (code of each word, ends with one entry more than there are texts, distinct words): text ``i`` has the words
    ``codes[ends[i]:ends[i + 1]]``. Nulls have no words.
    """
    texts = mapped(texts, KEEP if table is None else table)
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.values
    cuts = np.asarray(lists.offsets, dtype=np.int64)
    full = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    coded = flat.filter(pa.array(full)).dictionary_encode() if len(flat) else flat.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), before[cuts], coded.dictionary


def hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each string."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode(), seed) for w in words.to_pylist()), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each output bit depends on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An order-dependent 64-bit hash of two hashes."""
    return mix(left * _ODD + ((right << np.uint64(31)) | (right >> np.uint64(33))) + np.uint64(0x632BE59BD9B4E019))


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` values (one entry for each start), by doubling."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, width, done, out = values, 1, 0, None
    while True:
        if size & width:
            part = power[done : done + n]
            out = mix(part + _ODD) if out is None else joined(out, part)
            done += width
        if done == size:
            return out
        power = joined(power[:-width], power[width:])
        width *= 2


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
