"""Filters and other kernels over long signals that are stored in chunks, with borders from the neighbouring chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrices_by_length(columns: list[pa.Array]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of equal length as (row numbers, a matrix for each column); rows with a null, a null sample or unequal lengths are left out."""
    lengths = np.stack([np.asarray(c.value_lengths().fill_null(-1), dtype=np.int64) for c in columns])
    flat = [np.asarray(c.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)) for c in columns]
    start = [np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0) for n in lengths]
    same = (lengths == lengths[0]).all(axis=0) & (lengths[0] > 0)
    for n in np.unique(lengths[0][same]):
        rows = np.flatnonzero(same & (lengths[0] == n))
        found = [f[s[rows][:, None] + np.arange(n)] for f, s in zip(flat, start, strict=True)]
        whole = np.isfinite(np.stack([m.sum(axis=1) for m in found])).all(axis=0)
        if whole.any():
            yield rows[whole], [m[whole] for m in found]


def by_row(df: DataFrame, columns: list[str], kernel: Callable[..., dict[str, np.ndarray]], schema: str, keep: int = 1) -> DataFrame:
    """``kernel`` on the sample matrices of each batch; it gives columns by name, one entry or array per row.

    The first ``keep`` columns of ``df`` stay, and ``schema`` starts with them. Rows meet the kernel with those of equal length. A row
    with a null, or with columns of unequal lengths, gives nulls.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.list_(pa.float64()) if "array" in c else pa.float64() for c in schema.split(", ")[keep:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {n: [None] * batch.num_rows for n in names[keep:]}
            for rows, matrices in matrices_by_length([batch.column(c) for c in columns]):
                found = kernel(*matrices)
                for n in names[keep:]:
                    for row, value in zip(rows, found[n].tolist(), strict=True):
                        out[n][row] = value
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), *(pa.array(out[n], k) for n, k in zip(names[keep:], kinds, strict=True))], names=names)

    return df.select(*df.columns[:keep], *[c for c in columns if c not in df.columns[:keep]]).mapInArrow(run, schema)


def with_borders(chunks: DataFrame, keys: list[str], size: int, border: int) -> DataFrame:
    """``chunks`` (keys, chunk, i0, samples of ``size`` each) with up to ``border`` samples of their neighbours on either side.

    Columns: keys, chunk, i0, before (number of samples in front of the chunk's own), n (its own) and samples. Each chunk sends copies
    of its ends to the chunks that they belong to, so no signal is gathered. A gap ends the border.
    """
    reach = -(-border // size)
    here = chunks.select(*keys, "chunk", "i0", "samples")
    sent = here.withColumn("step", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select(*keys, (F.col("chunk") + F.col("step")).alias("chunk"), F.struct((-F.col("step")).alias("side"), "i0", "samples").alias("part"))
    met = sent.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    own = F.filter("parts", lambda p: p["side"] == 0)
    met = met.where(F.size(own) == 1).withColumn("own", F.get(own, 0))
    # parts without a gap between them and the chunk itself
    joined = lambda sign: F.filter("parts", lambda p: (F.signum(p["side"]) == sign) & (F.size(F.filter("parts", lambda q: (F.signum(q["side"]) == sign) & (F.abs(q["side"]) <= F.abs(p["side"])))) == F.abs(p["side"])))
    flat = lambda parts: F.flatten(F.transform(parts, lambda p: p["samples"]))
    front, back = flat(joined(-1)), flat(joined(1))
    n_front = F.least(F.size(front), F.lit(border))
    bounded = met.select(*keys, "chunk", F.col("own.i0").alias("i0"), n_front.alias("before"), F.size("own.samples").alias("n"), F.slice(front, F.size(front) - n_front + 1, n_front).alias("_f"), F.col("own.samples").alias("_o"), F.slice(back, F.lit(1), F.lit(border)).alias("_b"))
    return bounded.select(*keys, "chunk", "i0", "before", "n", F.concat("_f", "_o", "_b").alias("samples"))


def over_chunks(chunks: DataFrame, keys: list[str], size: int, border: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(keys, chunk, i0, samples): ``kernel`` (rows of samples to rows of as many) over the signals, as if they were whole.

    The kernel sees ``border`` samples more on either side, which must be as long as its memory. A chunk with a null in it or in its
    borders gives null.
    """
    kinds = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    names = [*keys, "chunk", "i0"]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in names), "samples array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            before, n = (np.asarray(batch.column(c)) for c in ("before", "n"))
            for rows, (x,) in matrices_by_length([batch.column("samples")]):
                for row, y in zip(rows, kernel(x), strict=True):
                    out[row] = y[before[row] : before[row] + n[row]].tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.list_(pa.float64()))], names=[*names, "samples"])

    return with_borders(chunks, keys, size, border).select(*names, "before", "n", "samples").mapInArrow(run, schema)
