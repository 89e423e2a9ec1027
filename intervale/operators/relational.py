"""Relational building blocks: first rows, set comparisons, cross-tables with a fixed domain, ranks and agreement of labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intervale.operators import scans as S


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: one aggregate with partial sums, no sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.min(F.struct(*order, *rest)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in [*order, *rest]])


def top_per_key(df: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key with their number; Spark cuts each task's groups to k rows before the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("place") <= k)


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """Counts of each pair of values, with zeros for pairs that do not occur."""
    counts = df.groupBy(row, column).agg(F.count(F.lit(1)).cast("long").alias("n"))
    grid = counts.select(row).distinct().join(counts.select(column).distinct(), how="cross")
    return grid.join(counts, [row, column], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def chi_square(counts: DataFrame, row: str, column: str) -> DataFrame:
    """Chi-square statistic and degrees of freedom of a filled cross-table; null if a margin has one level only."""
    margins = counts.withColumns({"_r": F.sum("n").over(Window.partitionBy(row)), "_c": F.sum("n").over(Window.partitionBy(column))})
    total = counts.agg(F.sum("n").alias("_t"), F.countDistinct(row).alias("_nr"), F.countDistinct(column).alias("_nc"))
    expected = F.col("_r") * F.col("_c").cast("double") / F.col("_t")
    found = margins.crossJoin(F.broadcast(total)).agg(F.sum((F.col("n") - expected) * (F.col("n") - expected) / expected).alias("chi2"), F.first((F.col("_nr") - 1) * (F.col("_nc") - 1)).cast("long").alias("dof"))
    return found.withColumn("chi2", F.when(F.col("dof") > 0, F.col("chi2")))


def pairs_of(n: Column) -> Column:
    return n.cast("double") * (n.cast("double") - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labelings of the same rows."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    parts = []
    for name, column in (("cell", None), ("a", a), ("b", b)):
        sums = cells if column is None else cells.groupBy(column).agg(F.sum("n").alias("n"))
        x = F.col("n").cast("double")
        parts.append(sums.agg(F.coalesce(F.sum(pairs_of(F.col("n"))), F.lit(0.0)).alias(f"p_{name}"), F.sum(x).alias(f"t_{name}"), F.sum(x * F.log(x)).alias(f"l_{name}")))
    one = parts[0].crossJoin(parts[1]).crossJoin(parts[2])
    total, t = pairs_of(F.col("t_cell")), F.col("t_cell")
    expected = F.col("p_a") * F.col("p_b") / total
    most = (F.col("p_a") + F.col("p_b")) / 2
    h = lambda c: F.log(t) - F.col(c) / t
    mutual = h("l_a") + h("l_b") - h("l_cell")
    mean = (h("l_a") + h("l_b")) / 2
    return one.select(F.when(most == expected, 1.0).otherwise((F.col("p_cell") - expected) / (most - expected)).alias("ari"), F.when(mean == 0, 1.0).otherwise(mutual / mean).alias("nmi"))


def midranks(df: DataFrame, value: str, strata: list[str]) -> DataFrame:
    """``rank``: the mean of the ranks that equal values share inside a stratum.

    Ranks come from counts per distinct value, so rows are not sorted one by one; strata with few distinct values stay small.
    """
    counts = df.groupBy(*strata, value).agg(F.count(F.lit(1)).alias("_n"))
    below = F.sum("_n").over(Window.partitionBy(*strata).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("rank", below - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(ranked, [*strata, value])


def mann_whitney(df: DataFrame, value: str, group: Column, strata: list[str]) -> DataFrame:
    """U, AUC and the tie-corrected normal z of the rows with ``group`` against the others, by stratum."""
    marked = df.withColumn("_in", group.cast("long"))
    counts = marked.groupBy(*strata, value).agg(F.count(F.lit(1)).alias("_n"), F.sum("_in").alias("_a"))
    below = F.sum("_n").over(Window.partitionBy(*strata).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("_rank", below - (F.col("_n") - 1) / 2.0)
    n, tie = F.col("_n").cast("double"), F.col("_n").cast("double")
    sums = ranked.groupBy(*strata).agg(F.sum(F.col("_a") * F.col("_rank")).alias("_r"), F.sum("_a").cast("double").alias("na"), F.sum(n).alias("_t"), F.sum(tie * tie * tie - tie).alias("_tie"))
    nb = F.col("_t") - F.col("na")
    u = F.col("_r") - F.col("na") * (F.col("na") + 1) / 2
    both = (F.col("na") > 0) & (nb > 0)
    spread = F.sqrt(F.col("na") * nb / 12 * (F.col("_t") + 1 - F.col("_tie") / (F.col("_t") * (F.col("_t") - 1))))
    return sums.select(*strata, F.col("na").cast("long").alias("na"), nb.cast("long").alias("nb"), F.when(both, u).alias("u"), F.when(both, u / (F.col("na") * nb)).alias("auc"), F.when(both & (spread > 0), (u - F.col("na") * nb / 2) / spread).alias("z"))


def benjamini_hochberg(df: DataFrame, p: str, key: str, save: Callable[[DataFrame], DataFrame], parts: int | None = None) -> DataFrame:
    """``q``: the false-discovery rate of each p-value; nulls stay null and do not count.

    Ranks, and the least of what follows, come from scans over parts of the ordered p-values.
    """
    tested = df.where(F.col(p).isNotNull())
    n = tested.agg(F.count(F.lit(1)).alias("_m"))
    order = [p, key]
    ranked = S.scanned(S.dealt(tested.select(p, key), [], order, save, parts), [], order, {"_rank": ("rank", None)})
    raw = ranked.crossJoin(F.broadcast(n)).withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    q = S.scanned(raw.select(p, key, "_part", "_raw"), [], order, {"q": ("suffix_min", F.col("_raw"))})
    return df.join(q.select(key, F.least(F.lit(1.0), F.col("q")).alias("q")), key, "left")


def in_order_of(df: DataFrame, key: str, keys: list, kind: str) -> DataFrame:
    """Rows of ``df`` for each entry of the list ``keys``, with its ``place`` from 0: repeated entries repeat, missing ones have nulls.

    ``kind`` is the type of the entries. Results that came in any order are put back with ``orderBy("place")``.
    """
    listed = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(keys)], f"place long, {key} {kind}")
    return F.broadcast(listed).join(df, key, "left")


def covered(counts: DataFrame, key: str, values: list, column: str, least: int) -> DataFrame:
    """The ``key`` of each group that has at least ``least`` (column n) of every one of ``values`` in ``column``."""
    enough = F.count_if(F.col(column).isin(values) & (F.col("n") >= least)) == len(set(values))
    return counts.groupBy(key).agg(enough.alias("_all")).where("_all").select(key)


def stratum(*columns: str, sep: str = "|") -> Column:
    """The composite key of some columns; a null is an empty part."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
