"""Exact quantiles by refined histograms.

A pass counts the values of each key by cell between a low and a high bound, and each wanted rank moves on to the one cell that holds it,
with the least and greatest value there as the new bounds. Counts are summed in each task before they are sent, and no value is. When few
values are left between the bounds, those are sorted; equal values need no sorting. Cells are of equal width in odd passes and of equal
width of the logarithm in even ones, so that neither many near values nor a few far ones hold it up for long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a pass, values that are sorted, passes at most, and ranks whose bounds are sent to every task (a row of about 100 bytes each).
CELLS, SORTED, PASSES, SENT = 1024, 10_000, 40, 50_000
_LARGEST = 1.7976931348623157e308


def _cell(value: Column, low: Column, high: Column, cells: int, logarithmic: bool) -> Column:
    """The number of the cell, a function that never falls as the value rises."""
    bounded = lambda c: F.greatest(F.least(c, F.lit(_LARGEST)), F.lit(-_LARGEST)) / 2
    scale = (lambda c: F.signum(bounded(c)) * F.log1p(F.abs(bounded(c)))) if logarithmic else bounded
    share = F.try_divide(scale(value) - scale(low), scale(high) - scale(low))
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * cells), F.lit(cells - 1)).cast("int")


def _same(keys: list[str], of: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{of}{k}"))
    return out


def quantiles(df: DataFrame, keys: list[str], value: Column, shares: dict[str, float], save: Callable[[DataFrame], DataFrame], cells: int = CELLS, sorted_rows: int = SORTED, passes: int = PASSES) -> DataFrame:
    """(keys, n, and a column for each of ``shares``): quantiles of the non-null values of each key, linear between neighbours.

    Without keys there is one row. NaN counts as null; a key without a value has n = 0 and nulls. A null key is a key. ``save`` writes a
    table and reads it back.
    """
    # without keys: a key that is the same for all rows, but not known to be, so that bounds still meet rows by a key
    own = keys or ["_all"]
    given = value.cast("double")
    rows = df.select(*([F.col(k) for k in keys] or [F.pmod(F.coalesce(F.hash(given), F.lit(0)), F.lit(1)).alias("_all")]), F.when(~F.isnan(given), given).alias("_v"))
    sized = save(rows.groupBy(*own).agg(F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")))
    at = lambda q: (F.col("n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at(q)), F.ceil(at(q))) for q in shares.values()])))
    valued = rows.where("_v IS NOT NULL")
    state = sized.where("n > 0").select(*own, F.explode(ranks).alias("rank"), F.lit(0).cast("long").alias("below"), F.col("n").alias("held"), "low", "high", F.lit(True).alias("moves"))
    is_open = (F.col("held") > sorted_rows) & (F.col("low") < F.col("high"))

    def between(chosen: DataFrame) -> DataFrame:
        """The rows between the bounds of ``chosen``, with these."""
        bounds = chosen.select(*[F.col(k).alias(f"_of_{k}") for k in own], F.col("low").alias("_low"), F.col("high").alias("_high")).distinct()
        if small:
            bounds = F.broadcast(bounds)
        return valued.join(bounds, _same(own, "_of_") & (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))

    small = sized.count() * 2 * len(shares) <= SENT
    for number in range(passes):
        if state.where(is_open & F.col("moves")).isEmpty():
            break
        state = state if number == 0 else save(state)
        busy = state.where(is_open & F.col("moves"))
        counts = between(busy).groupBy(*own, "_low", "_high", _cell(F.col("_v"), F.col("_low"), F.col("_high"), cells, number % 2 == 1).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        up = Window.partitionBy(*own, "_low", "_high").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
        found = counts.select(*[F.col(k).alias(f"_of_{k}") for k in own], "_low", "_high", "_n", "_least", "_most", (F.sum("_n").over(up) - F.col("_n")).alias("_before"))
        holds = (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high")) & (F.col("rank") - F.col("below") >= F.col("_before")) & (F.col("rank") - F.col("below") < F.col("_before") + F.col("_n"))
        narrower = (F.col("_n") < F.col("held")) | F.lit(number % 2 == 0)  # either kind of cells gets its turn
        after = busy.join(found, _same(own, "_of_") & holds).select(*own, "rank", (F.col("below") + F.col("_before")).alias("below"), F.col("_n").alias("held"), F.col("_least").alias("low"), F.col("_most").alias("high"), narrower.alias("moves"))
        state = save(state.where(~(is_open & F.col("moves"))).unionByName(after))
    equal = state.where("low = high").select(*own, "rank", F.col("low").alias("value"))
    rest = state.where("low < high")
    turn = F.row_number().over(Window.partitionBy(*own, "_low", "_high").orderBy("_v")) - 1
    ordered = between(rest).select(*[F.col(k).alias(f"_in_{k}") for k in own], "_low", "_high", "_v", turn.alias("_turn"))
    picked = rest.join(ordered, _same(own, "_in_") & (F.col("low") == F.col("_low")) & (F.col("high") == F.col("_high")) & (F.col("rank") - F.col("below") == F.col("_turn"))).select(*own, "rank", F.col("_v").alias("value"))
    lists = equal.unionByName(picked).groupBy(*[F.col(k).alias(f"_of_{k}") for k in own]).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_values"))
    joined = sized.join(lists, _same(own, "_of_"), "left")

    def of(q: float) -> Column:
        a, b = (F.try_element_at("_values", f(at(q))) for f in (F.floor, F.ceil))
        # equal ends first: infinite ones have no difference
        return F.when(a == b, a).otherwise(a + (b - a) * (at(q) - F.floor(at(q))))

    if keys:
        return joined.select(*keys, "n", *[of(q).alias(name) for name, q in shares.items()])
    return joined.groupBy().agg(F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("n"), *[F.max(of(q)).alias(name) for name, q in shares.items()])


def medians(df: DataFrame, keys: list[str], value: Column, name: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, ``name``): the exact median of each key's non-null values."""
    return quantiles(df, keys, value, {name: 0.5}, save).drop("n")
