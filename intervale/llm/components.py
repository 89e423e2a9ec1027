"""Connected components of an edge table, by rounds of smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intervale.llm.skew import hot_keys, spread_join
from intervale.llm.store import dropped, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) for each vertex of ``edges`` (a, b): root is the smallest id that can be reached.

    Each round takes the smallest label among a vertex's neighbours and then jumps to that label's own label. Sums are partial
    before each shuffle, and the joins spread the edges of a hub and the members of a large component over many tasks. Labels are
    written after each round, so the lineage stays short. Rounds grow with the logarithm of the longest path.
    """
    both = written(edges.select(F.col("a").alias("id"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("near"))).where("id <> near").distinct(), "edges")
    hubs = hot_keys(both.groupBy("near").agg(F.count(F.lit(1)).alias("n")), ["near"])
    labels = written(both.groupBy("id").agg(F.least(F.col("id"), F.min("near")).alias("root")), "labels")
    while True:
        reached = spread_join(both, labels.select(F.col("id").alias("near"), "root"), ["near"], hubs, ["id"]).groupBy("id").agg(F.min("root").alias("seen"))
        nearest = labels.join(reached, "id").select("id", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        # the components that are large already: which of them are spread changes no result
        large = hot_keys(labels.groupBy("root").agg(F.count(F.lit(1)).alias("n")), ["root"])
        jump = labels.select(F.col("id").alias("root"), F.col("root").alias("further"))
        after = written(spread_join(nearest, jump, ["root"], large, ["id"]).select("id", "old", F.least("root", "further").alias("root")), "labels")
        dropped(labels)
        labels = after
        if after.where("root <> old").isEmpty():
            dropped(both)
            return labels.select("id", "root")
