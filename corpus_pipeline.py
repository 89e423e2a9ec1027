"""A corpus pipeline of five stages. Each takes all that the stage before it kept and gives the documents that it keeps itself.

The last stage gives the pieces of packed sequences. SQL cannot express a trained classifier or a tokeniser, so ORACLE_SQL is None;
the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm import decontaminate, linedup, neardup, quality
from intervale.llm.queries import ADDED, packed, table
from intervale.llm.skew import hot_keys, spread_join
from intervale.llm.store import numbered, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. All rows with a null or empty text score as the prior."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of repeated multi-line passages; emptied ones stay, as rows with an empty text."""
    return linedup.remove_repeated_passages(docs).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with the smallest doc_id of each group of near duplicates; rows without a doc_id or any word stay.

    Rows are compared each on their own, so one that repeats a doc_id with another text is not judged by its twin.
    """
    rows = numbered(docs)
    own = rows.select(F.when(F.col("doc_id").isNotNull(), F.col("_row")).alias("doc_id"), "text")
    found = neardup.near_duplicates(own, percent=80).where("doc_id IS NOT NULL").select(F.col("doc_id").alias("_row"), "component_id")
    named = written(found.join(rows.select("_row", "doc_id"), "_row"), "components")
    least = named.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    gone = spread_join(named, least.select("component_id", "least"), ["component_id"], hot_keys(least, ["component_id"]), ["_row"]).where("doc_id > least").select("_row")
    return rows.join(gone, "_row", "left_anti").select(*docs.columns)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that share no phrase of ten words, and no whole shorter item, with the benchmark, whatever their doc_id."""
    rows = numbered(docs)
    found = decontaminate.contamination(rows.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(found.where("contaminated").select(F.col("doc_id").alias("_row")), "_row", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    return packed(docs, ADDED)


STAGES = [("quality_classifier", keep_good), ("line_dedup", cut_repeated_lines), ("near_dedup", keep_one_of_each), ("decontamination", keep_uncontaminated), ("packing", pack_sequences)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
