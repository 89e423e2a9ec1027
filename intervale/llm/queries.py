"""The subpackage's queries: each applies an operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intervale.llm import decontaminate, extract, fertility, language, linedup, neardup, negatives, oracles, packing, quality, secrets, substrings, urls, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The added tokens of byte_bpe_50k.json, which the ranks file does not hold.
ADDED = {"<|endoftext|>": 50_256}


def packed(docs: DataFrame, added: dict[str, int] | None = None) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 50_257, added=added)


def vocabularies() -> tuple[str, tuple[str, str]]:
    """The piece vocabulary, and the byte-level one for many languages with its pattern."""
    return public_tokenizers.path("piece_bpe_32k.model"), (public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.page_texts(table(spark, sf_dir, "pages"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(table(spark, sf_dir, "documents"), *vocabularies())


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.chunk_report(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), ADDED)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


#: Verdicts given for hosts with their subdomains and the paths that start so.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filtered_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(vectors, "vec_id", "label", "embedding")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_html_extract, op2_substring_dedup, op3_quality_rules, op4_line_dedup, op5_quality_classifier, op6_packing, op7_decontamination, op8_language_id, op9_near_dedup, op10_secret_scan, op11_url_filter, op12_hard_negatives, op13_whitening)
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": oracles.SUBSTRINGS,
    "op4_line_dedup": linedup.CHUNK_SQL,
    "op7_decontamination": oracles.CONTAMINATION,
    "op9_near_dedup": oracles.NEAR_DUPLICATES,
    "op10_secret_scan": oracles.secrets_sql(secrets.BASE, secrets.WIDER, secrets.OWNERS, secrets.REPOSITORIES),
    "op11_url_filter": urls.filter_sql(URL_RULES),
    "op12_hard_negatives": negatives.NEGATIVES_SQL,
}
