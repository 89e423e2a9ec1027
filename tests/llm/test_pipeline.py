"""The stages of the pipeline, each against a brute-force version on its own input."""

import pytest

import corpus_pipeline as p
from intervale.llm import quality
from tests.llm.test_text_operators import EDGES, components, contaminated

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(d, t, None, None, None) for d, t in EDGES]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema))


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


def test_every_stage_but_the_last_keeps_the_columns(spark, documents):
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, documents, SF).schema.names == documents.schema.names
        assert stage(spark, documents.limit(0), SF).count() == 0


def test_quality_stage_drops_what_is_scored_below(spark, documents):
    scores = quality.quality_scores(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(p.keep_good(spark, documents, SF)) == ids(scores.where("score >= 0.3"))


def test_line_stage_keeps_rows(spark, documents):
    found = p.cut_repeated_lines(spark, documents, SF)
    assert ids(found) == ids(documents) and found.where("n_chars <> length(text)").count() == 0


def test_near_stage_keeps_one_of_each(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    root = {d: r for d, (_, r) in components(rows, 80).items()}
    assert ids(p.keep_one_of_each(spark, documents, SF)) == sorted((d for d, _ in rows if d is None or root[d] == d), key=lambda x: (x is None, x))


def test_decontamination_stage(spark, documents):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    bad = {d for d, v in contaminated(rows, items).items() if v[-1]}
    assert bad and ids(p.keep_uncontaminated(spark, documents, SF)) == sorted((d for d, _ in rows if d not in bad), key=lambda x: (x is None, x))


def test_run(spark):
    found = p.run(spark, SF).toPandas()
    lengths = found.groupby("sequence_id").length.sum()
    assert len(found) and (lengths.iloc[:-1] == 2048).all()
