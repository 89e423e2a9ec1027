"""Null and repeated ids in the stages that judge rows, and in the decontamination operator."""

from collections import Counter

import pytest

import corpus_pipeline as p
from intervale.llm import decontaminate
from tests.llm.test_text_operators import contaminated

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, texts):
    return spark.createDataFrame([(d, t, None, None, None) for d, t in texts], SCHEMA).repartition(3)


def leaks(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 12]
    clean = [f"entirely unrelated sentence number {i} about gardens" for i in range(4)]
    texts = [(None, items[0][1]), (None, clean[0]), (None, f"before {items[1][1]} after"), (5, clean[1]), (5, items[2][1]), (6, items[3][1]), (6, items[3][1]), (7, clean[2]), (7, clean[2]), (8, None)]
    return items, clean, texts


def test_contaminated_rows_go_and_their_clean_twins_stay(spark):
    _, clean, texts = leaks(spark)
    found = p.keep_uncontaminated(spark, rows_of(spark, texts), SF).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter([(None, clean[0]), (5, clean[1]), (7, clean[2]), (7, clean[2]), (8, None)])


@pytest.mark.parametrize("block_bytes", [4 << 20, 200])
def test_one_row_per_row_in_one_block_and_in_several(spark, monkeypatch, block_bytes):
    items, _, texts = leaks(spark)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    benchmark = spark.createDataFrame(items[:6], "item_id long, text string")
    assert (decontaminate.block_count(benchmark) > 1) == (block_bytes == 200)
    found = decontaminate.contamination(rows_of(spark, texts), benchmark).collect()
    want = [(d, *contaminated([(d, t)], items[:6])[d]) for d, t in texts]
    assert Counter(map(tuple, found)) == Counter(want) and any(d is None and bad for d, *_, bad in want)


def test_near_stage_judges_rows_by_their_own_text(spark):
    one, two = " ".join(f"alpha{i}" for i in range(60)), " ".join(f"beta{i}" for i in range(60))
    texts = [(3, one), (7, one), (7, two), (9, two), (None, one), (7, two)]
    found = p.keep_one_of_each(spark, rows_of(spark, texts), SF).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter([(3, one), (7, two), (7, two), (None, one)])
