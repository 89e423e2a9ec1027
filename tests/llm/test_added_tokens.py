"""Packed ids against the tokenizer with its default settings, texts with its added token included."""

import json
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from intervale.llm import queries

TEXTS = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a  <|endoftext|>  b", "x<|endoftext|>\n\n y", "<|endoftext|", "<<|endoftext|>>", " <|endoftext|>", "plain text  with\tspaces ", "", None]


def test_ids_equal_the_tokenizer_with_its_defaults(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        assert {t["content"]: t["id"] for t in json.load(f)["added_tokens"]} == queries.ADDED
    model = Tokenizer.from_file(path)
    ids = {d: [*model.encode(t or "", add_special_tokens=False).ids, 1] for d, t in enumerate(TEXTS)}
    assert ids[0] == [31373, 220, 50256, 995, 1]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for packed in (queries.op6_packing(spark, str(tmp_path)), p.pack_sequences(spark, docs, str(tmp_path))):
        found = packed.collect()
        assert sum(r.length for r in found) == sum(map(len, ids.values())) and {r.doc_id for r in found} == set(ids)
        for r in found:
            assert r.doc_tokens == len(ids[r.doc_id])
            assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
