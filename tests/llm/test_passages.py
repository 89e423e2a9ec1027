"""Repeated passages of the line stage against brute force."""

import random

import corpus_pipeline as p
from intervale.llm import linedup
from tests.llm.test_text_operators import EDGES, frame

SF = "/root/testdata/sf0.001"


def pairs_of(lines):
    full = [i for i, line in enumerate(lines) if line.strip(" \t\r")]
    return [(a, b, (lines[a], b - a, lines[b])) for a, b in zip(full, full[1:])]


def left_lines(rows):
    """The lines of each row that no repeated pair covers, the first place of each pair apart."""
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for a, _, key in pairs_of((text or "").split("\n")):
            first.setdefault(key, (doc, a))
    out = {}
    for doc, text in rows:
        lines = (text or "").split("\n")
        gone = {i for a, b, key in pairs_of(lines) if doc is not None and first[key] != (doc, a) for i in range(a, b + 1)}
        out[doc] = [line for i, line in enumerate(lines) if i not in gone]
    return out


def test_every_repeated_run_loses_its_lines(spark):
    dice = random.Random(5)
    line = lambda: " ".join(dice.choice("abcdefgh") + str(dice.randint(0, 999)) for _ in range(9))
    runs = [[line() for _ in range(n)] for n in (2, 2, 2, 3, 3, 4, 5, 6) * 4]
    rows = [(i, "\n".join([line(), line(), *run, line()])) for i, run in enumerate(runs)]
    rows += [(1000 + i, "\n".join([line(), *run, line(), line()])) for i, run in enumerate(runs)]
    rows += [(2000, "x y\n\nz w\n\n\nv"), (2001, "new\nx y\n\nz w\nother"), (2002, "x y\nz w")]
    found = {r.doc_id: r for r in linedup.remove_repeated_passages(frame(spark, rows)).collect()}
    want = left_lines(rows)
    assert {d: found[d].text for d, _ in rows} == {d: "\n".join(want[d]) for d, _ in rows}
    assert all(found[1000 + i].n_removed == len(run) for i, run in enumerate(runs))
    by_chunks = linedup.remove_repeated_chunks(frame(spark, rows)).where("doc_id >= 1000 AND doc_id < 2000 AND n_removed = 0").count()
    assert by_chunks > 0  # chunks alone leave whole runs


def test_stage_on_documents_leaves_no_repeated_pair(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = left_lines(rows)
    stage = {r.doc_id: r.text or "" for r in p.cut_repeated_lines(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).collect()}
    chunks = {r.doc_id: r.text or "" for r in linedup.remove_repeated_chunks(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for d, _ in rows:
        assert len(stage[d]) <= min(len("\n".join(want[d])), len(chunks[d]))


def test_passages_edges(spark):
    again = [(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "q\nr\ns\nt"), (2, "a\nb\nc"), (2, "k\nl"), (3, "m\nm\nm\nm")]
    found = linedup.remove_repeated_passages(frame(spark, again + EDGES))
    got = sorted((r.doc_id, r.text) for r in found.where("doc_id < 9000").collect())
    assert got == [(1, "a\nb\nc"), (1, "q\nr\ns\nt"), (2, ""), (2, "k\nl"), (3, "m")]
    assert found.count() == len(again) + len(EDGES) and found.where("doc_id IS NULL AND n_removed > 0").count() == 0
    assert linedup.remove_repeated_passages(frame(spark, EDGES).limit(0)).count() == 0
