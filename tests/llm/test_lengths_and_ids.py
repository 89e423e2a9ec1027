"""Nothing is lost to length, and rows that share a doc_id are judged each by their own text."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from intervale.llm import language, linedup, quality, secrets, substrings
from intervale.llm.extract import main_text

LONG = "This is a long paragraph of a reader, with commas, clauses, and enough words to be worth many points in any scoring. " * 4


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def sentence(words, n, seed):
    return " ".join(random.Random(seed).choices(words, k=n))


def test_classifier_learns_from_long_texts_only(spark):
    good, bad = [f"good{i}" for i in range(300)], [f"poor{i}" for i in range(300)]
    rows = [(i, sentence(good if i % 2 else bad, 4000, i), "en") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(docs_of(spark, rows), labels).collect()
    assert all(len(t) > 24_000 for _, t, _ in rows)
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in found)


def test_bags_of_long_texts_are_drawn_from_the_whole(spark):
    text = sentence([f"w{i}" for i in range(5000)], 30_000, 1)
    (whole,) = quality.bags(pa.array([text]))
    bucket, count = quality.drawn(*whole, 4096)
    assert len(bucket) == 4096 and set(zip(bucket, count)) <= set(zip(*whole))
    held = np.isin(whole[0], bucket)  # spread over all buckets
    assert 0.8 < held[: len(held) // 2].mean() / held[len(held) // 2 :].mean() < 1.25
    assert quality.drawn(*whole, len(whole[0]))[0] is whole[0]


def test_bags_reach_the_driver_in_few_bytes(spark, monkeypatch):
    """The pipeline's driver ran out of its memory with bags of eight bytes a feature; the model is that of the whole bags."""
    texts = [sentence([f"{'good' if i % 2 else 'poor'}{k}" for k in range(900)], 1500, i) for i in range(40)] + ["", None, "one", "x " * 70_000]
    docs = docs_of(spark, [(i, t, "en") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    sent, collect = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: sent.append(collect(self)) or sent[-1])
    model = quality.trained(docs, labels, labels["doc_id"].isNotNull())
    whole = [quality.drawn(*bag, quality.FITTED) for bag in quality.bags(pa.array(texts))]
    assert sum(table.nbytes for table in sent) < 2 * sum(len(bucket) for bucket, _ in whole)
    vectors = np.random.default_rng(7).uniform(-1 / quality.SIZE, 1 / quality.SIZE, (quality.BUCKETS, quality.SIZE)).astype(np.float32)
    moved = np.flatnonzero((model.vectors != vectors).any(axis=1))
    assert 0.9 < len(moved) / len(np.unique(np.concatenate([bucket for bucket, _ in whole]))) <= 1
    for bucket, count in whole:
        again = quality.unpacked(quality.packed(bucket, count))
        assert again[0].tolist() == bucket.tolist() and again[1].tolist() == np.minimum(count, 65_535).tolist()


def test_a_language_of_long_texts_is_learned(spark):
    english, german = "the of and to in is that was for it with as".split(), "der die und in den von zu das mit sich des auf".split()
    rows = [(i, sentence(german, 18_000, i), "de") for i in range(12)] + [(100 + i, sentence(english, 40, i), "en") for i in range(60)]
    found = {r["doc_id"]: r["lang_pred"] for r in language.languages(docs_of(spark, rows)).collect()}
    assert all(len(t) > 64 << 10 for i, t, _ in rows if i < 100)
    assert all(lang == ("de" if i < 100 else "en") for i, lang in found.items())


def test_predictions_are_cosines_to_all_centroids(spark):
    """The scorer against one that lists the n-grams of each text one by one."""
    rows = [(i, sentence(["alpha", "beta", "gamma"], 30, i), "a") for i in range(30)] + [(50 + i, sentence(["uno", "dos", "tres"], 30, i), "b") for i in range(30)]
    docs = docs_of(spark, rows)
    model = language.trained(docs, ~language.held_out(docs["doc_id"]), 20, 2)
    for r in language.predicted(docs, model).collect():
        n, _ = language.counts(pa.array([dict((i, t) for i, t, _ in rows)[r["doc_id"]]]))
        v = [np.log1p(x) * w for x, w in zip(n[0].tolist(), model.idf.tolist())]
        size = sum(x * x for x in v) ** 0.5
        cosines = [sum(x * y for x, y in zip(v, c.tolist())) / size for c in model.centres]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert r["lang_pred"] == model.langs[best] and abs(r["score"] - cosines[best]) < 1e-5


def test_scores_are_means_of_embeddings(spark):
    """The scorer against one that averages the vectors of the features, one by one."""
    rng = np.random.default_rng(3)
    model = quality.Model(rng.standard_normal((quality.BUCKETS, quality.SIZE)).astype(np.float32), rng.standard_normal((quality.SIZE, 2)).astype(np.float32), np.array([0.1, -0.2], np.float32), 0.3)
    rows = [(1, "one two two three", "x"), (2, "été naïve", "x"), (3, None, "x"), (4, "a", "x")]
    for r in quality.scored(docs_of(spark, rows).select("doc_id", "text"), model).collect():
        (bag,) = quality.bags(pa.array([r["text"]]))
        total = int(bag[1].sum())
        mean = sum((model.vectors[b].astype(float) * c for b, c in zip(*bag)), np.zeros(quality.SIZE)) / max(total, 1)
        score = mean @ model.layer.astype(float) + model.bias
        own = total / (total + quality.PRIOR_WEIGHT)
        odds = own * (score[1] - score[0]) + (1 - own) * np.log(0.3 / 0.7)
        assert abs(r["score"] - 1 / (1 + np.exp(-odds))) < 1e-4


@pytest.fixture(scope="module")
def twins(spark):
    """One id with three texts: a copied passage, nothing repeated, and a line with a secret."""
    shared = " ".join(f"shared{i}" for i in range(40))
    lines = "\n".join(f"a line that is in two texts, number {i}" for i in range(24))
    own = "\n".join(f"a line of its own, number {i}" for i in range(24))
    rows = [(1, shared + "\n" + lines, "x"), (2, shared + "\n" + lines, "x"), (2, " ".join(f"unique{i}" for i in range(60)), "x"), (2, own, "x"), (3, "password=abcdefgh12", "x"), (3, "no secret here at all, only words", "x"), (3, "no secret here at all, only words", "x")]
    return rows, docs_of(spark, rows)


def test_substring_dedup_judges_each_text(twins):
    rows, docs = twins
    found = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(docs, digest=True).collect())
    n = {t: len(t.split()) for _, t, _ in rows}
    assert found == sorted([(1, n[rows[0][1]], 0), (2, n[rows[1][1]], n[rows[1][1]]), (2, 60, 0), (2, n[rows[3][1]], 0), (3, 1, 0), (3, 7, 0), (3, 7, 0)])


def test_line_dedup_judges_each_text(twins):
    rows, docs = twins
    found = linedup.chunk_report(docs).collect()
    kept = sorted(hashlib.sha256(t.encode()).hexdigest() for i, t, _ in rows if (i, t[:6]) != (2, "shared"))
    assert len(found) == len(rows) and sum(r["n_removed"] > 0 for r in found) == 1
    assert sorted(r["kept_sha256"] for r in found if not r["n_removed"]) == kept


def test_secret_scan_judges_each_text(twins):
    _, docs = twins
    found = sorted((r["n_assign"], r["spans"]) for r in secrets.secret_report(docs).where("doc_id = 3").collect())
    assert found == [(0, ""), (0, ""), (1, "assign:0:19")]


def test_short_articles_are_kept_and_what_is_beside_them_goes():
    two = "<p>First sentence here is short.</p><p>Second one, too.</p>"
    side = '<div class="sidebar">' + f"<p>{LONG}</p>" * 6 + "</div>"
    assert main_text(f'<body><div class="post"><p>Short one.</p></div><div id="comments"><p>{LONG}</p></div></body>') == "Short one."
    for frame in (f"<article><h1>Title</h1>{two}</article>", f"<div><h1>Title</h1>{two}</div>"):
        assert main_text(f"<body>{frame}{side}</body>") == "Title\nFirst sentence here is short.\nSecond one, too."
    assert main_text(f'<body><div class="promo"><p>{LONG}</p></div></body>') == LONG.strip()  # nothing else holds text
