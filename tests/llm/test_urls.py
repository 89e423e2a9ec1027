"""URL filters: given rules, rules mined from labels against SQL that lists all combinations, and edge cases."""

import random

import duckdb
import pytest

from intervale.llm import urls
from intervale.llm.queries import URL_RULES


def pages_of(spark, rows):
    """(page_id, url) with columns that clash with results."""
    return spark.createDataFrame([(*r, "x", "x", 1) for r in rows], "page_id long, url string, host string, verdict string, doc_id long").repartition(3)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


CASES = [
    ("http://a.net/x", "a.net", "/x", "net/", "block"),
    ("http://a.net", "a.net", "", None, "allow"),
    ("http://net/", "net", "/", "net/", "block"),
    ("http://A.Example.NET/en/1?q#f", "a.example.net", "/en/1", "example.net/en/", "allow"),
    ("http://example.net/EN/1", "example.net", "/EN/1", "net/", "block"),
    ("http://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
    ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://example.com/de", "example.com", "/de", None, "allow"),
    ("x://b.org/fr/?a=://c/d", "b.org", "/fr/", "org/fr/", "allow"),
    ("ftp://b.org?x/fr/", "b.org", "", None, "allow"),
    ("://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
    ("http://u@a.net:80/x", "u@a.net:80", "/x", None, "allow"),
    ("no scheme.net/", "", "", None, "allow"),
    ("http:///net/", "", "/net/", None, "allow"),
    ("http://\u00c4.net/\n\u00e9?\n", "\u00c4.net", "/\n\u00e9", "net/", "block"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
]


def test_given_rules(spark):
    found = urls.filtered_urls(pages_of(spark, [(i, c[0]) for i, c in enumerate(CASES)]), labels_of(spark, []), URL_RULES).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in found) == [(i, *c[1:3], c[3] or "", c[4]) for i, c in enumerate(CASES)]


@pytest.fixture(scope="module")
def planted(spark):
    """Farms in one section are bad, with exceptions; one url is a third of all rows; ids and labels are null or repeated in part."""
    rng = random.Random(4)
    pages, labels = [], []
    for i in range(900):
        host, section, key = rng.choice(["farm", "shop", "lib"]), rng.choice(["win", "read"]), rng.choice(["", "?ref=1", "?page=2&ref=x"])
        pages.append((i if i % 50 else None, f"http://{host}.site{i % 4}.org/{section}/{i}{key}"))
        bad = host == "farm" and section == "win" and i % 10 != 3
        labels.append((i, 0 if bad else 1, None if i % 3 else 0))
    pages += [(5000 + i, "http://hot.lib.org/read/7") for i in range(450)] + [pages[1]] * 3 + [(7000, None), (None, "http://farm.site1.org/win/x")]
    labels += [(None, 0, 0), (7, None, None), (8, 1, 1), (9, 1, 0), (9, 0, 0)]
    return pages_of(spark, pages), labels_of(spark, labels), pages


def test_mined_rules_equal_all_combinations(spark, planted):
    pages, labels, rows = planted
    db = duckdb.connect()
    db.register("pages", pages.select("page_id", "url").toArrow())
    db.register("labels", labels.toArrow())
    want = db.sql(urls.filter_sql(URL_RULES))
    found = urls.filtered_urls(pages, labels, URL_RULES).select(*want.columns).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(want.fetchall(), key=key)
    assert len(found) == len(rows)
    verdict = {r["host"] + r["path"]: (r["mined"], r["verdict"]) for r in found}
    assert verdict["farm.site1.org/win/x"] == ("h:farm p:win", "block")
    assert {r["verdict"] for r in found if r["host"].startswith("farm") and r["path"].startswith("/win/")} == {"block"}
    assert {r["verdict"] for r in found if r["host"].startswith("lib")} == {"allow"}


def test_rules_beaten_by_a_part_are_superfluous(spark, planted):
    pages, labels, _ = planted
    rules = urls.mined_rules(urls.labelled_urls(pages, labels)).collect()
    bodies = {(r["verdict"], frozenset(r["body"])): r["confidence"] for r in rules}
    assert ("block", frozenset(["h:farm", "p:win"])) in bodies
    for (verdict, body), sure in bodies.items():
        assert not any(v == verdict and b < body and c >= sure for (v, b), c in bodies.items())
    for r in rules:
        assert r["confidence"] == r["support"] / r["total"] >= urls.CONFIDENCE and r["support"] >= urls.LEAST and r["lift"] >= urls.LIFT


def test_empty_tables(spark, planted):
    pages, labels, _ = planted
    assert urls.filtered_urls(pages.limit(0), labels, URL_RULES).count() == 0
    assert {r["mined"] for r in urls.filtered_urls(pages, labels.limit(0), URL_RULES).select("mined").collect()} == {None}


def test_long_urls(spark):
    long = "http://a.b/" + "seg/" * 40_000 + "9"
    found = urls.filtered_urls(pages_of(spark, [(1, long), (2, "http://" + "a." * 30_000 + "net/")]), labels_of(spark, [(9, 0, 0)]), URL_RULES).collect()
    assert {r["page_id"]: (len(r["path"]), r["rule"]) for r in found} == {1: (len(long) - 10, None), 2: (1, "net/")}


def test_rules_come_from_all_frequent_tokens_of_a_url(spark):
    """Urls with up to 15 frequent tokens, whose common ones decide; two keys always come together, and one of them alone on pages without a label."""
    rng = random.Random(9)
    pages, labels = [], []
    for i in range(400):
        keys = [f"k{k}=1" for k in range(9) if rng.random() < 0.45]
        keys += ["t1", "t2"] if rng.random() < 0.4 else []
        host, section = rng.choice(["farm", "shop"]), rng.choice(["win", "read"])
        pages.append((i, f"http://{host}.org/{section}/{i}?" + "&".join(keys)))
        bad = rng.random() < (0.9 if host == "farm" and section == "win" else 0.75 if "t1" in keys else 0.1)
        labels.append((i, 0 if bad else 1, 0))
    pages += [(1000 + i, f"http://shop.org/read/none?{key}") for i, key in enumerate(["t1", "t2", "t2&t1&k3", ""])]
    frames = pages_of(spark, pages), labels_of(spark, labels)
    db = duckdb.connect()
    db.register("pages", frames[0].select("page_id", "url").toArrow())
    db.register("labels", frames[1].toArrow())
    every = urls.filter_sql(URL_RULES).replace(f"[1:{urls.TOKENS}]", "[1:]")
    assert every != urls.filter_sql(URL_RULES)
    want = db.sql(every)
    found = urls.filtered_urls(*frames, URL_RULES).select(*want.columns).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, found), key=key) == sorted(want.fetchall(), key=key)
    assert {r["mined"] for r in found if r["page_id"] in (1000, 1001)} == {"q:t1", "q:t2"}


def test_copies_of_a_long_url_have_few_combinations(spark):
    long = "http://farm.org/" + "/".join(f"a{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)) + "/"
    pages = [(i, f"{long}{i}" if i % 2 else f"http://lib.org/{i}") for i in range(100)]
    rules = urls.mined_rules(urls.labelled_urls(pages_of(spark, pages), labels_of(spark, [(i, 1 - i % 2, 0) for i in range(100)]))).collect()
    assert sorted((r["verdict"], len(r["body"]), len(r["choices"][0])) for r in rules) == [("allow", 1, 1), ("block", 1, 61)]
