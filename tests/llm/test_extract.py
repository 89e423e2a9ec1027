"""Main text of pages."""

import re
import time

import pytest

from intervale.llm import extract
from intervale.llm.extract import main_text, page_texts

PAGE = """<html><head><title>x</title></head><body class="with-sidebar"><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, ok, yes</div>
<div class="layout"><div class="sidebar"><p>Side, text, here, long long</p></div><div class="content"><h1>Title</h1><p>First para, with <a href=x>link</a> &amp; commas, ok.</p>
<p>Second <span class="ad">AD</span> para&nbsp;here, that   is
long.<div class="ad-box">buy</div><ul><li>one<li>two, three</ul><table><tr><td>c1<td>c2</table><form><input><p>name</p></form></div>
<div id="comments"><p>a long comment, with, many, commas, in, it, so, that, it, scores, well, yes</p></div></div><footer>foot</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE).split("\n") == ["Title", "First para, with link & commas, ok.", "Second para here, that is long.", "one", "two, three", "c1", "c2"]


@pytest.mark.parametrize(("source", "text"), [(None, ""), ("", ""), ("a < b, c", "a < b, c"), ("<p>hi", "hi"), ("<nav>x</nav>", ""), ("<p>x &lt;b&gt; &#233; y", "x <b> é y"), ("<script>var t='</p>'</script><p>a<br>b</p><!-- <p>c</p> -->", "a b"), ("<article><header>h</header><p>t</p><aside>s</aside></article>", "t"), ("<div hidden><p>no</p></div><p>yes</p>", "yes")])
def test_small_pages(source, text):
    assert main_text(source) == text


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in page_texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html

        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[a-z/][^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(1, None, None, "a"), (None, "u", "<p>x</p>", "b"), (None, "u", "<p>x</p>", "b"), (2, "v", "<p>" + "long, " * 50_000, "c")], "page_id long, url string, html string, text string")
    found = page_texts(odd).collect()
    assert sorted(r.n_chars for r in found) == [0, 1, 1, 299_999] and page_texts(odd.limit(0)).count() == 0


ARTICLE = "<h1>Title</h1>" + "".join(f"<p>Paragraph {i}, with some words, commas and a sentence that goes on for a while.</p>" for i in range(5))
BLOCKS = "\n".join(re.findall(">([^<]+)<", ARTICLE))
LINKS = "<div><ul><li><a href=/>Home</a><li><a href=/x>About us</a></ul></div>"
END = "<div>Copyright 2020 Example Company, all rights reserved.</div>"
THREAD = "".join(f"<div class=comment><p>Reader {i}, I think, that this is, well, rather long and says a lot of things, indeed.</p></div>" for i in range(40))


@pytest.mark.parametrize("names", ["post comments-open", "post has-ads", "social-science", "cookie-recipe", "ad-layout", "sidebar", "no-sidebar", "", "content"])
def test_names_do_not_delete_the_article(names):
    assert main_text(f'<body>{LINKS}<div class="{names}">{ARTICLE}</div>{END}</body>') == BLOCKS
    assert main_text(f'<div class="{names}">{ARTICLE}</div>') == BLOCKS


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{LINKS}<div>{ARTICLE}</div><div><p>Sign up now</p></div>{END}</body></html>",
        f"<body><div><a href=/>Home</a> <a href=/q>More</a></div>{ARTICLE}<div><a href=/p>Back</a> | <a href=/n>Next</a></div></body>",
        f"<form id=aspnet>{LINKS}<div>{ARTICLE}</div></form>",
        f"<div id=main><div class=entry>{ARTICLE}</div><div id=comments>{THREAD}</div></div>",
        f"<article>{ARTICLE}<section class=comments>{THREAD}</section></article>",
        f"<div class=wrap><div class=col>{ARTICLE}</div><div class=sidebar>{ARTICLE.replace('Paragraph', 'Teaser').replace('h1', 'h3')}</div></div>",
        f'<main><div class="cookie-banner"><p>We use cookies, to improve, your experience here, is that all right?</p></div>{ARTICLE}<div class="related-posts"><ul><li><a href=/1>Some other story</a></ul></div></main>',
        "<article>" + ARTICLE.replace("<p>Paragraph 3", "<section class=related-work><p>Paragraph 3") + "</section></article>",
        ARTICLE.replace("<p>", "<p title=it's>"),
    ],
)
def test_the_article_alone(page):
    assert main_text(page) == BLOCKS


def test_scoring_decides_on_pages_without_names(monkeypatch):
    page = f"<html><body>{LINKS}{END}<div>{ARTICLE}</div><div><p>Sign up now</p></div></body></html>"
    assert main_text(page) == BLOCKS
    original = extract.measure

    def without_points(tree):
        original(tree)
        for n in tree.nodes:
            n.points = 0.0

    monkeypatch.setattr(extract, "measure", without_points)
    assert main_text(page) != BLOCKS


@pytest.mark.parametrize(
    "source",
    ["<a '" * (5 << 18), "<a ='" * (1 << 20), '<a x=">"' * 600_000, "<div>" * 100_000 + "<p>a, b</p></x></p></div>" * 100_000, "<span class=ad>" * 100_000 + "</b>" * 100_000, "<ul><li>" * 50_000 + "</li></div></p>" * 50_000, "<" * 2_000_000, "<script>" * 400_000, "<!--" * 1_000_000],
    ids=["quotes", "values", "hidden ends", "nested", "inline", "lists", "brackets", "scripts", "comments"],
)
def test_hostile_pages_take_linear_time(source):
    begin = time.process_time()
    main_text(source)
    assert time.process_time() - begin < 10
