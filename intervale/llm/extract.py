"""Main text of web pages by tree scoring.

A page is read once into a light tree of its block elements. Each text block passes points for its length and commas to the element
around it, which passes half of its points on to the next, and so on; an element's points are discounted by the share of its text
that lies in links. The element with most points is the container. It is kept with the siblings that score well beside it and the
paragraphs and headings that belong to it; lists of links inside an unmarked container are not.

Elements that are apart by their tag, role or state (navigation, asides, hidden parts) pass no points. Names in class and id are
hints only: they take an element out if enough text is left without it, so the frame of an article never goes by its name.
Parsing and scoring are linear in the length of the page, whatever its quotes, nesting and unclosed elements are.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: A tag; quotes count after "=" only. The groups keep what they matched, so no text is read twice.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?>=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>")
#: The same without quotes, for pages whose quotes do not close.
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
SPACE = re.compile(r"\s+")

#: Elements whose content is no markup, or no text of the page.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in "script style textarea title noscript template iframe svg xmp".split()}
#: Elements inside a line of text; every other tag begins or ends a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and roles that never hold main text.
APART = frozenset("nav aside footer button select option fieldset dialog menu head object audio video canvas map".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Elements that hold none unless most of the text is in them.
HINTED = frozenset("header form".split())
#: Words in class or id that hint at the same.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion menu menus nav navbar navigation navi topnav breadcrumb breadcrumbs masthead sidebar sidebars"
    " cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login footer pagination pager paging".split()
)
#: Words that hint at reader comments.
COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that hint at parts beside the text only where no other but COMPANIONS stand in the name.
WEAK = frozenset("social share sharing related recommended recommendations header search notice notices alert banner banners widget widgets overlay hidden skip rail reply discussion toolbar".split())
COMPANIONS = frozenset("posts post articles article stories links link list lists box block blocks bar buttons button icons icon items item section container wrap wrapper area media content top bottom left right main site page global inner outer js wp id to a".split())
#: Words that tell of an element's state, not its kind, and names of the text's own frame.
STATES = frozenset("has no not with without is open closed free enabled disabled hide show".split())
FRAMES = frozenset("content main article body entry post story article-body entry-content post-content main-content story-body post-body article-content".split())
#: Elements that take points of their own; a block in another element gives them to the one around it.
CONTAINERS = frozenset("article main div section body td blockquote ul ol dl table center form header".split()) | {""}
BONUS = {"article": 25.0, "main": 20.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "pre": 3.0, "td": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": -3.0}
ENDS = frozenset(".!?…。！？")
COMMA = re.compile("[,،、，]")
#: Where all prose of a page is in hinted parts, one goes if the others hold this share of its own.
ENOUGH_SHARE = 0.25


@dataclass
class Node:
    tag: str
    parent: int
    apart: bool
    hint: str = ""
    article: bool = False
    frame: bool = False
    own: float = 0.0
    points: float = 0.0
    chars: int = 0
    linked: int = 0
    prose: int = 0
    framed: bool = False


@dataclass
class Page:
    nodes: list[Node] = field(default_factory=lambda: [Node("", -1, False)])
    #: (node, text, characters in links)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def hinted(tag: str, names: str) -> tuple[str, bool]:
    """What class and id hint at ("comments", "beside" or nothing), and whether they name the text's own frame."""
    found = "beside" if tag in HINTED else ""
    tokens = re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower().split()
    if any(token in FRAMES for token in tokens):
        return found, not found
    for token in tokens:
        words = {w for w in re.split(r"[^a-z]+", token) if w}
        if words & STATES and not words <= STATES:
            continue
        if words & COMMENTS:
            return "comments", False
        if words & HINTS or words & WEAK and words <= WEAK | COMPANIONS:
            found = "beside"
    return found, False


def nature(tag: str, attrs: str) -> tuple[bool, str, bool, bool]:
    """Whether an element is apart from the main text, what its names hint at, and whether it says that it is the article, or its frame."""
    article = tag == "article"
    if not attrs or attrs in (" ", "/", " /"):
        return tag in APART, "beside" if tag in HINTED else "", article, False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attrs)}
    role = found.get("role", "").lower()
    article = article or role == "article" or found.get("itemprop", "").lower() == "articlebody"
    apart = tag in APART or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or role in APART_ROLES
    if apart or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return True, "", article, False
    hint, frame = ("", False) if tag in ("html", "body", "main") else hinted(tag, found.get("class", "") + " " + found.get("id", ""))
    return False, hint, article, frame


class Reader:
    """Reads one page into its tree; open elements are counted by scope, so an end tag without a start is known at once."""

    def __init__(self) -> None:
        self.page = Page()
        self.stack: list[tuple[str, int]] = [("", 0)]
        #: Open elements in each table or cell, and open list items in each list.
        self.cells: list[tuple[str, Counter]] = [("", Counter())]
        self.lists: list[Counter] = [Counter()]
        self.every: Counter = Counter()
        #: Inline elements that mute what is in them, by tag.
        self.mute: list[str] = []
        self.muted: Counter = Counter()
        self.pending: list[str] = []
        self.linked, self.link_depth = 0, 0

    def flush(self) -> None:
        if self.pending:
            text = SPACE.sub(" ", "".join(self.pending)).strip()
            self.pending.clear()
            node = self.stack[-1][1]
            if text and not self.page.nodes[node].apart:
                self.page.blocks.append((node, text, min(self.linked, len(text))))
        self.linked = 0

    def text(self, source: str) -> None:
        if source and not self.mute and not self.page.nodes[self.stack[-1][1]].apart:
            text = html.unescape(source) if "&" in source else source
            self.pending.append(text)
            if self.link_depth:
                self.linked += len(text.strip())

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.every[tag] -= 1
        if tag in ("table", "td", "th"):
            self.cells.pop()
        if tag in ("ul", "ol", "dl"):
            self.lists.pop()
        if tag in ("li", "dt", "dd"):
            self.lists[-1][tag] -= 1
        self.cells[-1][1][tag] -= 1
        if self.link_depth > len(self.stack):
            self.link_depth = 0
        return tag

    def close(self, tag: str) -> None:
        """Close the innermost open ``tag`` and all in it, if there is one that can be closed from here."""
        reach = self.lists[-1] if tag in ("li", "dt", "dd") else self.every if tag in ("table", "td", "th", "tr", "ul", "ol", "dl") else self.cells[-1][1]
        if reach[tag] > 0:
            while self.pop() != tag:
                pass

    def inline(self, tag: str, attrs: str, end: bool) -> None:
        if tag == "a":
            self.link_depth = 0 if end or "href" not in attrs.lower() else len(self.stack)
        elif tag == "br":
            self.pending.append(" ")
        if end and self.muted[tag] > 0:
            while True:
                last = self.mute.pop()
                self.muted[last] -= 1
                if last == tag:
                    break
        elif not end and tag not in VOID and tag != "a" and attrs.strip(" /") and not attrs.endswith("/"):
            apart, hint, *_ = nature(tag, attrs)
            if apart or hint or self.muted[tag]:
                self.mute.append(tag)
                self.muted[tag] += 1
        elif not end and self.muted[tag] > 0:
            self.mute.append(tag)
            self.muted[tag] += 1

    def block(self, tag: str, attrs: str, end: bool) -> None:
        self.mute.clear()
        self.muted.clear()
        self.flush()
        if end:
            self.close(tag)
            return
        if self.cells[-1][1]["p"] > 0 and tag not in VOID | {"body", "html", "head"} or tag == "hr":
            self.close("p")
        if tag in ("li", "dt", "dd"):
            for other in ("li",) if tag == "li" else ("dt", "dd"):
                self.close(other)
        elif tag in ("td", "th", "tr", "tbody", "thead", "tfoot") and self.cells[-1][0] in ("td", "th"):
            self.close(self.cells[-1][0])
        if tag == "tr" and self.cells[-1][1]["tr"] > 0:
            self.close("tr")
        if tag in VOID:
            return
        apart, hint, article, frame = nature(tag, attrs)
        parent = self.stack[-1][1]
        nodes = self.page.nodes
        nodes.append(Node(tag, parent, apart or nodes[parent].apart, hint, article, frame))
        self.cells[-1][1][tag] += 1
        self.every[tag] += 1
        if tag in ("li", "dt", "dd"):
            self.lists[-1][tag] += 1
        if tag in ("ul", "ol", "dl"):
            self.lists.append(Counter())
        if tag in ("table", "td", "th"):
            self.cells.append((tag, Counter()))
        self.stack.append((tag, len(nodes) - 1))


def parsed(source: str) -> Page:
    """The block tree of ``source`` and its text blocks in page order."""
    reader, at, pattern = Reader(), 0, TAG
    while True:
        opens = source.find("<", at)
        if opens < 0:
            reader.text(source[at:])
            break
        reader.text(source[at:opens])
        follows = source[opens + 1 : opens + 2]
        if follows in ("!", "?") and follows:
            comment = source.startswith("<!--", opens)
            end = source.find("-->" if comment else ">", opens + 2 if comment else opens)
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        if not (follows.isascii() and follows.isalpha() or follows == "/"):
            reader.text("<")
            at = opens + 1
            continue
        m = pattern.match(source, opens)
        if m is None and pattern is TAG and follows != "/":
            pattern = PLAIN_TAG  # the page has quotes that hide all ends of tags from here on
            m = pattern.match(source, opens)
        if m is None:
            end = source.find(">", opens)
            if end < 0:
                break  # a tag that never ends
            at = end + 1
            continue
        at = m.end()
        tag, attrs = m[2].lower(), m[3]
        if tag in RAW and not m[1]:
            reader.block(tag, "", False) if tag not in INLINE else None
            reader.close(tag)
            closing = RAW[tag].search(source, at)
            if closing is None:
                break
            at = closing.start()
            continue
        if tag in INLINE:
            reader.inline(tag, attrs, bool(m[1]))
        else:
            reader.block(tag, attrs, bool(m[1]))
    reader.flush()
    return reader.page


def measure(page: Page) -> None:
    """Fill in what the nodes' subtrees hold: points, characters, those in links, and prose; children come after their parents."""
    nodes = page.nodes
    for n in nodes:
        n.own = n.points = 0.0
        n.chars = n.linked = n.prose = 0
        n.framed = n.article or n.tag in ("main", "h1")
    for i, text, linked in page.blocks:
        n = nodes[i]
        if n.apart:
            continue
        heading = len(n.tag) == 2 and n.tag[0] == "h"
        taker = n if n.tag in CONTAINERS else nodes[n.parent]
        taker.own += 0.0 if heading else (1.0 + len(COMMA.findall(text)) + min(len(text) / 100.0, 3.0)) * (1 - linked / len(text))
        n.chars += len(text)
        n.linked += linked
        n.prose += 0 if heading or len(text) < (20 if text[-1] in ENDS else 40) else len(text) - linked
    for n in reversed(nodes):
        n.points += n.own
        if n.parent >= 0 and not n.apart:
            up = nodes[n.parent]
            up.points += n.points / 2
            up.chars += n.chars
            up.linked += n.linked
            up.prose += n.prose
            up.framed |= n.framed


def settle_hints(page: Page) -> None:
    """Take out the elements whose names hint that they are beside the text.

    They go where prose, or a frame of the article (marked or so named) with any text, is outside all of them, however short. Where the
    page's prose is in hinted parts only, reader comments go if there is other prose, and other parts by the share that is left.
    """
    nodes = page.nodes
    total = nodes[0].prose
    outer = [""] * len(nodes)
    inside = [i > 0 and _inside_hint(nodes, i, outer) for i in range(len(nodes))]
    beside = sum(n.prose for i, n in enumerate(nodes) if i and n.hint and not n.apart and not inside[i] and not n.framed)
    told = any((n.frame or n.article or n.tag == "main") and n.chars > n.linked and not n.hint and not n.apart and not inside[i] for i, n in enumerate(nodes))
    for n in nodes:
        if n.parent >= 0 and nodes[n.parent].apart:
            n.apart = True
        if not n.hint or n.apart:
            continue
        if n.framed:  # it holds the title or the article itself
            n.apart = 2 * n.prose <= total and not (n.article and n.hint != "comments")
        elif beside < total or told:
            n.apart = True
        elif n.prose:
            rest = total - n.prose
            n.apart = rest > 0 if n.hint == "comments" else rest >= ENOUGH_SHARE * n.prose
        else:
            n.apart = nodes[0].chars > n.chars


def _inside_hint(nodes: list[Node], i: int, outer: list[str]) -> bool:
    """Whether an element around node ``i`` is hinted too; ``outer`` carries the answer down, parents first."""
    parent = nodes[i].parent
    outer[i] = outer[parent] or (nodes[parent].hint if not nodes[parent].framed else "")
    return bool(outer[i])


def main_text(source: str | None) -> str:
    """The main text of one page: its blocks in page order, one a line."""
    page = parsed(source or "")
    nodes = page.nodes
    measure(page)
    if any(n.hint for n in nodes):
        settle_hints(page)
        measure(page)

    def density(n: Node) -> float:
        return n.linked / n.chars if n.chars else 0.0

    def worth(n: Node) -> float:
        return (n.points + BONUS.get(n.tag, 0.0) + (25.0 if n.article and n.tag != "article" else 0.0)) * (1 - density(n)) if n.chars else 0.0

    able = [i for i, n in enumerate(nodes) if not n.apart and n.chars]
    if not able:
        return ""
    takers = [i for i in able if nodes[i].tag in CONTAINERS] or able
    best = max(takers, key=lambda i: (worth(nodes[i]), -i))
    top, up = worth(nodes[best]), best
    while up > 0:  # the parts of a marked article stay together
        if nodes[up].article:
            best = up
        up = nodes[up].parent
    kept, seen = {best}, False
    for i in reversed(able):
        n = nodes[i]
        if i == best:
            seen = True
        elif n.parent == nodes[best].parent:
            heading = len(n.tag) == 2 and n.tag[0] == "h"
            if heading:
                good = seen and density(n) < 0.5
            elif n.tag in ("p", "pre", "blockquote"):
                good = density(n) < 0.25 and (n.chars > 80 or n.prose > 0)
            else:
                good = n.article or worth(n) >= max(10.0, 0.2 * top) and not nodes[best].article
            if good:
                kept.add(i)
    marked = nodes[best].article or nodes[best].tag == "main"
    state = [0] * len(nodes)  # 1: kept, 2: taken out
    for i, n in enumerate(nodes):
        if i in kept:
            state[i] = 1
        elif n.parent >= 0:
            state[i] = state[n.parent]
            links = not marked and state[i] == 1 and n.tag in ("ul", "ol", "dl", "table", "div", "section") and n.chars and density(n) > 0.5
            if n.apart or links:
                state[i] = 2 if state[i] else 0
    return "\n".join(text for node, text, _ in page.blocks if state[node] == 1)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages`` (page_id, url, html, more).

    Null and empty html, and pages without main text, give an empty text. Character references are decoded, white space inside a
    block becomes one space, blocks are joined by \\n in page order. Repeated rows, and rows with a null page_id or url, are
    extracted as any other. An empty table gives an empty one; other columns are not read. Pages are read whole.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                texts = [main_text(source) for source in some.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("page_id").cast(pa.int64()), some.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
