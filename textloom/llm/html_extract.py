"""Main text of web pages by minimum-cut labelling.

A page becomes blocks of text in page order.  A logistic classifier of a block's length,
links and sentences gives the log-odds that it is content.  It is fitted here: on a
bounded sample of pages (``SAMPLE`` pages of at most ``LONGEST`` characters), blocks that the markup
itself puts inside or outside of an article are its examples.  Names of classes and ids are one of its features, weighed against a
fixed weight.  Log-odds and what the markup says of the block at hand make the costs of calling it content or boilerplate, the capacities to
the two terminals.  Each block that may be content has smoothness edges to the ``REACH`` blocks after it, weaker with
their distance in page order and in the tree of elements.  The minimum cut (by maximum flow) is the
labelling of least total cost: a short line among an article's paragraphs goes with them.

Defined results: a null or empty page has no text; a page of which nothing looks like an
article has the empty string; very long pages are read whole; unclosed and
stray tags are tolerated, but script, style, title, textarea and xmp run to their closing tag or
the page's end, as in browsers; what an element of ``ASIDE`` holds isn't text of the page, and its tag
is ignored if it closes itself or is never closed; text in math is kept; a "<" that starts no tag is text; without examples of
both kinds the classifier has the fixed weights ``DEFAULT``; repeated rows give repeated results; an empty table gives an empty
table; only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

# HTML element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
#: Elements whose content is drawn otherwise or stands in for something else; it is parsed, but its text left out.
ASIDE = frozenset("noscript template iframe object svg canvas audio video select datalist annotation annotation-xml".split())
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
PROSE_NAMES = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 figcaption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements, and values of ``role``, that never hold an article's text.
NEVER = frozenset("nav footer aside form button menu dialog head label fieldset".split())
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ARTICLE = frozenset("article main".split())
#: Opening one of these ends an open element of the same group that isn't nested in a container.
CLOSES = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dd": frozenset("dd dt".split()), "dt": frozenset("dd dt".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()), "th": frozenset("td th".split()), "option": frozenset("option".split())}
CONTAINER = frozenset("ul ol dl table div section article main body aside nav header footer form blockquote figure details menu".split())
#: Parts of class and id names.
BAD_NAME = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pagination pager paywall "
    "popup promo promoted promotion recommended recommendations related replies reply rail respond share sharing sidebar signup skyscraper social sponsor sponsored "
    "subscribe subscription survey tags teaser toolbar topbar widget".split()
)
GOOD_NAME = frozenset("article articlebody body content entry main maincontent post story text".split())
#: Parts of names that say how something is laid out, and nothing of what it holds.
LAYOUT = frozenset("area bar block bottom box button buttons col column container group icon inner item items left link links list outer panel right row section site slot small title top unit wrap wrapper".split())

#: Quotes count only as an attribute's value, after "=".
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?>[^<>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*+)?+)*+)>", re.S)
#: A tag whose quotes don't fit ends at the first ">".
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|[\"'][^>]*)*)>|</[^<>]*>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_SENTENCE = re.compile(r"[.!?\u2026\u3002\uff01\uff1f](?=\W|\Z)")

#: Pages that the classifier is fitted on, and their most characters.
SAMPLE, LONGEST = 2_000, 100_000
#: Weights of the classifier's features where there are no examples (see ``Block.features``), and for the last one, names that tell of
#: boilerplate, what examples are weighed against.
DEFAULT = (-0.7, 1.2, -5.0, 0.4, -9.0)
#: The log-odds of a block's length, links and sentences count up to this, either way.
MOST_ODDS = 3.0
#: What the markup says: of blocks in an article, prose elements, headings in an article, names that tell of content, a paragraph's or heading's own name, and elements that never hold content.
IN_ARTICLE, PROSE, TITLE, GOOD, OWN, NEVER_COST = 3.5, 0.5, 1.0, 1.5, 0.5, 1e6
#: Smoothness: the weight of an edge between neighbours under one parent, and how many following blocks have edges.
SMOOTH, REACH = 1.0, 4


class _Element:
    __slots__ = ("name", "parent", "depth", "score", "never", "bad", "own_bad", "article", "linked", "header", "silent", "foreign")

    def __init__(self, name: str, parent: "_Element | None", attributes: str = ""):
        self.name, self.parent = name, parent
        self.depth = parent.depth + 1 if parent else 0
        self.score = parent.score if parent else 0.0
        #: how much the names of the containers, and of a prose element itself, tell of boilerplate, from 0 to 1
        self.bad = parent.bad if parent else 0.0
        self.own_bad = parent.own_bad if parent else 0.0
        self.never = parent.never if parent else False
        self.article = parent.article if parent else False
        self.linked = name == "a" or bool(parent and parent.linked)
        self.header = name == "header" or bool(parent and parent.header)
        self.foreign = name in FOREIGN or bool(parent and parent.foreign)
        self.silent = name in ASIDE or name in RAW or bool(parent and parent.silent)
        self.never |= name in NEVER
        names = self._attributes(attributes) if attributes and not attributes.isspace() else 0.0
        if name in ARTICLE:
            # a reader's comment may be an article element of that name
            if names == 1:
                self.bad = 1.0
            elif not self.article:
                self.article = True
                self.score += IN_ARTICLE
        elif name in PROSE_NAMES:
            self.own_bad = max(self.own_bad, names)
        else:
            self.bad = max(self.bad, names)

    def _attributes(self, attributes: str) -> float:
        """Reads what an element says of itself; returns how much its names tell of boilerplate: the square of the share of such parts."""
        parts: set[str] = set()
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                self.never |= value.lower() in NEVER_ROLE
            elif key == "hidden":
                self.never = True
            elif key == "style":
                self.never |= "display:none" in value.replace(" ", "").lower()
            elif key in ("class", "id") and self.name not in ("html", "body"):
                # a whole name counts as such where it is in a list, else its parts
                for word in value.split():
                    whole = word.lower()
                    parts |= {whole} if whole in BAD_NAME or whole in GOOD_NAME else {p.lower() for p in _PART.findall(word)}
        parts = {p for p in parts if p not in LAYOUT and not p.isdigit()}
        bad = parts & BAD_NAME
        if not bad and parts & GOOD_NAME and self.name not in ARTICLE:
            self.score += GOOD
        return (len(bad) / len(parts)) ** 2 if parts else 0.0


class Block:
    __slots__ = ("text", "element", "links", "heading")

    def __init__(self, text: str, element: _Element, links: float, heading: bool):
        self.text, self.element, self.links, self.heading = text, element, links, heading

    def features(self) -> tuple[float, ...]:
        """One, length, share of links, sentences, and what the containers' names tell."""
        n = len(self.text)
        return 1.0, log1p(n / 40), self.links, min(len(_SENTENCE.findall(self.text)), 4) / 2, self.element.bad

    def outside(self) -> bool:
        """Under an element that never holds an article's text."""
        e = self.element
        return e.never or (e.header and not (e.article and self.heading))

    def benefit(self, weights: tuple[float, ...] = DEFAULT) -> float:
        """Cost of calling it boilerplate less that of calling it content."""
        if self.outside():
            return -NEVER_COST
        e, (*text, names) = self.element, self.features()
        odds = sum(w * x for w, x in zip(weights, text, strict=False))
        said = e.score + PROSE * (e.name in PROSE_NAMES) + TITLE * (self.heading and e.article) - OWN * e.own_bad
        return said + min(max(odds, -MOST_ODDS), MOST_ODDS) + weights[len(text)] * names


def _closed(html: str, name: str) -> set[int]:
    """Where the start tags of the name stand that have a closing tag of their own."""
    open_, out = [], set()
    for m in re.finditer(rf"<(/?){re.escape(name)}(?=[\s/>])", html, re.I):
        if not m[1]:
            open_.append(m.start())
        elif open_:
            out.add(open_.pop())
    return out


def blocks(html: str) -> list[Block]:
    """Blocks of text in page order."""
    out: list[Block] = []
    top = element = _Element("#page", None)
    pieces: list[tuple[str, bool]] = []
    at, end = 0, len(html)
    closed: dict[str, set[int]] = {}

    def flush() -> None:
        if pieces:
            text = " ".join(unescape("".join(p for p, _ in pieces)).split())
            if text:
                total = sum(len(p) for p, _ in pieces)
                e, heading = element, False
                while e is not top and e.name not in BLOCK:
                    e = e.parent
                heading = e.name in HEADING
                out.append(Block(text, e, sum(len(p) for p, linked in pieces if linked) / total, heading))
            pieces.clear()

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not element.silent:
            pieces.append((html[at:lt], element.linked))
        if lt == end:
            break
        m = _TOKEN.match(html, lt) or _LOOSE.match(html, lt)
        if not m:
            if not element.silent:
                pieces.append(("<", element.linked))
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            e = element
            while e is not top and e.name != name:
                e = e.parent
            if e is not top:
                if name in BLOCK and not (element.silent and e.silent):
                    flush()
                element = e.parent
            continue
        if name in RAW and not element.foreign:
            close = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
            continue
        if name in ASIDE:
            if name not in closed:
                closed[name] = _closed(html, name)
            if lt not in closed[name]:
                continue
        if name == "br":
            if not element.silent:
                pieces.append((" ", element.linked))
            continue
        if name in BLOCK:
            if not element.silent:
                flush()
            ends = CLOSES.get(name, CLOSES["p"] if name not in ("html", "head", "body") else frozenset())
            e = element
            while e is not top and e.name not in CONTAINER and e.name not in ASIDE:
                if e.name in ends:
                    element = e.parent
                e = e.parent
        if name not in VOID and not m[3].endswith("/"):
            element = _Element(name, element, m[3])
    flush()
    return out


def cut(benefit: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: which nodes are on the content side of the minimum cut.

    Nodes whose own benefit outweighs all their edges are settled first, and their pull
    goes to their neighbours' benefits; what is left is solved by maximum flow.
    """
    n = len(benefit)
    benefit = list(benefit)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    pull = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(benefit[i]) < pull[i]:
            continue
        label[i] = benefit[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                benefit[j] += w if label[i] else -w
                pull[j] -= w
                todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        content = _flow(rest, benefit, near, label)
        for i in rest:
            label[i] = i in content
    return [bool(x) for x in label]


def _flow(rest: list[int], benefit: list[float], near: list[dict[int, float]], label: list[bool | None]) -> set[int]:
    """Content side of the minimum cut among unsettled nodes, by augmenting along shortest paths."""
    source, sink = -1, -2
    left: dict[int, dict[int, float]] = {source: {}, sink: {}, **{i: {} for i in rest}}
    for i in rest:
        for j, w in near[i].items():
            if label[j] is None:
                left[i][j] = w
        a, b = (source, i) if benefit[i] > 0 else (i, sink)
        left[a][b] = abs(benefit[i])
        left[b].setdefault(a, 0.0)
    while True:
        came = {source: source}
        queue = deque([source])
        while queue and sink not in came:
            a = queue.popleft()
            for b, w in left[a].items():
                if w > 1e-9 and b not in came:
                    came[b] = a
                    queue.append(b)
        if sink not in came:
            return set(came) - {source}
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        most = min(left[a][b] for a, b in path)
        for a, b in path:
            left[a][b] -= most
            left[b][a] = left[b].get(a, 0.0) + most


def hops(a: _Element, b: _Element) -> int:
    """Steps from one element to the other in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges of blocks in page order; pieces of one element and siblings are two steps apart at most.

    Blocks outside of any article are settled, and pull no other; a container whose name tells of boilerplate is a border that edges
    hardly cross, and within one container all is near.
    """
    out, settled = [], [b.outside() for b in found]
    for i, a in enumerate(found):
        for gap, b in enumerate(found[i + 1 : i + 1 + REACH], 1):
            if not (settled[i] or settled[i + gap]):
                border = 1 - max(a.element.bad, b.element.bad) if a.element.bad != b.element.bad else 1.0
                out.append((i, i + gap, border * SMOOTH / (gap * max(1, hops(a.element, b.element) - 1))))
    return out


def labels(found: list[Block], weights: tuple[float, ...] = DEFAULT) -> list[bool]:
    """Which blocks are content, by the minimum cut."""
    return cut([b.benefit(weights) for b in found], edges(found))


def main_text(html: str | None, weights: tuple[float, ...] = DEFAULT) -> str:
    """The article's blocks, one to a line."""
    found = blocks(html or "")
    return "\n".join(b.text for b, k in zip(found, labels(found, weights), strict=True) if k)


def examples(html: str | None) -> list[tuple[tuple[float, ...], int]]:
    """Features and label of blocks that elements, not their names, put inside or outside of an article."""
    out = []
    for b in blocks(html or ""):
        if b.outside():
            out.append((b.features(), 0))
        elif b.element.article:
            out.append((b.features(), 1))
    return out


def train(rows: list[tuple[tuple[float, ...], int]], steps: int = 12, ridge: float = 1.0) -> tuple[float, ...]:
    """Logistic regression by Newton steps, with both classes of equal weight; DEFAULT without both.

    The weight of names is drawn to DEFAULT's, the others to 0; it is never above 0.
    """
    if len({y for _, y in rows}) < 2:
        return DEFAULT
    x, y = np.array([f for f, _ in rows]), np.array([k for _, k in rows], float)
    times = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    still = np.array([0.0] * (x.shape[1] - 1) + [DEFAULT[-1]])
    w = still.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (times * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (times * (y - p)) - ridge * (w - still))
    return (*w[:-1].tolist(), min(float(w[-1]), 0.0))


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> tuple[float, ...]:
    """Weights from SAMPLE pages, chosen by a hash of their ids; equal ids are told apart by their pages' hashes."""
    short = pages.where(F.col(html_col).isNotNull() & (F.char_length(html_col) <= LONGEST))
    order = F.xxhash64(F.col(id_col).cast("string")).alias("a"), F.xxhash64(html_col).alias("b")
    # hashes alone are ordered; the pages of the few that are chosen, each once, come to the driver
    chosen = short.select(*order).distinct().orderBy("a", "b").limit(SAMPLE)
    rows = short.select(*order, F.col(html_col).alias("html")).join(F.broadcast(chosen), ["a", "b"]).dropDuplicates(["a", "b"]).toArrow().to_pylist()
    return train([e for r in sorted(rows, key=lambda r: (r["a"], r["b"])) for e in examples(r["html"])])


def text_column(html: Column, weights: tuple[float, ...] = DEFAULT) -> Column:
    @F.arrow_udf(T.StringType())
    def extracted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p.as_py(), weights) for p in pages], pa.string())

    return extracted(html)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (its code points) of each page."""
    weights = fit(pages, id_col, html_col)
    out = pages.select(F.col(id_col), F.col(url_col), text_column(F.col(html_col), weights).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
